"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over seven bytes; where its lowest bits are zero a chunk ends, so chunks move with the text. Each
chunk gives one of 64 signs. A fingerprint is ``block:signature:signature``, the second at twice the block size.
Two fingerprints compare at equal block sizes, or where one's double is the other's, by edit distance.

Null texts are empty, with the fingerprint ``2::``. Documents are in descending order of doc_id (null ids last),
equal ids in order of text; repeated rows follow each other. One document is its own next. Extra columns are not
read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import map_rows

WINDOW, SIGNS, MOST = 7, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 160
#: Bytes that are worked on at once, the most buckets of neighbouring documents, and ids sampled for each.
SEGMENT, BUCKETS, SAMPLED = 1 << 18, 65_536, 8
_FACTORS = [pow(0x01000193, j, 1 << 32) for j in range(WINDOW)]
_SIGNS = np.frombuffer(SIGNS.encode(), np.uint8)


def _levels(data: np.ndarray) -> np.ndarray:
    """For each byte the number of zero bits at the end of the hash of the window that it closes."""
    out = np.empty(len(data), np.uint8)
    for at in range(0, len(data), SEGMENT):
        first = max(0, at - WINDOW + 1)
        c = data[first : at + SEGMENT].astype(np.uint32) + np.uint32(1)
        h = c.copy()
        for j in range(1, min(WINDOW, len(c))):
            h[j:] += c[:-j] * np.uint32(_FACTORS[j])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h |= np.uint32(1 << 31)
        low = (h & (~h + np.uint32(1))).astype(np.float32).view(np.uint32) >> np.uint32(23)
        out[at : at + SEGMENT] = (low - np.uint32(127))[at - first :]
    return out


def _signature(data: np.ndarray, ends: np.ndarray) -> str:
    """A sign for each chunk that ends after one of ``ends``, and for what follows the last."""
    if not len(data):
        return ""
    starts = np.concatenate(([0], ends + 1))
    if starts[-1] == len(data):
        starts = starts[:-1]
    starts = starts[:MOST]  # further chunks run on into the last, whole as they are
    sums = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), SEGMENT):
        c = data[at : at + SEGMENT].astype(np.uint64)
        of = np.searchsorted(starts, np.arange(at, at + 1), "right")[0] - 1
        last = np.searchsorted(starts, at + len(c), "left")
        local = np.maximum(starts[of:last] - at, 0)
        place = np.arange(at, at + len(c), dtype=np.int64) - np.repeat(starts[of:last], np.diff(np.append(local, len(c))))
        place = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sums[of:last] += np.add.reduceat((c + np.uint64(1)) * ((place ^ (place >> np.uint64(29))) | np.uint64(1)), local)
    sums ^= sums >> np.uint64(31)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    return _SIGNS[(sums >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    k = max(1, (n // 64).bit_length()) if n else 1
    levels = _levels(data)
    ends = np.flatnonzero(levels >= k)
    while k > 1 and len(ends) < 8:
        k -= 1
        ends = np.flatnonzero(levels >= k)
    while k < 30 and len(ends) > 128:
        k += 1
        ends = ends[levels[ends] >= k]
    return f"{1 << k}:{_signature(data, ends)}:{_signature(data, ends[levels[ends] > k])}"


def _alike(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def likeness(x: Column, y: Column) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 at incompatible block sizes."""
    (bx, x1, x2), (by, y1, y2) = ((F.split_part(f, F.lit(":"), F.lit(1)).cast("long"), F.split_part(f, F.lit(":"), F.lit(2)), F.split_part(f, F.lit(":"), F.lit(3))) for f in (x, y))
    return (
        F.when(x == y, F.lit(1.0)).when(bx == by, F.greatest(_alike(x1, y1), _alike(x2, y2)))
        .when(bx == 2 * by, _alike(x1, y2)).when(2 * bx == by, _alike(x2, y1)).otherwise(F.lit(0.0))
    )


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, of the first of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _cuts(keys: DataFrame, rows: int) -> list[int]:
    """The least keys of all buckets but the lowest, from a sample of some ``SAMPLED`` keys a bucket."""
    buckets = max(1, min(BUCKETS, rows // 64))
    found = sorted(r[0] for r in keys.sample(min(1.0, SAMPLED * buckets / max(1, rows)), seed=1).collect()) if buckets > 1 else []
    return sorted({found[len(found) * i // buckets] for i in range(1, buckets)}) if found else []


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the ``cuts`` are at or below the key, by binary search in one constant array."""
    if not cuts:
        return F.lit(0).cast("long")
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at))
    return found.cast("long")


def fingerprints(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next[, edited]).

    Texts are dealt once, by ranges of ids; the head of each bucket also goes to the end of the one
    before it, so a task reads its documents in order with the next one at hand. Buckets are cut at quantiles of a sample
    of the ids, so they are even however the ids lie. Sample and bucket heads, bounded by ``BUCKETS``, are all that the
    driver sees.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low, n = own.agg(F.min("doc_id"), F.count("*")).first()
    own = own.withColumn("key", F.coalesce("doc_id", F.lit(0 if low is None else low) - 1))
    own = own.withColumn("bucket", _bucket(F.col("key"), _cuts(own.select("key"), n)))
    heads = [tuple(r) for r in own.groupBy("bucket").agg(F.max("key").alias("key")).orderBy(F.desc("bucket")).collect()]
    ends = [(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)]  # each head closes the bucket above; the first the last
    tails = own.drop("bucket").join(F.broadcast(spark.createDataFrame(ends, "key long, bucket long")), "key")
    dealt = own.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), "text")

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        bucket, held = None, None
        for r in source:
            if r["bucket"] != bucket:
                bucket, held = r["bucket"], None
            elif held is None:
                continue  # further texts that share a tail's id
            text = r["text"]
            mark = fingerprint(text) if held is None or text != held[1] else held[2]
            if held is not None:
                made = edited(held[1], text)
                yield (held[0], len(held[1]), hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest(), held[2], fingerprint(made), mark, *((made,) if with_text else ()))
            held = None if r["tail"] else (r["doc_id"], text, mark)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string" + ", edited string" * with_text
    found = map_rows(dealt.select("bucket", "tail", "doc_id", "text"), schema, rows)
    near = {f"near_{k}": likeness(F.col("fingerprint"), F.col(f"{k}_fingerprint")) for k in ("edited", "next")}
    return found.withColumns(near).drop("next_fingerprint")
