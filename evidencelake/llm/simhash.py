"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into three segments (22, 21, 21), each read as a word of the binary Golay code [23, 12].
Every word is within three bits of exactly one codeword, so it decodes to one 12-bit index, and all words within a bit
of it decode to six indices at most. Of up to two errors in three segments, some segment has none while the one
after it (in a ring) has one at most: if two segments are whole, one follows the other; if one is, both
others have one error. So two linked fingerprints share a key (whole segment, index of the next) among the own
key of one and the six of the other. Keys are joined and the distance verified, exactly.

Documents with one fingerprint are one node, so copies never multiply. Where more fingerprints than ``CROWD`` share a key
they aren't compared pair by pair: sorting them with two bits masked puts exactly the linked ones side by side.

Null texts are empty; a text without words has fingerprint zero. A null doc_id takes part; component_id is the
smallest id that is not null. Repeated rows are repeated results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import arrow_limits, cut, map_rows, worker_cache
from evidencelake.llm.components import components

SHINGLE, SEED, ERRORS, CROWD = 3, 42, 2, 1_500
# Fixed value: the generator polynomial of the Golay code [23, 12].
GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width of each


def hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([of(joined, seed)], ">u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.fromiter((of(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), ">u8", len(words) - size + 1)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[at : at + 65_536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def decoder() -> np.ndarray:
    """Index of the one codeword within three bits, for each word of 23 bits: built from the code's syndromes."""

    def build() -> np.ndarray:
        words = np.arange(1 << 23, dtype=np.uint32)
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where((rest >> np.uint32(bit)) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        errors = np.zeros(1 << 11, np.uint32)
        for n in range(4):
            for at in combinations(range(23), n):
                pattern = sum(1 << b for b in at)
                errors[rest[pattern]] = pattern
        return ((words ^ errors[rest]) >> np.uint32(11)).astype(np.uint16)

    return worker_cache(("golay", GENERATOR), build)


def near(words: np.ndarray, width: int) -> np.ndarray:
    """(n, 1 + width): the indices of words and of all that differ in one of ``width`` bits."""
    index = decoder()
    flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.int64)
    return index[words[:, None] ^ flips[None, :]]


def keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fingerprint, own) of the three rings: own keys, by the word itself, and further ones, by words a bit off."""
    segments = [((prints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    for ring in range(3):
        after = (ring + 1) % 3
        found = near(segments[after], SEGMENTS[after][1]).astype(np.int64)
        base = (segments[ring] << 14) | ring
        yield base | (found[:, 0] << 2), prints, np.ones(len(prints), bool)
        found.sort(axis=1)
        fresh = np.concatenate((np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]), axis=1)
        row, column = np.nonzero(fresh)
        yield base[row] | (found[row, column] << 2), prints[row], np.zeros(len(row), bool)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(own: np.ndarray, other: np.ndarray, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Links that join what is linked between and within the two sets of one key: a tree for each component."""
    nodes = np.unique(np.concatenate((own, other)))
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []

    def link(a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((int(nodes[a]), int(nodes[b])))

    if len(nodes) <= CROWD:
        for i in range(len(nodes) - 1):
            for j in (np.flatnonzero(distance(nodes[i + 1 :], nodes[i]) <= errors) + i + 1).tolist():
                link(i, j)
    else:
        varied = [b for b in range(64) if len(np.unique((nodes >> np.uint64(b)) & np.uint64(1))) > 1]
        for at in combinations(varied, min(errors, len(varied))):
            masked = nodes & ~np.uint64(sum(1 << b for b in at))
            order = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
            for i in same.tolist():
                link(int(order[i]), int(order[i + 1]))
    return out


def links(prints: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(a, b), fingerprints as signed longs, of the column ``fp`` (distinct): enough links to join all that is linked."""
    arrow_limits(prints.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for key, fp, own in keys(fps):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(own)], ["key", "fp", "own"])

    dealt = prints.select("fp").mapInArrow(spread, "key long, fp long, own boolean").repartition("key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 3

        def linked(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(key):
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                sizes = np.diff(np.append(starts, len(key)))
                owned = np.add.reduceat(own.astype(np.int64), starts)
                for s, n in zip(starts[(owned > 0) & (sizes > 1)].tolist(), sizes[(owned > 0) & (sizes > 1)].tolist(), strict=True):
                    part, mine = fp[s : s + n].view(np.uint64), own[s : s + n].astype(bool)
                    if (part != part[0]).any():
                        out += forest(part[mine], part[~mine], errors)
            a, b = (np.array([x[i] for x in out], np.uint64).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            whole = [np.concatenate((h, x)) for h, x in zip(held, new, strict=True)]
            cutoff = int(np.searchsorted(whole[0], whole[0][-1])) if len(whole[0]) else 0
            held = tuple(x[cutoff:] for x in whole)
            yield linked(*(x[:cutoff] for x in whole))
        yield linked(*held)

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            fp = majority(hashes(r["text"] or "", size))
            yield (r["doc_id"], fp - (1 << 64) if fp >> 63 else fp)

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", rows)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``."""
    marked = cut(fingerprints(docs))
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(least))
    of = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    lowest = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
