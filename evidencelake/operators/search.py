"""Search: names, literal and pattern content, raw chunks, printable text, and a ranked inverted index."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The usual BM25 constants.
K1, B = 1.2, 0.75


def literal_hits(text: Column, needle: str, per_file: int = 20, around: int = 30, ignore_case: bool = True) -> Column:
    """Array of (position from 1, context): hits that don't overlap, ``per_file`` at most; JVM-side throughout."""
    body = F.lower(text) if ignore_case else text
    wanted = needle.lower() if ignore_case else needle
    parts = F.split(body, "\\Q" + wanted.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    n = len(needle)
    state = "struct<at:int,found:array<int>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")).cast(state)
    kept = F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(per_file)))
    places = F.aggregate(kept, start, lambda a, p: F.struct((a["at"] + F.length(p) + n).alias("at"), F.concat(a["found"], F.array((a["at"] + F.length(p)).cast("int"))).alias("found")).cast(state), lambda a: a["found"])
    return F.transform(places, lambda p: F.struct(p.alias("position"), F.substring(text, F.greatest(F.lit(1), p - around), F.least(p - 1, F.lit(around)) + n + around).alias("context")))


def hit_count(text: Column, needle: str, ignore_case: bool = True) -> Column:
    body = F.lower(text) if ignore_case else text
    wanted = needle.lower() if ignore_case else needle
    return F.call_function("div", F.length(body) - F.length(F.replace(body, F.lit(wanted), F.lit(""))), F.lit(len(wanted))).cast("int")


def search_content(files: DataFrame, needles: list[str], per_file: int = 20) -> DataFrame:
    """(node, term, position, context, more_in_file): the cap holds per file and term; ``more_in_file`` says what it cut."""
    made = F.array(*(F.struct(F.lit(x).alias("term"), literal_hits(F.col("text"), x, per_file).alias("hits"), hit_count(F.col("text"), x).alias("n")) for x in needles))
    found = files.select("node", F.inline(made)).where("n > 0")
    return found.select("node", "term", F.posexplode("hits").alias("k", "hit"), "n").select(
        "node", "term", "hit.position", "hit.context", F.when(F.col("k") + 1 == F.least(F.col("n"), F.lit(per_file)), F.col("n") - F.col("k") - 1).otherwise(0).alias("more_in_file")
    )


def regex_hits(files: DataFrame, terms: list[str]) -> DataFrame:
    """(node, n, first) of files that any of the patterns matches, whatever the case."""
    whole = "(?i)(" + "|".join(f"(?:{t})" for t in terms) + ")"
    all_hits = F.regexp_extract_all("text", F.lit(whole), F.lit(1))
    return files.where(F.col("text").rlike(whole)).select("node", F.size(all_hits).alias("n"), F.get(all_hits, F.lit(0)).alias("first"))


def chunks(sources: DataFrame, size: int = 4096, overlap: int = 64) -> DataFrame:
    """(source, offset, data) of (source, body): windows that overlap, so that no hit falls between two."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("body") - 1), F.lit(size))
    return sources.select("source", "body", F.explode(starts).alias("offset")).select("source", "offset", F.substring("body", F.col("offset") + 1, F.lit(size + overlap)).alias("data"))


def raw_hits(windows: DataFrame, needle: str) -> DataFrame:
    """(source, offset): each place once, though two windows may show it."""
    hit = F.explode(literal_hits(F.col("data"), needle, 1 << 20, 0, False)).alias("hit")
    return windows.select("source", "offset", hit).select("source", (F.col("offset") + F.col("hit.position") - 1).alias("offset")).distinct()


def printable_runs(text: Column, least: int = 4) -> Column:
    return F.regexp_extract_all(text, F.lit("([ -~]{%d,})" % least), F.lit(1))


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and the letters without their marks; marks that stand alone come last and have none."""
    found = {chr(c): parts[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(parts := unicodedata.normalize("NFD", chr(c).lower())) > 1}
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


_MARKED, _PLAIN = _plain_letters()
_WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), _MARKED, _PLAIN), F.lit(f"({_WORD})"), F.lit(1))


def token(word: str) -> str:
    """A word of a query as ``tokens`` has it."""
    return "".join(c for c in word.lower().translate(str.maketrans(_MARKED[: len(_PLAIN)], _PLAIN, _MARKED[len(_PLAIN) :])) if c.isalnum())


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc, tf, length, positions) of (doc, body): the index, to be kept as a table by term."""
    words = docs.select("doc", tokens(F.col("body")).alias("words")).select("doc", F.size("words").alias("length"), F.posexplode("words").alias("position", "term"))
    return words.groupBy("term", "doc").agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"), F.sort_array(F.collect_list("position")).alias("positions"))


def _is(word: str):
    return lambda w: w == F.lit(word)


def _less(by: int):
    return lambda p: p - F.lit(by)


def bm25(docs: DataFrame, terms: list[str], every: bool, limit: int | None = None) -> DataFrame:
    """(doc, score, hits) best first: any or every one of the terms, weighed by BM25.

    Only the postings of the terms leave the scan: each document counts its own few terms where it is read, so the
    shuffle carries a number for each document at most, and statistics are one small row.
    """
    wanted = [token(t) for t in terms]
    words = tokens(F.col("body"))
    counted = docs.select("doc", F.size(words).alias("length"), *(F.size(F.filter(words, _is(t))).alias(f"tf{i}") for i, t in enumerate(wanted)))
    total = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted)))).first()
    score, hits = F.lit(0.0), F.lit(0)
    for i in range(len(wanted)):
        tf = F.col(f"tf{i}")
        idf = max(1e-6, math.log((total.n - total[f"df{i}"] + 0.5) / (total[f"df{i}"] + 0.5)))
        score += F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(total.mean or 1.0)))
        hits += (tf > 0).cast("int")
    found = counted.withColumn("score", score).withColumn("hits", hits).where(F.col("hits") == len(wanted) if every else F.col("hits") > 0).select("doc", "score", "hits")
    return found.orderBy(F.desc("score"), "doc").limit(limit) if limit else found


def phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc, n) of documents that hold the words side by side: positions shifted to the first word meet."""
    at = [index.where(F.col("term") == w).select("doc", F.transform("positions", _less(i)).alias(f"p{i}")) for i, w in enumerate(words)]
    joined = at[0]
    for other in at[1:]:
        joined = joined.join(other, "doc")
    common = F.col("p0")
    for i in range(1, len(words)):
        common = F.array_intersect(common, F.col(f"p{i}"))
    return joined.select("doc", F.size(common).alias("n")).where("n > 0")


def coverage(docs: DataFrame) -> DataFrame:
    """(kind, indexed, empty, chars): what an index over ``docs`` (kind, body) holds, and what had no text."""
    has = F.size(printable_runs(F.col("body"))) > 0
    return docs.groupBy("kind").agg(F.count_if(has).alias("indexed"), F.count_if(~F.coalesce(has, F.lit(False))).alias("empty"), F.sum(F.length("body")).alias("chars"))


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= n).drop("r")
