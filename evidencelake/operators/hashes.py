"""Digests, duplicates and hash sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which kind of set speaks for a file that several sets know.
PRECEDENCE = ("known_bad", "notable", "known_good")
ALGORITHMS = ("md5", "sha1", "sha256")


def digests(files: DataFrame) -> DataFrame:
    """(node, md5, sha1, sha256, read_bytes) of (node, content)."""
    return files.select("node", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("read_bytes"))


def _several(rows: DataFrame) -> DataFrame:
    """Digests that two evidence items hold: two partial counts, so a common digest never meets in one task."""
    known = rows.where(F.col("digest").isNotNull() & (F.col("digest") != ""))
    return known.groupBy("digest").agg(F.min("evidence").alias("least"), F.max("evidence").alias("most")).where("least < most").select("digest")


def in_several(rows: DataFrame) -> DataFrame:
    return rows.join(_several(rows), "digest", "left_semi").select("node", "evidence", "digest")


def duplicates(rows: DataFrame) -> DataFrame:
    """(digest, items, files, first): groups whose files are in two or more evidence items, the largest first (equal
    sizes by digest). Their files are the rows of ``in_several``, so that no digest's files meet in one row."""
    return in_several(rows).groupBy("digest").agg(F.count_distinct("evidence").alias("items"), F.count("*").alias("files"), F.min("node").alias("first")).orderBy(F.desc("files"), "digest")


def unpivot(hashed: DataFrame) -> DataFrame:
    return hashed.select("node", F.inline(F.array(*(F.struct(F.lit(a).alias("algo"), F.col(a).alias("digest")) for a in ALGORITHMS if a in hashed.columns)))).where("digest is not null")


def matches(hashed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, algo, digest, set_name, kind): a digest counts only under its own algorithm. The planner broadcasts the
    sets where their size allows and shuffles otherwise."""
    return unpivot(hashed).join(sets, ["algo", "digest"]).select("node", "algo", "digest", "set_name", "kind")


def best_match(hashed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, match_kind, sets) of every file: the kind that takes precedence, and all sets that know it."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("kind"))
    found = matches(hashed, sets).groupBy("node").agg(F.min_by("kind", rank).alias("match_kind"), F.sort_array(F.collect_set("set_name")).alias("sets"))
    return hashed.select("node").join(found, "node", "left").select("node", "match_kind", F.coalesce("sets", F.array().cast("array<string>")).alias("sets"))


def read_hash_list(lines: DataFrame) -> DataFrame:
    """(algo, digest) of a text column ``value``: any run of 32, 40 or 64 hex digits; each once."""
    runs = F.regexp_extract_all(F.lower("value"), F.lit(r"(?<![0-9a-f])([0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9a-f])"), F.lit(1))
    found = lines.select(F.explode(runs).alias("digest"))
    algo = F.when(F.length("digest") == 64, "sha256").when(F.length("digest") == 40, "sha1").otherwise("md5")
    return found.select(algo.alias("algo"), "digest").distinct()
