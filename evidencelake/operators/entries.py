"""Directory entries: walks, filters, listing order, presence, extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.session import shared


def walk(entries: DataFrame, max_depth: int = 64, descend_deleted: bool = True) -> DataFrame:
    """(node, path, depth, is_dir, deleted) of all that the roots (null parent) lead to.

    Each entry knows the way to its parent; joined with its parent's way, it knows the way to the one before, so
    ways double in length and ``max_depth`` levels take log2 of it joins. Only entries that have not reached a root are
    joined again. A folder listed several times is entered by one of its places, a root first, and folders in
    a cycle reach no root: they end with no row instead of being walked again and again. Without ``descend_deleted``
    deleted folders are listed but not entered. Each round is checkpointed in the shared folder.
    """
    spark = entries.sparkSession
    shared(spark)
    way = entries.select("node", "is_dir", "deleted", F.col("parent").alias("top"), F.concat(F.lit("/"), F.col("name")).alias("path"), F.lit(1).alias("depth"), F.lit(False).alias("barred"))
    place = F.struct(F.col("top").isNotNull(), "top", "path")
    way = way.withColumn("first", F.row_number().over(Window.partitionBy("node").orderBy(place)) == 1).checkpoint()
    for _ in range(max(1, (max_depth - 1).bit_length())):
        waiting = way.where(F.col("top").isNotNull() & (F.col("depth") < max_depth))
        if waiting.isEmpty():
            break
        up = way.where(F.col("first") & F.col("is_dir")).select(
            F.col("node").alias("top"), F.col("top").alias("up"), F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), (F.col("barred") | (F.lit(not descend_deleted) & F.col("deleted"))).alias("up_barred"))
        longer = waiting.join(up, "top").select("node", "is_dir", "deleted", F.col("up").alias("top"), F.concat("up_path", "path").alias("path"), (F.col("depth") + F.col("up_depth")).alias("depth"), (F.col("barred") | F.col("up_barred")).alias("barred"), "first")
        way = way.where(F.col("top").isNull()).unionByName(longer.where((F.col("depth") <= max_depth) & ~F.col("barred"))).checkpoint()
    return way.where(F.col("top").isNull()).select("node", "path", "depth", "is_dir", "deleted")


def search_extension(name: Column) -> Column:
    """After the last dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def type_extension(name: Column) -> Column:
    """As type verification takes it: the dot may not lead, and at most 12 characters follow; else null."""
    found = F.regexp_extract(name, r"^.+\.([^.]{1,12})$", 1)
    return F.lower(F.nullif(found, F.lit("")))


def matches(
    name: str | None = None, extensions: list[str] | None = None, min_size: int | None = None, max_size: int | None = None,
    deleted_only: bool = False, hide_deleted: bool = False, files_only: bool = False, **bounds: str,
) -> Column:
    """One conjunction, so that all of it can reach the scan. ``bounds``: ``modified_after="2020-01-01"`` and the like,
    compared as the ISO text that the columns hold; a null date fails."""
    kept = F.lit(True)
    if name:
        kept &= F.contains(F.lower("name"), F.lit(name.lower()))
    if extensions:
        kept &= search_extension(F.col("name")).isin([e.lower().lstrip(".") for e in extensions])
    if min_size is not None:
        kept &= F.col("size") >= min_size
    if max_size is not None:
        kept &= F.col("size") <= max_size
    if deleted_only:
        kept &= F.col("deleted")
    if hide_deleted:
        kept &= ~F.col("deleted")
    if files_only:
        kept &= ~F.col("is_dir")
    for bound, value in bounds.items():
        column, side = bound.rsplit("_", 1)
        kept &= F.coalesce(F.col(column) >= value if side == "after" else F.col(column) <= value, F.lit(False))
    return kept


def listing_order(by: str = "name", descending: bool = False, dirs_first: bool = True) -> list[Column]:
    key = F.lower(by) if by in ("name", "path") else F.col(by)
    own = [key.desc() if descending else key.asc(), F.col("node").asc()]
    return [F.col("is_dir").desc(), *own] if dirs_first else own


# Places of artefacts on a Windows volume.
PRESENCE = {
    "recyclebin": r"(?i)^/\$recycle\.bin/[^/]+/\$i", "prefetch": r"(?i)^/windows/prefetch/[^/]+\.pf$",
    "browser": r"(?i)/(history|places\.sqlite)$", "usn": r"(?i)^/\$extend/\$usnjrnl$",
}


def presence(entries: DataFrame, patterns: dict[str, str] = PRESENCE) -> DataFrame:
    """One row: of each kind how many files and how many distinct folders; a single pass."""
    found = [F.count_if(F.col("path").rlike(p)).alias(f"{k}_files") for k, p in patterns.items()]
    found += [F.count_distinct(F.when(F.col("path").rlike(p), F.regexp_replace("path", r"/[^/]*$", ""))).alias(f"{k}_folders") for k, p in patterns.items()]
    return entries.agg(*found)


def resolve(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """``wanted`` (path, node), each once, with status found / ambiguous / not_found: by path, the node breaking ties.

    Entries are counted by path before the join, so a path that many entries share is one row."""
    by_path = entries.groupBy(F.lower("path").alias("p")).agg(F.count("node").alias("n"), F.min("node").alias("any_node"))
    exact = entries.select(F.lower("path").alias("q"), F.col("node").alias("exact")).distinct()
    asked = wanted.select("path", "node").distinct().withColumn("low", F.lower("path"))
    both = asked.join(by_path, F.col("low") == F.col("p"), "left").join(exact, (F.col("low") == F.col("q")) & (F.col("node") == F.col("exact")), "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("exact").isNotNull() | (n == 1), "found").when(n > 1, "ambiguous").otherwise("not_found")
    return both.select("path", "node", F.when(F.col("exact").isNotNull(), F.col("node")).when(n == 1, F.col("any_node")).alias("resolved"), status.alias("status"))
