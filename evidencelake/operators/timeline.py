"""Timeline: events of entries, anomalies, minute rollup, histogram, keyset pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Time columns of an entry and the action that each stands for.
FIELDS = (
    "created", "modified", "accessed", "changed", "mft_modified", "deleted_at", "added", "fn_created", "fn_modified", "fn_accessed", "fn_mft_modified",
)


def events(entries: DataFrame, include_accessed: bool = True, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row for each time that an entry has: its other columns, action, time (as recorded) and sort (seconds).

    A time without a zone is sorted as if UTC. Bounds of a build are inclusive on both sides.
    """
    names = [f for f in FIELDS if f in entries.columns and (include_accessed or f != "accessed")]
    pairs = F.filter(F.array(*(F.struct(F.lit(f).alias("action"), F.col(f).cast("string").alias("time")) for f in names)), lambda p: p["time"].isNotNull())
    rest = [c for c in entries.columns if c not in FIELDS]
    df = entries.select(*rest, F.inline(pairs)).withColumn("sort", F.unix_micros(F.try_to_timestamp("time")) / 1e6)
    if start:
        df = df.where(F.col("time") >= start)
    return df.where(F.col("time") <= end) if end else df


def anomalies(created: Column, modified: Column, fn_created: Column, fn_modified: Column) -> Column:
    """Array of (kind, severity): what a set clock leaves behind. Both times on a whole second, while one of the file
    name's is not, is one such trace."""
    part = lambda c: F.unix_micros(c) % 1_000_000
    whole = (part(created) == 0) & (part(modified) == 0) & (F.coalesce(part(fn_created) != 0, F.lit(False)) | F.coalesce(part(fn_modified) != 0, F.lit(False)))
    found = [("si_before_fn", "high", created < fn_created), ("created_after_modified", "low", created > modified), ("second_granularity", "medium", whole)]
    return F.filter(F.array(*(F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, test in found)), lambda x: x.isNotNull())


def minutes(rows: DataFrame) -> DataFrame:
    """(m, n, f): events and flagged events of each minute; ``sort`` in seconds."""
    return rows.groupBy(F.floor(F.col("sort") / 60).alias("m")).agg(F.count("*").alias("n"), F.count_if("flagged").alias("f"))


def bounds(rollup: DataFrame, rows: DataFrame, bins: int, start: float | None = None, end: float | None = None) -> tuple[float, float, float, int, bool]:
    """(lo, hi, width, n, trimmed) of the bars: a few numbers, the only ones that the driver needs.

    Without a range given, a thousandth of the events at either end is left off if that halves the span at least.
    Bars of a minute or more are whole minutes.
    """
    first, last, total = rollup.agg(F.min("m"), F.max("m"), F.sum("n")).first()
    if first is None:
        return 0.0, 0.0, 0.0, 0, False
    bins = max(1, min(1000, bins))
    full = (60.0 * first, 60.0 * (last + 1))
    lo, hi, trimmed = start if start is not None else full[0], end if end is not None else full[1], False
    k = int(total * 0.001)
    if start is None and end is None and k:
        # the k-th event from either end lies in the minute where the running count passes k: only as many minutes
        # as hold k events are sorted, a thousandth of the rollup's rows at most
        reach = lambda order: rollup.orderBy(order).limit(k + 1).select("m", "n").collect()

        def kth(found) -> int:
            seen = 0
            for m, n in found:
                seen += n
                if seen > k:
                    return m
            return found[-1][0]

        a, b = 60.0 * kth(reach(F.asc("m"))), 60.0 * (kth(reach(F.desc("m"))) + 1)
        if b - a < (full[1] - full[0]) / 2:
            lo, hi, trimmed = a, b, True
    width, n = (hi - lo) / bins, bins
    if width >= 60:
        width, lo = 60.0 * math.ceil(width / 60), 60.0 * math.floor(lo / 60)
        n = max(1, math.ceil((hi - lo) / width))
        hi = lo + n * width
    return lo, hi, width, n, trimmed


def histogram(rows: DataFrame, bins: int = 300, start: float | None = None, end: float | None = None) -> DataFrame:
    """(bar, start, n, f) of every bar, empty ones too; counted from the minute rollup where bars are whole minutes."""
    rollup = minutes(rows)
    lo, hi, width, n, _ = bounds(rollup, rows, bins, start, end)
    spark = rows.sparkSession
    bars = spark.range(n).select(F.col("id").cast("int").alias("bar"), (F.lit(lo) + F.col("id") * F.lit(width)).alias("start"))
    if not n:
        return bars.select("bar", "start", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("f"))
    if width >= 60:
        place, counted = F.col("m") * 60.0, rollup
    else:
        place, counted = F.col("sort"), rows.select("sort", F.lit(1).alias("n"), F.col("flagged").cast("int").alias("f"))
    inside = counted.where((place >= lo) & (place < hi))
    raw = F.floor((place - lo) / width)
    bar = raw + F.when(place < lo + raw * width, -1).when(place >= lo + (raw + 1) * width, 1).otherwise(0)
    found = inside.groupBy(F.greatest(F.lit(0), F.least(F.lit(n - 1), bar)).cast("int").alias("bar")).agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    return bars.join(found, "bar", "left").select("bar", "start", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("f", F.lit(0)).cast("long").alias("f"))


def page(rows: DataFrame, limit: int = 200, after: tuple | None = None, text: str | None = None, flagged: bool = False, start: float | None = None, end: float | None = None) -> DataFrame:
    """The next ``limit`` events after the key (sort, path, action, id); a filter and a top-k, no sort of the whole."""
    df = rows.withColumn("path", F.coalesce("path", F.lit("")))
    if text:
        like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        df = df.where(F.col("name").ilike(like) | F.col("path").ilike(like))
    if flagged:
        df = df.where("flagged")
    if start is not None:
        df = df.where(F.col("sort") >= start)
    if end is not None:
        df = df.where(F.col("sort") < end)
    keys = ("sort", "path", "action", "id")
    if after:
        past, same = F.lit(False), F.lit(True)
        for name, value in zip(keys, after, strict=True):
            past |= same & (F.col(name) > F.lit(value))
            same &= F.col(name) == F.lit(value)
        df = df.where((F.col("sort") >= F.lit(after[0])) & past)
    return df.orderBy(*keys).limit(max(1, min(2000, limit)))


def summary(rows: DataFrame) -> DataFrame:
    """One row: events, flagged, first and last with what they were."""
    key = F.struct("sort", "id")
    return rows.agg(F.count("*").alias("events"), F.count_if("flagged").alias("flagged"), F.min("sort").alias("first"), F.max("sort").alias("last"), F.min_by("action", key).alias("first_action"), F.max_by("action", key).alias("last_action"))
