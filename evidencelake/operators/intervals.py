"""Interval algebra over (volume, start, end), half open: merge, complement, points, next start, carved hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.session import dealt

#: Width of the cells through which points and intervals meet.
CELL = 1 << 16


def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals; what touches is one. A window for each volume: gaps and islands.

    Volumes are dealt to more tasks as there are more rows, so a task's memory doesn't grow with the table.
    """
    rows = dealt(rows.select(*keys, "start", "end"), *keys)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order)
    return rows.withColumn("reach", reach).withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(merged: DataFrame, sizes: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Gaps of at least ``least`` between merged intervals, from 0 to each volume's ``size``."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("start")), F.lit(0))
    inner = merged.withColumn("gap", before).select(*keys, F.col("gap").alias("start"), F.col("start").alias("end"))
    tail = sizes.join(merged.groupBy(*keys).agg(F.max("end").alias("last")), keys, "left").select(*keys, F.coalesce("last", F.lit(0)).alias("start"), F.col("size").alias("end"))
    return inner.unionByName(tail).where(F.col("end") - F.col("start") >= least)


def covered(points: DataFrame, merged: DataFrame, keys: list[str], cell: int = CELL, rows: int | None = None) -> DataFrame:
    """``points`` (pos) with ``inside``: start <= pos < end of some merged interval.

    Both sides go by cells of the axis, so the join is an equality; as merged intervals are disjoint, a point
    meets one at most. They are dealt to tasks by ``rows`` of both sides, if given, else by those of the points.
    """
    cells = merged.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)))).where("end > start")
    at = dealt(points.withColumn("cell", F.floor(F.col("pos") / cell)), *keys, "cell", count=rows)
    same = [at[k] == cells[k] for k in [*keys, "cell"]]
    both = at.join(cells, [*same, at["pos"] >= cells["start"], at["pos"] < cells["end"]], "left")
    return both.select(*(at[c] for c in points.columns), cells["start"].isNotNull().alias("inside"))


def next_start(points: DataFrame, merged: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """``points`` (pos) with the first interval start beyond: an as-of join by one sort of both sides together.

    Volumes are dealt to tasks by ``rows`` of both sides, if given, else by those of the points."""
    pos = points.select(*keys, F.col("pos").alias("at"), F.lit(0).alias("side"), F.struct(*points.columns).alias("row"))
    begin = merged.select(*keys, F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(pos.schema["row"].dataType).alias("row"))
    # at one place a start comes before the points there, as only later starts count
    after = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("side").asc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("side") == 1, F.col("at")), ignorenulls=True).over(after)
    both = dealt(pos.unionByName(begin), *keys, count=points.count() if rows is None else rows)
    return both.withColumn("next_start", seen).where("side = 0").select("row.*", "next_start")


def drop_contained(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Carved hits that no earlier bounded hit strictly contains: a running maximum of (end, -start)."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "id").rowsBetween(Window.unboundedPreceding, -1)
    m = F.max(F.when(F.col("bounded"), F.struct(F.col("end").alias("end"), (-F.col("start")).alias("neg")))).over(order)
    kept = hits.withColumn("m", m)
    inside = (F.col("m.end") > F.col("end")) | ((F.col("m.end") == F.col("end")) & (-F.col("m.neg") < F.col("start")))
    return kept.where(~F.coalesce(inside, F.lit(False))).drop("m")


def consecutive(rows: DataFrame, keys: list[str], seq: str, first: str) -> DataFrame:
    """The rows of the unbroken run of ``seq`` that begins at each group's ``first``."""
    order = Window.partitionBy(*keys).orderBy(seq)
    return rows.where(F.col(seq) >= F.col(first)).withColumn("r", F.row_number().over(order)).where(F.col(seq) - F.col("r") + 1 == F.col(first)).drop("r")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each group, in order, until their sizes pass the budget."""
    total = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).where(F.col("running") <= budget)
