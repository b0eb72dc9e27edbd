"""Relations over volumes: spans of one family, snapshots, structure fields, values of registry keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.scalars import rot13

# Where reports find their values: section, key, name of the value.
REPORT_VALUES = [
    ("computer", r"(?i)\\?ControlSet\d+/Control/ComputerName/ComputerName$", "ComputerName"), ("time zone", r"(?i)ControlSet\d+/Control/TimeZoneInformation$", "TimeZoneKeyName"),
    ("system", r"(?i)Microsoft/Windows NT/CurrentVersion$", "ProductName"), ("install date", r"(?i)Microsoft/Windows NT/CurrentVersion$", "InstallDate"),
    ("run", r"(?i)Microsoft/Windows/CurrentVersion/Run(Once)?$", None), ("usb", r"(?i)Enum/USBSTOR/[^/]+/[^/]+$", "FriendlyName"),
    ("user assist", r"(?i)Explorer/UserAssist/[^/]+/Count$", None), ("recent", r"(?i)Explorer/RecentDocs$", None), ("typed urls", r"(?i)Internet Explorer/TypedURLs$", None),
]


def spans(rows: DataFrame, keys: list[str], order: list[str], family: str) -> DataFrame:
    """(keys, family, first, last, n): neighbours of one family are one span, in each group by itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(family).over(w).eqNullSafe(F.col(family)), 0).otherwise(1)
    marked = rows.select(*dict.fromkeys([*keys, *order, family])).withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*keys, "island", family).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).drop("island")


def snapshots(stores: DataFrame, places: DataFrame) -> DataFrame:
    """Shadow-copy stores with where each is kept, if that is known; by GUID."""
    return stores.join(places, "guid", "left")


def quantile(rows: DataFrame, column: str, share: float, few: int = 50_000) -> DataFrame:
    """The least value at or below which ``share`` of the rows lie, exactly; a number column.

    Approximate quantiles close in on it until ``few`` rows are left between two bounds; only those are sorted.
    """
    x = F.col(column)
    band, below = rows.select(column).where(x.isNotNull()), 0
    size = band.count()
    k = max(0, math.ceil(share * size) - 1)
    while size > few:
        p = (k - below) / size
        low, high = band.approxQuantile(column, [max(0.0, p - 0.02), min(1.0, p + 0.02)], 0.005)
        under, inside = band.agg(F.count_if(x < low), F.count_if(x.between(low, high))).first()
        if low == high or not below + under <= k < below + under + inside or inside == size:
            break
        band, below, size = band.where(x.between(low, high)), below + under, inside
    return band.orderBy(column).offset(k - below).limit(1)


def overlay(data: Column, fields: list[tuple[str, int, int, str]]) -> Column:
    """Array of (name, offset, size, raw, value) of little-endian fields of binary ``data``; kinds: uint, text, hex."""

    def one(name: str, at: int, size: int, kind: str) -> Column:
        raw = F.substring(data, at + 1, size)
        if kind == "uint":
            value = F.conv(F.hex(F.concat(*(F.substring(raw, i, 1) for i in range(size, 0, -1)))), 16, 10)
        else:
            value = F.rtrim(F.decode(raw, "ISO-8859-1")) if kind == "text" else F.lower(F.hex(raw))
        return F.struct(F.lit(name).alias("name"), F.lit(at).alias("offset"), F.lit(size).alias("size"), F.lower(F.hex(raw)).alias("raw"), value.alias("value"))

    return F.array(*(one(*f) for f in fields))


def registry_report(values: DataFrame) -> DataFrame:
    """(section, path, name, value) of registry rows (path, name, value) that reports show; names of UserAssist decoded."""
    section = None
    for label, path, name in REPORT_VALUES:
        hit = F.col("path").rlike(path) & (F.col("name") == name if name else F.col("name").isNotNull())
        section = F.when(hit, label) if section is None else section.when(hit, label)
    own = F.when(F.col("section") == "user assist", rot13(F.col("name"))).otherwise(F.col("name"))
    return values.withColumn("section", section).where("section is not null").select("section", "path", own.alias("name"), "value")


def control_set(values: DataFrame) -> DataFrame:
    """The number of the control set that was in use."""
    return values.where(F.lower("path").endswith("select") & (F.lower("name") == "current")).select(F.col("value").cast("int").alias("current"))


def shellbag_paths(bags: DataFrame, depth: int = 32) -> DataFrame:
    """(node, path, depth) of (node, parent, name): names joined along the tree, ``depth`` levels at most."""
    spark = bags.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    bags.select("node", "parent", "name").createOrReplaceTempView("shellbag_input")
    return spark.sql(f"""WITH RECURSIVE w AS (SELECT node, name AS path, 1 AS depth FROM shellbag_input WHERE parent IS NULL
      UNION ALL SELECT b.node, concat(w.path, '\\\\', b.name), w.depth + 1 FROM w JOIN shellbag_input b ON b.parent = w.node WHERE w.depth < {int(depth)}) SELECT * FROM w""")
