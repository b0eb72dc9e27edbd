"""The Spark session that the library's queries expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task, where what it holds grows with its rows.
TASK_ROWS = 1 << 18


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName("evidencelake")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(rows: int, spark: SparkSession) -> int:
    """Tasks that ``rows`` are dealt to: as many more as there are more rows, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(rows: DataFrame, *keys: str, count: int | None = None) -> DataFrame:
    """``rows`` in ``parts`` by ``keys``, or by turns. Adaptive execution merges the partitions of its own shuffles to tasks of so many
    bytes or one a core, whose memory then grows with the input; a number that is given stays.

    The rows are counted for that, unless ``count`` is given: of a Parquet table by its footers alone.
    """
    return rows.repartition(parts(rows.count() if count is None else count, rows.sparkSession), *keys)


def shared(spark: SparkSession) -> None:
    """Makes sure that checkpoints have the folder that all executors share; only in local mode is one made up."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
