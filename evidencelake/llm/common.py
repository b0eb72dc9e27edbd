"""What the training-data operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Arrow batches stay small, so that a Python worker's memory doesn't grow with the row count or the text length.
ARROW_ROWS, ARROW_BYTES = "2000", "4194304"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[tuple]], out_rows: int = 20_000) -> DataFrame:
    """``rows`` gets dicts of one task's input in order and yields tuples; both sides stream."""
    arrow_limits(df.sparkSession)
    struct = T._parse_datatype_string(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[dict]:
            for batch in batches:
                names = batch.schema.names
                for values in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                    yield dict(zip(names, values, strict=True))

        held: list[tuple] = []
        size = 0
        for row in rows(source()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) >= out_rows or size > 8_000_000:
                yield packed(held, target)
                held, size = [], 0
        if held:
            yield packed(held, target)

    return df.mapInArrow(run, struct)


def packed(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only in local mode, as in tests, where the session names none, one is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, and no copy that only one executor has."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dealt_by_size(spark: SparkSession, rows: int, each: int = 100_000, least: int = 8) -> Iterator[None]:
    """Within it, shuffles have a partition for each ``each`` of ``rows``, for tables whose size has just been counted."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(least, -(-rows // each))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled training documents.

    The sample is bounded whatever the size of the tables: ids are ordered by a hash, so it is the same each time.
    Only its ids are broadcast. A label that is null or whose document is held out is never used; of several
    labels for one document the largest counts.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """A value that lives as long as the Python worker: functions and their globals arrive anew with each task."""
    kept = sys.modules.setdefault("_evidencelake_kept", types.ModuleType("_evidencelake_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def keep_rows(docs: DataFrame, keeps: Callable[[str], bool]) -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) passes; whole batches go by, whatever columns there are."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keeps(x.as_py() or "") for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
