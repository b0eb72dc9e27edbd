"""Sinks: exported files with digests, manifests, a timeline store, and a report."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.scalars import csv_guard


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (path, content) below ``folder``; (path, target, size, md5, sha1, sha256) of each. A path can't leave it."""
    uri = folder if "://" in folder else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".", "..")]
                target = "/".join([base, *(p.replace(":", "_").replace("\0", "_") for p in parts)])
                where.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(target, compression=None) as out:
                    out.write(content or b"")
                data = content or b""
                rows.append((path, target, len(data), hashlib.md5(data).hexdigest(), hashlib.sha1(data).hexdigest(), hashlib.sha256(data).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "target", "size", "md5", "sha1", "sha256"])

    return files.select("path", "content").mapInArrow(run, "path string, target string, size long, md5 string, sha1 string, sha256 string")


def write_manifest(rows: DataFrame, folder: str) -> None:
    """As CSV, guarded against spreadsheets, and as JSON."""
    guarded = rows.select(*(csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    guarded.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    rows.write.mode("overwrite").json(f"{folder}/json")


def write_timeline(events: DataFrame, folder: str) -> None:
    """Events by evidence and part, sorted within files, so that a page reads few row groups."""
    events.repartitionByRange("ev", "part", "sort").sortWithinPartitions("ev", "part", "sort", "path", "action").write.mode("overwrite").partitionBy("ev", "part").parquet(folder)


def report(title: str, tables: dict[str, DataFrame], most: int = 500) -> str:
    """One HTML page; of each table the first ``most`` rows, and how many more there are."""
    out = [f"<!DOCTYPE html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in df.columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{escape(str(v)) if v is not None else str()}</td>' for v in r)}</tr>" for r in rows[:most]]
        out.append("</table>" + (f"<p>{df.count() - most} more rows are not shown.</p>" if len(rows) > most else ""))
    return "\n".join(out)
