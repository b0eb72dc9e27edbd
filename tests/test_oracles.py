"""Every query with SQL gives what DuckDB gives on the same tables; the others run and have a stable schema."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from evidencelake import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    number = lambda f: f.apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    assert rows(number(ours)) == rows(number(theirs))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert glob.glob(f"{SF}/*.parquet")


@pytest.mark.parametrize("repeated", [False, True])
def test_byte_profiles_of_odd_rows(spark, tmp_path, repeated):
    """Texts that are empty, null, without an id, of zeros, at a rounding tie; with ``repeated``, ids that several rows share."""
    tie = "".join(chr(97 + i) * n for i, n in enumerate([128, 64, 32, 16, 8, 4, 2, 2]))
    texts = [(1, "ab"), (2, ""), (3, None), (None, "lost"), (4, "\0\0\0"), (5, "\0" * 19 + "a"), (6, tie), (7, "é" * 40), (8, "plain text"), (9, "\x01\x02")]
    texts += [(1, "cd"), (2, "x"), (3, "y" * 9), (8, ""), (8, None), (6, tie), (9, "written")] * repeated
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("entropy", "classify_region"):
        ours, theirs = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
        assert rows(ours) == rows(theirs[ours.columns.tolist()])
