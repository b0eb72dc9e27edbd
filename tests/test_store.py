"""The case store and the sinks."""

import json

from pyspark.sql import functions as F

from evidencelake.sources import sinks
from evidencelake.sources.store import SCHEMAS, Case


def test_case(spark, tmp_path):
    case = Case.create(spark, str(tmp_path / "case"), "one", "ann")
    made = lambda name, rows, cols: spark.createDataFrame(rows, ", ".join(c for c in SCHEMAS[name].split(", ") if c.split()[0] in cols))
    case.append("evidence", made("evidence", [(1, "a"), (2, "b")], {"id", "path"}))
    hashes = lambda rows: made("file_hashes", rows, {"evidence_id", "part", "node", "path", "md5"})
    case.upsert("file_hashes", hashes([(1, 0, "5", "old", "x"), (2, 0, "5", "p", "y")]))
    case.upsert("file_hashes", hashes([(1, 0, "5", "new", "z"), (1, 0, "6", "q", "w")]))
    assert {(r.evidence_id, r.node, r.path, r.md5) for r in case.table("file_hashes").collect()} == {(1, "5", "old", "z"), (2, "5", "p", "y"), (1, "6", "q", "w")}
    assert case.holdings(1) == {"file_hashes": 2}
    case.save_artefact(1, 0, "usn", 2, json.dumps({"a": 1}))
    assert case.artefacts({"usn": 2}).count() == 1 and case.artefacts({"usn": 3}).count() == 0
    case.remove_evidence(1)
    assert case.table("file_hashes").count() == 1 and case.table("artefacts").count() == 0 and case.table("evidence").count() == 1
    case.log("looked", {"at": 1})
    assert case.verify_audit() == (True, None)
    rows = case.table("audit").withColumn("action", F.when(F.col("seq") == 2, "other").otherwise(F.col("action")))
    case._put("audit", rows, False)
    assert case.verify_audit() == (False, 2)
    assert case.vacuum() > 0 and case.table("audit").count() == 3


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("/a/b.txt", bytearray(b"hello")), ("../../up.txt", bytearray(b"x"))], "path string, content binary")
    rows = {r.path: r for r in sinks.export_files(files, str(tmp_path / "out")).collect()}
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"hello" and (tmp_path / "out/up.txt").exists()
    assert rows["/a/b.txt"].md5 == "5d41402abc4b2a76b9719d911017c592"
    sinks.write_manifest(spark.createDataFrame([("=1+1", 2)], "name string, n int"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m/csv")).first().name == "'=1+1"
    page = sinks.report("R <1>", {"t": spark.range(5).toDF("n")}, 3)
    assert "R &lt;1&gt;" in page and "2 more rows" in page
