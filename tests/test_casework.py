"""An examiner's views on small cases: nulls, ties, order, edges."""

from pyspark.sql import functions as F

from evidencelake.operators import casework


def test_sizes_and_filters(spark):
    texts = ["10mb", "1.5 k", " 7 ", "2GB", ".5k", "", "x", "1..2", "-1", None]
    got = spark.createDataFrame([(x,) for x in texts], "s string").select(casework.size_of(F.col("s")).alias("n"))
    assert [r.n for r in got.collect()] == [10 << 20, 1536, 7, 2 << 30, 512, None, None, None, None, None]
    assert casework.filters(" .JPG, png,", "1.5k", "x", before="2024-01-31", files_only=True) == {
        "extensions": ["jpg", "png"], "min_size": 1536, "modified_before": "2024-01-31T23:59:59Z", "files_only": True,
    }
    assert casework.filters() == {}


def test_null_keys_meet(spark):
    flags = spark.createDataFrame([(None, 1, 5, "b"), (None, 1, 4, "a"), (1, None, 6, "c")], "ev int, node int, id int, mark string")
    wanted = spark.createDataFrame([(None, 1), (1, None), (1, 1), (None, None)], "ev int, node int")
    got = {(r.ev, r.node): r.mark for r in casework.flag_of(wanted, flags, ["ev", "node"], "id").collect()}
    assert got == {(None, 1): "a", (1, None): "c", (1, 1): None, (None, None): None}


def test_single_gap_edges(spark):
    taken = spark.createDataFrame([(1, 10, 20), (1, 30, 40), (1, 200_000, 200_010)], "v int, start long, end long")
    ranges = spark.createDataFrame([(0, 1, 5, 25), (1, 1, 10, 25), (2, 1, 5, 20), (3, 1, 5, 35), (4, 1, 5, 30), (5, 1, 100, 300_000), (6, 1, 5, 5), (7, 2, 0, 99)], "id int, v int, lo long, hi long")
    got = {r.id: (r.start, r.end) for r in casework.single_gap(ranges, taken, ["v"]).collect()}
    assert got == {0: (10, 20), 4: (10, 20), 5: (200_000, 200_010)}


def test_tagged_and_merged(spark):
    rows = [(1, 0, 5, "a", "x", 2), (1, 0, 5, "b", "y", 1), (1, 0, 5, "a", "y", 3), (1, 0, None, "a", "z", 4)]
    got = {r.item: r.tags for r in casework.tagged_items(spark.createDataFrame(rows, "ev int, part int, node int, path string, tag string, seq int")).collect()}
    assert got == {"n5": "y, x", "pa": "z"}
    parts = spark.createDataFrame([("r", i, i, i == 3, [f"e{i}.{k}" for k in range(5)]) for i in range(5)] + [("s", 0, None, None, [])], "run string, part int, n int, cut boolean, partial_examples array<string>")
    got = {r.run: r for r in casework.merge_results(parts, ["run"], ["n"], ["cut"]).collect()}
    assert (got["r"].n, got["r"].cut, got["r"].partial_examples) == (10, True, [f"e{i}.{k}" for i in range(3) for k in range(5)][:12])
    assert (got["s"].n, got["s"].cut, got["s"].partial_examples) == (0, False, None)


def test_headers(spark):
    bmp = b"BM" + (100).to_bytes(4, "little") + bytes(4) + bytes(4) + (40).to_bytes(4, "little")
    exe = b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\0\0"
    cases = [bmp, bmp[:17], bmp[:6] + b"\1" + bmp[7:], exe, exe[:64], b"", b"a" * 92 + bytes([1]) * 8, b"a" * 93 + bytes([1]) * 7]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, d binary").orderBy("i")
    got = df.select(casework.bitmap_plausible(F.col("d")).alias("b"), casework.program_plausible(F.col("d")).alias("p"), casework.looks_textual(F.col("d")).alias("t"), casework.media_type(F.col("d")).alias("m")).collect()
    assert [r.b for r in got[:3]] == [True, False, False]
    assert [r.p for r in got[3:6]] == [True, False, False]
    assert [r.t for r in got[5:]] == [False, False, True]
    assert got[0].m == "image/bmp"
