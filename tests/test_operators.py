"""Operators against published values and plain loops."""

import random

from pyspark.sql import functions as F

from evidencelake.functions import markup, scalars, wallets
from evidencelake.operators import case, entries, hashes, intervals, profile, search, timeline


def test_fuzzy_hash_published():
    for data, expected in ((b"", "3::"), (b"a", "3:E:E"), (b"hello world", "3:iKFSMPn:rJPn"), (b"x" * 1000, "3:H:H"), (b"ab" * 5000, "3:uy:uy")):
        assert profile.fuzzy_hash(data) == expected


def test_fuzzy_compare(spark):
    rnd = random.Random(3)
    base = bytes(rnd.randrange(256) for _ in range(8000))
    near = base[:2600] + bytes(rnd.randrange(256) for _ in range(900)) + base[3500:]
    df = spark.createDataFrame([(profile.fuzzy_hash(base), profile.fuzzy_hash(near)), (profile.fuzzy_hash(base), profile.fuzzy_hash(base[::-1])), ("3::", "3::")], "a string, b string")
    got = [r[0] for r in df.select(profile.fuzzy_compare(F.col("a"), F.col("b"))).collect()]
    assert 60 < got[0] < 100 and got[1] == 0 and got[2] == 100


def test_similar_files(spark):
    rows = [(1, "96:ABCDEFGHIJKLMN:ABCDEFG", "x"), (2, "96:ABCDEFGHIJKLMO:ABCDEFG", "y"), (3, "96:ABCDEFGHIJKLMN:ABCDEFG", "x"), (4, "96:zzyyxxwwvvuutt:zyxwvut", "z"), (5, None, "n")]
    got = {(r.a, r.b) for r in profile.similar_files(spark.createDataFrame(rows, "node long, fuzzy string, sha256 string")).collect()}
    assert got == {(1, 2), (2, 3)}


def test_addresses():
    assert wallets.verify("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2") == ("p2pkh", False)
    assert wallets.verify("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3") is None
    assert wallets.verify("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4") == ("bech32", False)
    assert wallets.bech32("abcdef1l7aum6echk45nj3s0wdvt2fg8x9yrzpqzd3ryx") == "bech32m"


def test_mnemonic_checksum():
    listed = {w: i for i, w in enumerate(["abandon", "ability", "able", "about"])}
    words = ["x", *["abandon"] * 11, "about", "y"]
    assert wallets.mnemonic_runs(words, listed) == [(1, 12, True)]


def test_markup():
    assert markup.visible_text("<style>a</style><p>Hello <b>you</b></p><script>x</script>") == "Hello you"
    assert markup.visible_text("<html><head><title>t</title><body><p>Hello world</p>") == "t\nHello world"
    assert markup.sanitise("a<form>b<iframe>c") == ("abc", {"form": 1, "iframe": 1})
    html, removed = markup.sanitise('<p onclick="x()">a<iframe src="http://b">c</iframe><img src="https://e/t.png"><a href="#k">d</a></p>')
    assert "onclick" not in html and "iframe" not in html and "https" not in html and 'href="#k"' in html
    assert removed == {"event handler": 1, "iframe": 1, "remote address": 1}


def test_intervals_loop(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), s, s + rnd.randrange(1, 300)) for s in (rnd.randrange(20000) for _ in range(400))]
    df = spark.createDataFrame(rows, "v long, start long, end long")
    merged = intervals.merge(df, ["v"])
    inside = {(v, p) for v, s, e in rows for p in range(s, e)}
    points = spark.createDataFrame([(v, p) for v in range(3) for p in range(0, 20000, 7)], "v long, pos long")
    got = {(r.v, r.pos) for r in intervals.covered(points, merged, ["v"], 64).where("inside").collect()}
    assert got == {(v, p) for v in range(3) for p in range(0, 20000, 7) if (v, p) in inside}
    starts = sorted((r.v, r.start) for r in merged.collect())
    for r in intervals.next_start(points, merged, ["v"]).collect():
        assert r.next_start == min((s for v, s in starts if v == r.v and s > r.pos), default=None)
    free = {(r.v, p) for r in intervals.complement(merged, spark.createDataFrame([(v, 21000) for v in range(3)], "v long, size long"), ["v"]).collect() for p in range(r.start, r.end)}
    assert not free & inside and len(free | inside) == 63000


def test_contained_hits(spark):
    rows = [("a", 1, 0, 100, True), ("a", 2, 10, 90, False), ("a", 3, 0, 100, True), ("a", 4, 50, 150, False), ("a", 5, 60, 140, False), ("a", 6, 100, 120, True)]
    got = {r.id for r in intervals.drop_contained(spark.createDataFrame(rows, "v string, id long, start long, end long, bounded boolean"), ["v"]).collect()}
    assert got == {1, 3, 4, 5, 6}


def test_duplicates(spark):
    rows = [(1, "A", "x"), (2, "B", "x"), (3, "A", "y"), (4, "A", "y"), (5, "A", None), (6, "B", None), (7, "A", ""), (8, "B", ""), (9, "C", "x")]
    got = [(r.digest, r.items, r.files, r.first) for r in hashes.duplicates(spark.createDataFrame(rows, "node long, evidence string, digest string")).collect()]
    assert got == [("x", 3, 3, 1)]


def test_precedence_and_algorithm(spark):
    hashed = spark.createDataFrame([(1, "m", "s", "t"), (2, "t", "x", "y")], "node long, md5 string, sha1 string, sha256 string")
    sets = spark.createDataFrame([("md5", "m", "good", "known_good"), ("sha256", "t", "bad", "known_bad")], "algo string, digest string, set_name string, kind string")
    got = {r.node: (r.match_kind, r.sets) for r in hashes.best_match(hashed, sets).collect()}
    assert got == {1: ("known_bad", ["bad", "good"]), 2: (None, [])}


def test_upsert_columns(spark):
    old = spark.createDataFrame([(1, "p", "d"), (None, "n", "d")], "k long, path string, digest string")
    new = spark.createDataFrame([(1, "P", "D"), (2, "q", "e"), (None, "m", "f")], "k long, path string, digest string")
    got = sorted((str(r.k), r.path, r.digest) for r in case.upsert(old, new, ["k"], ["digest"]).collect())
    assert got == [("1", "p", "D"), ("2", "q", "e"), ("None", "m", "f"), ("None", "n", "d")]


def test_timeline(spark):
    e = spark.createDataFrame([(1, "2020-01-01T00:00:00Z", None, "2020-01-02T00:00:00"), (2, None, None, None)], "node long, created string, modified string, accessed string")
    assert {(r.node, r.action, r.sort) for r in timeline.events(e).collect()} == {(1, "created", 1577836800.0), (1, "accessed", 1577923200.0)}
    empty = spark.createDataFrame([], "sort double, flagged boolean")
    assert timeline.histogram(empty).count() == 0
    tail = spark.createDataFrame([(float(i), False) for i in range(6000, 8000)] + [(0.0, True), (9e8, True)], "sort double, flagged boolean")
    bars = timeline.histogram(tail, 10).collect()
    assert sum(r.n for r in bars) == 2000 and len(bars) <= 10


def test_literal_search(spark):
    df = spark.createDataFrame([(1, "aXaxaXa . " * 12), (2, ""), (3, None)], "node long, text string")
    rows = search.search_content(df, ["xa", "."]).collect()
    assert [r.position for r in rows if r.term == "xa"][:3] == [2, 4, 6]
    assert sum(r.term == "xa" for r in rows) == 20 and [r.more_in_file for r in rows if r.term == "xa"][-1] == 16
    assert sum(r.term == "." for r in rows) == 12


def test_raw_windows_meet(spark):
    body = "x" * 4090 + "needle" + "y" * 9000 + "needle"
    windows = search.chunks(spark.createDataFrame([(1, body)], "source long, body string"))
    assert sorted(r.offset for r in search.raw_hits(windows, "needle").collect()) == [4090, 13096]


def test_extensions(spark):
    df = spark.createDataFrame([("a.TXT",), (".profile",), ("b",), ("c.tar.gz",), ("d.",)], "name string")
    got = df.select(entries.search_extension(F.col("name")), entries.type_extension(F.col("name"))).collect()
    assert [tuple(r) for r in got] == [("txt", "txt"), ("profile", None), ("", None), ("gz", "gz"), ("", None)]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert str(get(scalars.dos(F.lit((43 << 25) | (11 << 21) | (5 << 16) | (8 << 11) | (30 << 5) | 22)))) == "2023-11-05 08:30:44"
    assert get(scalars.filetime(F.lit(0).cast("long"))) is None
    assert get(scalars.iso(scalars.filetime(F.lit(132223104000000000)))) == "2020-01-01T00:00:00Z"
    assert get(scalars.rot13(F.lit("Uryyb"))) == "Hello" and get(scalars.reverse_host(F.lit("moc.elpmaxe."))) == "example.com"
    assert get(scalars.flag_names(F.lit(5), {1: "a", 2: "b", 4: "c"})) == ["a", "c"]
    assert str(get(scalars.nth_weekday(F.lit(2024), 3, "SUN", 2))) == "2024-03-10" and str(get(scalars.nth_weekday(F.lit(2024), 10, "SUN", -1))) == "2024-10-27"


def test_quantile(spark):
    from evidencelake.operators.volumes import quantile

    rnd = random.Random(8)
    values = sorted(rnd.choice([1.0, 2.0, rnd.random() * 5]) for _ in range(5000))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for share in (0.0, 0.1, 0.5, 0.77, 1.0):
        assert quantile(df, "x", share, 100).first()[0] == values[max(0, -(-int(share * 5000) // 1) - 1)]


def test_registry_report(spark):
    from evidencelake.operators import volumes

    rows = [("ROOT/Software/Microsoft/Windows/CurrentVersion/Run", "app", "a.exe"), ("X/Explorer/UserAssist/{1}/Count", "Uryyb", "01"), ("Y/other", "n", "v")]
    got = {(r.section, r.name) for r in volumes.registry_report(spark.createDataFrame(rows, "path string, name string, value string")).collect()}
    assert got == {("run", "app"), ("user assist", "Hello")}
    bags = spark.createDataFrame([(1, None, "Desktop"), (2, 1, "C:"), (3, 2, "x")], "node long, parent long, name string")
    assert {r.path for r in volumes.shellbag_paths(bags).collect()} == {"Desktop", "Desktop\\C:", "Desktop\\C:\\x"}


WALK = "node string, parent string, name string, is_dir boolean, deleted boolean"


def test_walk_of_a_deep_tree_with_cycles(spark):
    rows = [(str(i), str(i - 1) if i else None, f"d{i}", True, i == 50) for i in range(70)]
    rows += [("x", "y", "x", True, False), ("y", "x", "y", True, False), ("0", "9", "again", True, False), ("f", "3", "f", False, False), ("g", "f", "under a file", False, False)]
    df = spark.createDataFrame(rows, WALK)
    got = {(r.node, r.depth): r.path for r in entries.walk(df).collect()}
    for i in range(64):
        assert got[str(i), i + 1] == "/" + "/".join(f"d{k}" for k in range(i + 1))
    assert got["0", 11] == got["9", 10] + "/again" and got["f", 5].endswith("/d3/f") and len(got) == 66
    live = {r.node for r in entries.walk(df, descend_deleted=False).collect()}
    assert live == {str(i) for i in range(51)} | {"f"} and entries.walk(df.limit(0)).count() == 0


def test_resolve(spark):
    have = spark.createDataFrame([("/A", 1), ("/a", 2), ("/b", 3), ("/b", 3)], "path string, node long")
    wanted = spark.createDataFrame([("/a", 2), ("/A", 9), ("/b", 7), ("/c", 1), ("/c", 1), (None, 1)], "path string, node long")
    got = sorted((str(r.path), r.node, r.resolved, r.status) for r in entries.resolve(wanted, have).collect())
    assert got == [("/A", 9, None, "ambiguous"), ("/a", 2, 2, "found"), ("/b", 7, None, "ambiguous"), ("/c", 1, None, "not_found"), ("None", 1, None, "not_found")]


def test_tokens_of_other_scripts(spark):
    df = spark.createDataFrame([("Élan vital — naïve Straße, привет 日本 x2 e\u0301t\u00e9",)], "t string")
    found = df.select(search.tokens(F.col("t"))).first()[0]
    assert found == ["elan", "vital", "naive", "straße", "привет", "日本", "x2", "ete"] and search.token("Naïve!") == "naive"


def test_second_granularity_needs_both_times(spark):
    df = spark.createDataFrame([(0, 0, 5, 0), (0, 1, 5, 0), (0, 0, 0, 7), (0, 0, 0, 0), (3, 0, 5, 5)], "a long, b long, c long, d long")
    at = [F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col(c)) for c in "abcd"]
    got = [any(x.kind == "second_granularity" for x in r[0]) for r in df.select(timeline.anomalies(*at)).collect()]
    assert got == [True, False, True, False, False]


def test_fuzzy_hash_is_the_loop_and_fast():
    import time

    def loop(data, block):
        window, total, weighted, shifted, one, two, first, second = [0] * 7, 0, 0, 0, 0x28021967, 0x28021967, "", ""
        for i, byte in enumerate(data):
            weighted, total = weighted - total + 7 * byte, total + byte - window[i % 7]
            window[i % 7], shifted = byte, ((shifted << 5) ^ byte) & 0xFFFFFFFF
            rolled = (total + weighted + shifted) & 0xFFFFFFFF
            one, two = ((h * 0x01000193 & 0xFFFFFFFF) ^ byte for h in (one, two))
            if rolled % block == block - 1:
                if len(first) < 63:
                    first, one = first + profile.LETTERS[one & 63], 0x28021967
                if rolled % (2 * block) == 2 * block - 1 and len(second) < 31:
                    second, two = second + profile.LETTERS[two & 63], 0x28021967
        return (first + profile.LETTERS[one & 63], second + profile.LETTERS[two & 63]) if data and rolled else (first, second)

    rnd = random.Random(9)
    kinds = [range(256), b"ab ", [0], [255], range(4), range(97, 123)]
    kept = profile.SEGMENT
    try:
        for profile.SEGMENT in (kept, 64, 17):
            for n in (0, 1, 6, 7, 8, 191, 192, 193, 700, 5000):
                for kind in kinds:
                    data = bytes(rnd.choice(kind) for _ in range(n)) + bytes(rnd.choice([0, 0, 9]))
                    block, first, second = profile.fuzzy_hash(data).split(":")
                    assert (first, second) == loop(data, int(block))
    finally:
        profile.SEGMENT = kept
    data = bytes(rnd.randrange(256) for _ in range(300_000))
    start = time.process_time()
    block = int(profile.fuzzy_hash(data).split(":")[0])
    middle = time.process_time()
    loop(data, block)
    assert middle - start < (time.process_time() - middle) / 2


def test_similar_files_of_crowds(spark):
    """The first pairs are those of all pairs, also where short signatures are equal, rows repeat and one edit or a crowd is all that there is."""
    rnd = random.Random(4)
    base = "".join(rnd.sample(profile.LETTERS, 50))

    def edited(s):
        i = rnd.randrange(len(s))
        return rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice(profile.LETTERS) + s[i + rnd.randrange(2) :], s])

    signatures = [(rnd.choice([96, 96, 192, 3]), edited(edited(base[: rnd.choice([31, 32, 33, 50])])), edited(base[: rnd.choice([6, 31, 33])])) for _ in range(60)] + [(48, "H" + "3" * 30 + "kg", "h")] * 2
    rows = [(rnd.randrange(1000), f"{b}:{x}:{y}", f"{i:03}") for i, (b, x, y) in enumerate(signatures) for _ in range(rnd.choice([1, 1, 1, 3]))]
    df = spark.createDataFrame(rows + rows[:9], "node long, fuzzy string, sha256 string")
    once = sorted(set(rows))
    pairs = spark.createDataFrame([(*sorted((x[0], y[0])), x[1], y[1]) for i, x in enumerate(once) for y in once[i + 1 :] if x[2] != y[2]], "a long, b long, x string, y string")
    scored = pairs.select((-profile.fuzzy_compare(F.col("x"), F.col("y"))).alias("s"), "a", "b").where("s <= -60").collect()
    expected = [(a, b, -s) for s, a, b in sorted(map(tuple, scored))]
    full = sum(s == 100 for _, _, s in expected)
    assert 40 < full < len(expected)
    got = lambda limit: [tuple(r) for r in profile.similar_files(df, 60, limit).collect()]
    assert sorted(got(None), key=lambda r: (-r[2], *r)) == expected
    for limit in (1, 7, 40, full, full + 5):
        assert got(limit) == expected[:limit]
    assert profile._alike(df.distinct(), 10 * full).count() == full


def test_tasks_grow_with_the_items(spark, monkeypatch):
    """Times of entries are joined in tasks of a bounded number of rows."""
    from evidencelake import catalogue, session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    assert catalogue.QUERIES["timestamp_anomalies"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 100


def test_tasks_grow_with_the_intervals(spark, monkeypatch):
    """Volumes are dealt to tasks of a bounded number of rows, however few bytes they have."""
    from evidencelake import session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    df = spark.range(2000).select((F.col("id") % 500).alias("v"), (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 30).alias("end"))
    merged = intervals.merge(df, ["v"])
    assert merged.rdd.getNumPartitions() >= 40 and merged.count() == 2000
    points = spark.range(2000).select((F.col("id") % 500).alias("v"), (F.col("id") * 40 + 1).alias("pos"))
    inside = intervals.covered(points, merged, ["v"])
    assert inside.rdd.getNumPartitions() >= 40 and inside.where("inside").count() == 2000
    after = intervals.next_start(points, merged, ["v"])
    assert after.rdd.getNumPartitions() >= 40 and after.where("next_start is null").count() == 500


def test_fuzzy_compare_uses_all_cores(spark):
    from evidencelake import catalogue

    assert catalogue.QUERIES["fuzzy_compare"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
