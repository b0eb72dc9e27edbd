"""Queries over an examiner's views, bound to orders as items, line items as hits, suppliers as volumes, events as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.operators import casework, intervals
from evidencelake.plans.ranges import _IV, _MERGED, _PT, _intervals, _points
from evidencelake.plans.registry import query


def _when(condition: str, value):
    return F.when(F.expr(condition), value)


@query("""WITH k AS (SELECT o_orderkey AS node, o_orderstatus = 'F' AS bad, o_custkey % 5 = 0 AS notable, o_orderkey % 2 = 0 AS good FROM orders)
  SELECT l_orderkey AS node, l_linenumber AS line, CASE WHEN bad THEN 'known_bad' WHEN notable THEN 'notable' WHEN good THEN 'known_good' END AS match_kind,
    nullif(concat_ws(',', CASE WHEN bad THEN 'known_bad' END, CASE WHEN good THEN 'known_good' END, CASE WHEN notable THEN 'notable' END), '') AS matches FROM lineitem LEFT JOIN k ON node = l_orderkey""")
def hit_matches(t):
    kinds = F.array(_when("o_orderstatus = 'F'", "known_bad"), _when("o_custkey % 5 = 0", "notable"), _when("o_orderkey % 2 = 0", "known_good"))
    matches = t("orders").select(F.col("o_orderkey").alias("node"), F.explode(F.array_compact(kinds)).alias("kind"))
    hits = t("lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("line"))
    return casework.annotate_hits(hits, matches, ["node"]).withColumn("matches", F.array_join("matches", ","))


@query("""WITH c AS (SELECT user_id AS id, arg_max('u' || event_id, event_id) AS url FROM events GROUP BY user_id) SELECT c_custkey AS id, c_name AS target, url FROM customer LEFT JOIN c ON id = c_custkey""")
def download_urls(t):
    chains = t("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("position"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"))
    return casework.download_urls(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("target")), chains)


@query("SELECT e.props AS target, p.url, p.page_id AS started_at FROM events e LEFT JOIN pages p ON p.page_id = e.user_id WHERE e.event_type = 'click'")
def place_downloads(t):
    notes = t("events").select(F.col("event_type").alias("attribute_id"), F.col("user_id").alias("place_id"), F.col("props").alias("content"))
    attributes = t("events").select(F.col("event_type").alias("id")).distinct().withColumn("name", F.when(F.col("id") == "click", "downloads/destinationFileURI").otherwise("other"))
    return casework.place_downloads(notes, attributes, t("pages").select(F.col("page_id").alias("id"), "url", F.col("page_id").alias("last_visit")))


@query("""WITH f AS (SELECT nullif(s_nationkey % 5, 0) AS ev, nullif(s_suppkey % 20, 0) AS node, min(s_suppkey) AS id, arg_min(s_name, s_suppkey) AS marks FROM supplier GROUP BY 1, 2),
  c AS (SELECT c_custkey, nullif(c_nationkey % 5, 0) AS ev, nullif(c_custkey % 20, 0) AS node FROM customer) SELECT c.*, f.id, f.marks FROM c LEFT JOIN f ON c.ev IS NOT DISTINCT FROM f.ev AND c.node IS NOT DISTINCT FROM f.node""")
def flag_lookup(t):
    own = lambda nation, key: (F.nullif(F.col(nation) % 5, F.lit(0)).alias("ev"), F.nullif(F.col(key) % 20, F.lit(0)).alias("node"))
    flags = t("supplier").select(*own("s_nationkey", "s_suppkey"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("marks"))
    return casework.flag_of(t("customer").select("c_custkey", *own("c_nationkey", "c_custkey")), flags, ["ev", "node"], "id")


@query(f"""WITH {_IV}, {_MERGED}, {_PT}, g AS (SELECT id, pt.v, pos AS lo, pos + 3000 AS hi, count(*) AS n, min(m.start) AS start, max(m."end") AS "end" FROM pt JOIN merged m ON m.v = pt.v AND m.start > pos AND m.start < pos + 3000 GROUP BY ALL)
  SELECT id, v, lo, hi, start, "end" FROM g WHERE n = 1 AND "end" < hi""")
def single_gap(t):
    ranges = _points(t).select("id", "v", F.col("pos").alias("lo"), (F.col("pos") + 3000).alias("hi"))
    return casework.single_gap(ranges, intervals.merge(_intervals(t), ["v"]), ["v"])


@query(f"""WITH {_PT}, r AS (SELECT s_suppkey AS v, unnest(range(6)) * 100000 AS lo FROM supplier) SELECT id, pt.v, pos AS "offset", lo, pos - lo AS relative FROM pt JOIN r ON r.v = pt.v AND lo <= pos AND pos < lo + 95000""")
def marks_in_region(t):
    regions = t("supplier").select(F.col("s_suppkey").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select("v", (F.col("k") * 100000).cast("long").alias("lo"), (F.col("k") * 100000 + 95000).cast("long").alias("hi"))
    return casework.in_region(_points(t).withColumnRenamed("pos", "offset"), regions, ["v"])


@query(f"""WITH {_IV}, {_MERGED}, {_PT} SELECT id, pt.v, pos, 'f' || start AS field FROM pt JOIN merged m ON m.v = pt.v AND start <= pos AND pos < "end" """)
def field_at(t):
    fields = intervals.merge(_intervals(t), ["v"]).withColumn("field", F.concat(F.lit("f"), F.col("start").cast("string")))
    return casework.field_at(_points(t), fields, ["v"])


@query("""WITH r AS (SELECT user_id AS ev, event_id % 2 AS part, CASE WHEN event_id % 3 = 0 THEN 'pp' || event_id % 4 ELSE 'n' || event_id % 7 END AS item, event_type AS tag, min(event_id) AS seq FROM events GROUP BY ALL)
  SELECT ev, part, item, string_agg(tag, ', ' ORDER BY seq) AS tags FROM r GROUP BY ev, part, item""")
def tagged_items(t):
    node, path = _when("event_id % 3 <> 0", F.col("event_id") % 7), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))
    return casework.tagged_items(t("events").select(F.col("user_id").alias("ev"), (F.col("event_id") % 2).alias("part"), node.alias("node"), path.alias("path"), F.col("event_type").alias("tag"), F.col("event_id").alias("seq")))


@query("""WITH e AS (SELECT o_orderpriority AS run, o_orderkey AS part, unnest([1, 2]) AS pos, unnest(['a' || o_orderkey, 'b' || o_custkey]) AS example FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY part, pos) AS r FROM e),
  l AS (SELECT run, string_agg(example, ',' ORDER BY r) AS partial_examples FROM x WHERE r <= 12 GROUP BY run)
  SELECT o_orderpriority AS run, sum(o_custkey)::BIGINT AS entries, sum(o_orderkey)::BIGINT AS bytes_read, bool_or(o_totalprice > 400000) AS truncated, any_value(partial_examples) AS partial_examples FROM orders JOIN l ON run = o_orderpriority GROUP BY o_orderpriority""")
def merge_search(t):
    said = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = t("orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("part"), F.col("o_custkey").alias("entries"), F.col("o_orderkey").alias("bytes_read"), (F.col("o_totalprice") > 400000).alias("truncated"), F.array(said("a", "o_orderkey"), said("b", "o_custkey")).alias("partial_examples"))
    return casework.merge_results(parts, ["run"], ["entries", "bytes_read"], ["truncated"]).withColumn("partial_examples", F.array_join("partial_examples", ","))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN s WHEN 1 THEN s * 1024 WHEN 2 THEN s * 1048576 WHEN 3 THEN s * 1073741824 + 536870912 END AS size FROM (SELECT p_partkey, p_size::BIGINT AS s FROM part)""")
def client_sizes(t):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("k"))).when(k == 2, F.concat(F.lit(" "), n, F.lit("MB"))).when(k == 3, F.concat(n, F.lit(".5 gB "))).otherwise(F.concat(n, F.lit("xb")))
    return t("part").select(F.col("p_partkey").alias("id"), casework.size_of(text).alias("size"))


_ARTEFACTS = [("mft", "NTFS"), ("registry", "Windows volume"), ("names", "filesystem walk"), ("carving", "image")]


@query("""WITH v AS (SELECT c_custkey % 40 AS ev, CASE c_custkey % 40 % 4 WHEN 0 THEN CASE WHEN c_custkey % 80 < 40 THEN 'NTFS' ELSE 'FAT32' END WHEN 1 THEN 'ext4' END AS detected FROM customer),
  h AS (SELECT ev, coalesce(bool_or(detected = 'NTFS'), false) AS ntfs, bool_or(detected IS NOT NULL) AS fs FROM v GROUP BY ev), a AS (SELECT ev, ntfs, fs, unnest(['mft', 'registry', 'names', 'carving']) AS artefact FROM h),
  b AS (SELECT ev, artefact, CASE WHEN artefact = 'mft' AND NOT ntfs THEN 'no NTFS volume' WHEN artefact = 'registry' AND NOT ntfs THEN 'no Windows volume' WHEN artefact = 'names' AND NOT fs THEN 'no readable file system' END AS because FROM a)
  SELECT ev, artefact, because IS NULL AS available, because FROM b""")
def artefacts_available(t):
    ev = F.col("c_custkey") % 40
    detected = F.when(ev % 4 == 0, F.when(F.col("c_custkey") % 80 < 40, "NTFS").otherwise("FAT32")).when(ev % 4 == 1, "ext4")
    return casework.available(t("customer").select(ev.alias("ev"), detected.alias("detected")), _ARTEFACTS)


@query("SELECT page_id AS node, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'svg' WHEN 3 THEN 'html' WHEN 4 THEN 'svg' END AS kind, CASE page_id % 5 WHEN 2 THEN 'image/gif' ELSE 'application/octet-stream' END AS media FROM pages")
def markup_kind(t):
    """Pages as they are, drawings, images that hold a page, and fragments that only the name tells."""
    k = F.col("page_id") % 5
    html = F.col("html").cast("binary")
    of = lambda s: F.encode(F.lit(s), "utf-8")
    data = F.when(k == 0, html).when(k == 1, F.concat(of("\n \t<SVG>"), html)).when(k == 2, F.concat(of("GIF89a"), F.encode("url", "utf-8"))).otherwise(F.concat(of("<p>"), F.encode("url", "utf-8")))
    name = F.when(k == 3, "a.HTM").when(k == 4, "b.svg").otherwise("c")
    return t("pages").select(F.col("page_id").alias("node"), casework.markup_kind(data, name).alias("kind"), casework.media_type(data).alias("media"))


@query("""WITH b AS (SELECT doc_id AS node, regexp_extract_all(substr(CASE WHEN doc_id % 3 = 0 THEN '610000' WHEN doc_id % 3 = 1 THEN '6100' ELSE '' END || hex(encode(text)), 1, 8192), '..') AS x FROM documents)
  SELECT node, len(x) > 0 AND node % 3 <> 0 AND len(list_filter(x, lambda y: y BETWEEN '20' AND '7E' OR y BETWEEN '09' AND '0D')) > len(x) * 0.92 AS textual FROM b""")
def looks_textual(t):
    head = F.unhex(F.when(F.col("doc_id") % 3 == 0, "610000").when(F.col("doc_id") % 3 == 1, "6100").otherwise(""))
    return t("documents").select(F.col("doc_id").alias("node"), casework.looks_textual(F.concat(head, F.col("text").cast("binary"))).alias("textual"))


@query("SELECT p_partkey AS node, p_size >= 26 AND p_partkey % 60 IN (12, 16, 40, 52, 56) AS bitmap, p_size % 2 = 0 OR p_size > 40 AND p_partkey % 2 = 0 AS program FROM part")
def plausible_headers(t):
    """Bitmap and program headers written with the sizes and places of parts."""
    word = lambda c: F.concat(*(F.substring(F.lpad(F.hex(c), 8, "0"), i, 2) for i in (7, 5, 3, 1)))
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    bitmap = F.unhex(F.concat(F.lit("424D"), word(size), F.lit("00000000" * 2), word(key % 60)))
    # even sizes: the mark stands where it should; odd ones over 40 point outside, every second of them with the message
    far = (size % 2 == 1) & (size > 40)
    at = F.when(far, 9000).otherwise(size + 64)
    message = F.when(far & (key % 2 == 0), F.hex(F.lit("This program cannot be run in DOS mode"))).otherwise("")
    mark = F.concat(F.repeat(F.lit("00"), size.cast("int")), F.when(size % 2 == 0, "50450000").otherwise("4E450000"))
    program = F.unhex(F.concat(F.lit("4D5A"), F.repeat(F.lit("00"), F.lit(58)), word(at.cast("long")), mark, message))
    return t("part").select(key.alias("node"), casework.bitmap_plausible(bitmap).alias("bitmap"), casework.program_plausible(program).alias("program"))


@query("""WITH s AS (SELECT p_partkey AS seq, p_brand AS ext, p_name AS name, p_type AS head, p_size % 7 AS k FROM part)
  SELECT ext, arg_min(name, seq) AS name, md5(string_agg(head, ',' ORDER BY seq)) AS headers, CASE max(CASE WHEN k < 5 THEN 0 WHEN k = 5 THEN 1 ELSE 2 END) WHEN 0 THEN 'estimate' WHEN 1 THEN 'footer' ELSE 'structure' END AS length FROM s GROUP BY ext""")
def carve_catalogue(t):
    k = F.col("p_size") % 7
    signatures = t("part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("ext"), F.col("p_name").alias("name"), F.col("p_type").alias("head"), F.when(k < 5, "estimate").when(k == 5, "footer").otherwise("structure").alias("how"))
    return casework.carve_catalogue(signatures).withColumn("headers", F.md5(F.array_join("headers", ",")))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 20000")
def newest_artefacts(t):
    return casework.newest(t("events").select("event_id", "ts", "event_type"), "ts", "event_id")


@query("""WITH h AS (SELECT CASE WHEN contains(url, '.com') THEN 'com' ELSE 'other' END AS product, url, page_id AS "at", page_id % 3 = 0 AS deleted FROM pages), d AS (SELECT lang AS product, source AS url, doc_id AS "at" FROM documents),
  k AS (SELECT 'Downloads' AS kind, * FROM d UNION ALL SELECT 'Recovered', product, url, "at" FROM h WHERE deleted UNION ALL SELECT 'History', product, url, "at" FROM h WHERE NOT deleted UNION ALL SELECT 'entries', product, url, "at" FROM h UNION ALL SELECT 'entries', * FROM d)
  SELECT kind, product, count(*) AS n, count(DISTINCT url) AS urls, max("at") AS last FROM k GROUP BY kind, product""")
def browser_slice(t):
    product = F.when(F.contains("url", F.lit(".com")), "com").otherwise("other")
    history = t("pages").select(product.alias("product"), "url", F.col("page_id").alias("at"), (F.col("page_id") % 3 == 0).alias("deleted"))
    downloads = t("documents").select(F.col("lang").alias("product"), F.col("source").alias("url"), F.col("doc_id").alias("at"))
    kinds = [casework.browser_slice(history, downloads, k).withColumn("kind", F.lit(k or "entries")) for k in ("Downloads", "Recovered", "History", None)]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    return rows.groupBy("kind", "product").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.max("at").alias("last"))


@query("""SELECT (SELECT count(*) FROM lineitem) AS checked, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS mismatches, (SELECT count(*) FROM lineitem WHERE l_discount > 0.05) AS high,
  (SELECT count(*) FROM orders) AS indexed, (SELECT count(*) FROM events) AS documents, (SELECT count(*) FROM events WHERE event_type = 'error') AS skipped""")
def volume_totals(t):
    """Totals of a type scan, of file indexes and of raw regions, from one row for each volume."""
    scans = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("checked"), F.count_if(F.col("l_returnflag") == "R").alias("mismatches"), F.count_if(F.col("l_discount") > 0.05).alias("high")).drop("l_suppkey")
    indexes = t("orders").groupBy("o_custkey").agg(F.count("*").alias("indexed")).drop("o_custkey")
    regions = t("events").groupBy("user_id").agg(F.count("*").alias("documents"), F.count_if(F.col("event_type") == "error").alias("skipped")).drop("user_id")
    return casework.totals(scans, indexes, regions)


@query("""SELECT o_custkey AS "user", 'h' || o_custkey % 7 AS hive, o_orderkey AS path, o_orderdate AS last_opened FROM orders""")
def folder_entries(t):
    """Folders that each user opened, newest first."""
    entry = F.struct(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("last_opened"))
    users = t("orders").groupBy(F.col("o_custkey").alias("user")).agg(F.collect_list(entry).alias("entries")).withColumn("source", F.concat(F.lit("h"), (F.col("user") % 7).cast("string")))
    return casework.folder_entries(users).orderBy(F.desc_nulls_last("last_opened"), "path")


_MARK = "m AS (SELECT l.doc_id, CASE d.lang WHEN 'en' THEN 'person' WHEN 'de' THEN '' WHEN 'fr' THEN NULL ELSE 'place' END AS category, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN false END AS in_report FROM labels l JOIN documents d USING (doc_id))"


@query(f"WITH {_MARK} SELECT 'none' AS view, doc_id FROM m WHERE coalesce(category, '') = '' UNION ALL SELECT 'person', doc_id FROM m WHERE category = 'person' UNION ALL SELECT 'reported', doc_id FROM m WHERE coalesce(in_report, false) UNION ALL SELECT 'others', doc_id FROM m WHERE category = 'place' AND NOT coalesce(in_report, false)")
def marks_filtered(t):
    lang = F.col("lang")
    category = F.when(lang == "en", "person").when(lang == "de", "").when(lang != "fr", "place")
    marks = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("doc_id", category.alias("category"), _when("quality = 1", True).when(F.col("toxic") == 1, False).alias("in_report"))
    views = {"none": {"uncategorised": True}, "person": {"category": "person"}, "reported": {"in_report": True}, "others": {"category": "place", "in_report": False}}
    rows = [casework.marks_of(marks, **kept).select(F.lit(view).alias("view"), "doc_id") for view, kept in views.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT l_suppkey AS evidence_id, l_linenumber AS part, l_orderkey AS node FROM lineitem WHERE l_suppkey = 7 AND l_linenumber = 2")
def evidence_scope(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("evidence_id"), F.col("l_linenumber").alias("part"), F.col("l_orderkey").alias("node"))
    return casework.scoped(rows, 7, 2)
