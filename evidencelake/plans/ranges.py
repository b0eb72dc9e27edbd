"""Queries over intervals, bound to line items: a volume for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.operators import carve, intervals, volumes
from evidencelake.plans.registry import query

_IV = "iv AS (SELECT l_suppkey AS v, l_orderkey * 40 AS start, l_orderkey * 40 + l_quantity::BIGINT * 30 AS \"end\" FROM lineitem)"
_MERGED = """mw AS (SELECT *, max("end") OVER (PARTITION BY v ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
  mi AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY v ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM mw),
  merged AS (SELECT v, min(start) AS start, max("end") AS "end" FROM mi GROUP BY v, island)"""


def _intervals(t):
    start = F.col("l_orderkey") * 40
    return t("lineitem").select(F.col("l_suppkey").alias("v"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 30).alias("end"))


@query(f'WITH {_IV}, {_MERGED} SELECT v, start, "end" FROM merged')
def merge_intervals(t):
    return intervals.merge(_intervals(t), ["v"])


@query(f"""WITH {_IV}, {_MERGED}, s AS (SELECT s_suppkey AS v, (SELECT max("end") + 5000 FROM iv) AS size FROM supplier),
  g AS (SELECT v, coalesce(lag("end") OVER (PARTITION BY v ORDER BY start), 0) AS start, start AS "end" FROM merged
    UNION ALL SELECT s.v, coalesce(max(m."end"), 0), s.size FROM s LEFT JOIN merged m ON m.v = s.v GROUP BY s.v, s.size)
  SELECT v, start, "end" FROM g WHERE "end" - start >= 4000""")
def free_regions(t):
    iv = _intervals(t)
    size = iv.agg((F.max("end") + 5000).alias("size"))
    sizes = t("supplier").select(F.col("s_suppkey").alias("v")).withColumn("size", F.lit(size.first()[0]))
    return intervals.complement(intervals.merge(iv, ["v"]), sizes, ["v"], 4000)


_PT = "pt AS (SELECT o_orderkey AS id, o_custkey % 100 AS v, o_orderkey * 41 AS pos FROM orders)"


def _points(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("v"), (F.col("o_orderkey") * 41).alias("pos"))


def _rows(t):
    return t("lineitem").count() + t("orders").count()


@query(f'WITH {_IV}, {_MERGED}, {_PT} SELECT id, v, pos FROM pt WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.v = pt.v AND m.start <= pos AND pos < m."end")')
def unallocated_points(t):
    return intervals.covered(_points(t), intervals.merge(_intervals(t), ["v"]), ["v"], rows=_rows(t)).where("NOT inside").drop("inside")


@query(f"WITH {_IV}, {_MERGED}, {_PT} SELECT id, pt.v, pos, m.start AS next_start FROM pt ASOF LEFT JOIN merged m ON m.v = pt.v AND pos < m.start")
def next_interval(t):
    return intervals.next_start(_points(t), intervals.merge(_intervals(t), ["v"]), ["v"], _rows(t))


_HITS = """h AS (SELECT l_suppkey AS v, l_orderkey * 40 AS start, l_orderkey * 40 + (l_quantity * 5)::BIGINT * CASE WHEN l_linenumber % 3 = 0 THEN 20 ELSE 1 END AS "end", l_linenumber % 3 = 0 AS bounded, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_quantity, l_partkey) AS copy FROM lineitem)"""


@query(f"""WITH {_HITS}, o AS (SELECT *, max(CASE WHEN bounded THEN {{'e': "end", 'n': -start}} END) OVER (PARTITION BY v ORDER BY start, "end" DESC, id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h)
  SELECT v, count(*) AS kept, sum(start)::BIGINT AS starts, count(*) FILTER (WHERE bounded) AS bounded FROM o WHERE NOT coalesce(m.e > "end" OR (m.e = "end" AND -m.n < start), false) GROUP BY v""")
def carve_dedupe(t):
    start = F.col("l_orderkey") * 40
    long = F.when(F.col("l_linenumber") % 3 == 0, 20).otherwise(1)
    hits = t("lineitem").select(
        F.col("l_suppkey").alias("v"), start.alias("start"), (start + (F.col("l_quantity") * 5).cast("long") * long).alias("end"), (F.col("l_linenumber") % 3 == 0).alias("bounded"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    )
    kept = intervals.drop_contained(hits, ["v"])
    return kept.groupBy("v").agg(F.count("*").alias("kept"), F.sum("start").cast("long").alias("starts"), F.count_if("bounded").alias("bounded"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS v, l_orderkey AS seq FROM lineitem), f AS (SELECT *, min(seq) OVER (PARTITION BY v) AS first FROM s),
  n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY seq) AS r FROM f) SELECT v, seq FROM n WHERE seq - r + 1 = first""")
def consecutive_runs(t):
    s = t("lineitem").select(F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("seq")).distinct()
    first = s.groupBy("v").agg(F.min("seq").alias("first"))
    return intervals.consecutive(s.join(first, "v"), ["v"], "seq", "first").select("v", "seq")


@query("""WITH r AS (SELECT source, doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) SELECT * FROM r WHERE running <= 65536""")
def text_budget(t):
    """Texts of each source until 64 KiB are full: the cut-off of an index."""
    rows = t("documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return intervals.within_budget(rows, ["source"], ["doc_id"], "bytes", 65536).select("source", "doc_id", "running")


@query()
def carve_hits(t):
    """Files in a buffer of each page: its text between a GIF and a PDF."""
    gif = "474946383961" + "0100010080000000000000ffffff2c00000000010001000002024401003b"
    data = F.concat(F.unhex(F.lit(gif)), F.col("html").cast("binary"), F.encode(F.lit("%PDF-1.4 body %%EOF\n"), "utf-8"))
    return carve.hits(t("pages").select(F.col("page_id").alias("source"), F.lit(0).cast("long").alias("offset"), data.alias("data")), alignment=1)


@query("""WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, island, event_type""")
def volume_spans(t):
    return volumes.spans(t("events"), ["user_id"], ["event_id"], "event_type")


@query("SELECT quantile_disc(o_totalprice, 0.25) AS o_totalprice FROM orders")
def quantile_probe(t):
    return volumes.quantile(t("orders"), "o_totalprice", 0.25)


@query("""WITH b AS (SELECT page_id AS node, encode(substr(url, 1, 16)) AS data FROM pages)
  SELECT node, decode(data[1:4]) AS scheme, lower(hex(data[5:8])) AS mark, (ord(decode(data[9:9])) + 256 * ord(decode(data[10:10])))::VARCHAR AS number FROM b""")
def structure_fields(t):
    """Named fields at offsets, laid over the first bytes of each address."""
    data = F.encode(F.substring("url", 1, 16), "utf-8")
    laid = volumes.overlay(data, [("scheme", 0, 4, "text"), ("mark", 4, 4, "hex"), ("number", 8, 2, "uint")])
    at = lambda i: F.get(laid, F.lit(i))["value"]
    return t("pages").select(F.col("page_id").alias("node"), at(0).alias("scheme"), at(1).alias("mark"), at(2).alias("number"))
