"""Queries over entries, digests and file types, bound to the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import scalars
from evidencelake.operators import entries, filetype, hashes
from evidencelake.plans.registry import query

_TREE = """
tree AS (
  SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name, true AS is_dir, false AS deleted FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, true, false FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, true, c_acctbal < 0 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority || '.' || o_orderstatus, false, o_orderstatus = 'P' FROM orders
)"""


def tree(t):
    row = lambda *c: [F.concat(F.lit(c[0]), c[1]).alias("node"), (F.concat(F.lit(c[2]), c[3]) if c[2] else F.lit(None).cast("string")).alias("parent"), c[4].alias("name"), F.lit(c[5]).alias("is_dir"), c[6].alias("deleted")]
    col, no = F.col, F.lit(False)
    return (
        t("region").select(*row("r", col("r_regionkey").cast("string"), "", None, col("r_name"), True, no))
        .unionByName(t("nation").select(*row("n", col("n_nationkey").cast("string"), "r", col("n_regionkey").cast("string"), col("n_name"), True, no)))
        .unionByName(t("customer").select(*row("c", col("c_custkey").cast("string"), "n", col("c_nationkey").cast("string"), col("c_name"), True, col("c_acctbal") < 0)))
        .unionByName(t("orders").select(*row("o", col("o_orderkey").cast("string"), "c", col("o_custkey").cast("string"), F.concat_ws(".", "o_orderpriority", "o_orderstatus"), False, col("o_orderstatus") == "P")))
    )


def _walk_sql(enter: str, tail: str) -> str:
    return f"""WITH RECURSIVE {_TREE}, w AS (
      SELECT node, '/' || name AS path, 1 AS depth, is_dir, deleted FROM tree WHERE parent IS NULL
      UNION ALL SELECT e.node, w.path || '/' || e.name, w.depth + 1, e.is_dir, e.deleted
      FROM w JOIN tree e ON e.parent = w.node WHERE w.is_dir AND w.depth < 64 {enter}
    ) {tail}"""


@query(_walk_sql("", "SELECT node, path, depth, is_dir, deleted FROM w"))
def walk_entries(t):
    return entries.walk(tree(t))


@query(_walk_sql("AND NOT w.deleted", "SELECT depth, count(*) AS n, count(*) FILTER (WHERE deleted) AS deleted FROM w GROUP BY depth"))
def walk_live(t):
    return entries.walk(tree(t), descend_deleted=False).groupBy("depth").agg(F.count("*").alias("n"), F.count_if("deleted").alias("deleted"))


@query(_walk_sql("", """SELECT count(*) FILTER (WHERE regexp_matches(path, '/1-[^/]*$')) AS urgent_files, count(DISTINCT CASE WHEN regexp_matches(path, '/1-[^/]*$') THEN regexp_replace(path, '/[^/]*$', '') END) AS urgent_folders FROM w"""))
def presence(t):
    return entries.presence(entries.walk(tree(t)), {"urgent": "/1-[^/]*$"})


_PART = """files AS (SELECT p_partkey AS node, p_name || '.' || lower(p_type) AS name, p_size AS size, p_size % 7 = 0 AS deleted, p_size % 11 = 0 AS is_dir, strftime(DATE '2020-01-01' + p_size::INT, '%Y-%m-%d') AS modified FROM part)"""


def part_files(t):
    return t("part").select(
        F.col("p_partkey").alias("node"), F.concat(F.col("p_name"), F.lit("."), F.lower("p_type")).alias("name"), F.col("p_size").alias("size"),
        (F.col("p_size") % 7 == 0).alias("deleted"), (F.col("p_size") % 11 == 0).alias("is_dir"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("modified"),
    )


@query(f"""WITH {_PART} SELECT node, name, size, modified FROM files WHERE contains(lower(name), 'red') AND regexp_extract(lower(name), '\\.([^.]*)$', 1) IN ('economy', 'promo')
  AND size BETWEEN 5 AND 40 AND NOT deleted AND NOT is_dir AND modified >= '2020-01-10' AND modified <= '2020-02-05T23:59:59Z'""")
def filter_entries(t):
    keep = entries.matches("RED", ["economy", ".promo"], 5, 40, hide_deleted=True, files_only=True, modified_after="2020-01-10", modified_before="2020-02-05T23:59:59Z")
    return part_files(t).where(keep).select("node", "name", "size", "modified")


@query(f"""WITH {_PART}, top AS (SELECT * FROM files ORDER BY is_dir DESC, lower(name), node LIMIT 200)
  SELECT row_number() OVER (ORDER BY is_dir DESC, lower(name), node)::INT AS place, node, name, is_dir FROM top""")
def sort_entries(t):
    """A page of a listing; only its 200 rows are numbered."""
    from pyspark.sql import Window

    page = part_files(t).orderBy(*entries.listing_order()).limit(200)
    return page.select(F.row_number().over(Window.orderBy(*entries.listing_order())).alias("place"), "node", "name", "is_dir")


@query(f"""WITH {_PART} SELECT regexp_extract(lower(name), '\\.([^.]*)$', 1) AS extension, count(*) AS n, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE is_dir) AS dirs, sum(size)::BIGINT AS bytes FROM files GROUP BY 1""")
def listing_counters(t):
    return part_files(t).groupBy(entries.search_extension(F.col("name")).alias("extension")).agg(
        F.count("*").alias("n"), F.count_if("deleted").alias("deleted"), F.count_if("is_dir").alias("dirs"), F.sum("size").cast("long").alias("bytes")
    )


@query("""WITH w AS (SELECT lower(p_name) || CASE WHEN p_size = 7 THEN ' old' ELSE '' END AS path, p_partkey % 50 AS node FROM part),
  e AS (SELECT lower(p_name) AS path, count(*) AS n, min(p_partkey) AS any_node FROM part GROUP BY 1), x AS (SELECT DISTINCT lower(p_name) AS path, p_partkey AS node FROM part)
  SELECT w.path, w.node, CASE WHEN x.node IS NOT NULL THEN w.node WHEN e.n = 1 THEN e.any_node END AS resolved,
  CASE WHEN x.node IS NOT NULL OR e.n = 1 THEN 'found' WHEN e.n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status
  FROM (SELECT DISTINCT * FROM w) w LEFT JOIN e ON w.path = e.path LEFT JOIN x ON w.path = x.path AND w.node = x.node""")
def resolve_paths(t):
    """The names of all parts against all parts; those of one size carry an ending that no part has."""
    p = t("part")
    wanted = p.select(F.concat(F.lower("p_name"), F.when(F.col("p_size") == 7, " old").otherwise("")).alias("path"), (F.col("p_partkey") % 50).alias("node"))
    return entries.resolve(wanted, p.select(F.col("p_name").alias("path"), F.col("p_partkey").alias("node")))


@query("SELECT doc_id AS node, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS read_bytes FROM documents")
def hash_files(t):
    return hashes.digests(t("documents").select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("content")))


_DIGEST = "d AS (SELECT doc_id AS node, source AS evidence, sha256(text) AS digest FROM documents)"


@query(f"""WITH {_DIGEST}, g AS (SELECT digest, count(DISTINCT evidence) AS items, count(*) AS files, min(node) AS first FROM d WHERE digest <> '' GROUP BY digest HAVING count(DISTINCT evidence) > 1)
  SELECT * FROM g""")
def duplicate_files(t):
    rows = t("documents").select(F.col("doc_id").alias("node"), F.col("source").alias("evidence"), F.sha2("text", 256).alias("digest"))
    return hashes.duplicates(rows)


@query(f"""WITH {_DIGEST}, m AS (SELECT digest FROM d GROUP BY digest HAVING count(DISTINCT evidence) > 1) SELECT d.node, d.evidence, d.digest FROM d SEMI JOIN m USING (digest)""")
def duplicate_rows(t):
    return hashes.in_several(t("documents").select(F.col("doc_id").alias("node"), F.col("source").alias("evidence"), F.sha2("text", 256).alias("digest")))


_SETS = """sets AS (
  SELECT 'sha256' AS algo, sha256(text) AS digest, 'toxic' AS set_name, 'known_bad' AS kind FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION SELECT 'md5', md5(text), 'quality', 'known_good' FROM documents JOIN labels USING (doc_id) WHERE quality = 1
  UNION SELECT 'sha1', sha1(text), 'benchmark', 'notable' FROM benchmark)"""


def _sets(t):
    labelled = t("documents").select("doc_id", "text").join(t("labels"), "doc_id")
    made = lambda df, algo, digest, name, kind: df.select(F.lit(algo).alias("algo"), digest.alias("digest"), F.lit(name).alias("set_name"), F.lit(kind).alias("kind"))
    return (
        made(labelled.where("toxic = 1"), "sha256", F.sha2("text", 256), "toxic", "known_bad")
        .unionByName(made(labelled.where("quality = 1"), "md5", F.md5("text"), "quality", "known_good"))
        .unionByName(made(t("benchmark"), "sha1", F.sha1("text"), "benchmark", "notable")).distinct()
    )


_LONG = "long AS (SELECT doc_id AS node, unnest(['md5', 'sha1', 'sha256']) AS algo, unnest([md5(text), sha1(text), sha256(text)]) AS digest FROM documents)"


@query(f"WITH {_SETS}, {_LONG} SELECT set_name, kind, algo, count(*) AS files, count(DISTINCT digest) AS digests FROM long JOIN sets USING (algo, digest) GROUP BY ALL")
def hash_set_match(t):
    digests = hashes.digests(t("documents").select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("content")))
    return hashes.matches(digests, _sets(t)).groupBy("set_name", "kind", "algo").agg(F.count("*").alias("files"), F.count_distinct("digest").alias("digests"))


@query(f"""WITH {_SETS}, {_LONG}, m AS (SELECT node, kind, set_name FROM long JOIN sets USING (algo, digest))
  SELECT d.doc_id AS node, CASE min(CASE kind WHEN 'known_bad' THEN 0 WHEN 'notable' THEN 1 WHEN 'known_good' THEN 2 END) WHEN 0 THEN 'known_bad' WHEN 1 THEN 'notable' WHEN 2 THEN 'known_good' END AS match_kind,
  coalesce(array_to_string(list_sort(list(DISTINCT set_name) FILTER (set_name IS NOT NULL)), ','), '') AS sets FROM documents d LEFT JOIN m ON m.node = d.doc_id GROUP BY 1""")
def match_kind(t):
    digests = hashes.digests(t("documents").select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("content")))
    return hashes.best_match(digests, _sets(t)).withColumn("sets", F.array_join("sets", ","))


@query("""WITH d AS (SELECT doc_id, source || doc_id AS name, sha256(text) AS digest FROM documents)
  SELECT doc_id, CASE WHEN regexp_matches(name, '^[=+@\\t\\r-]') THEN '''' || name ELSE name END AS name, CASE WHEN doc_id % 3 = 0 THEN '''=' || digest ELSE digest END AS digest FROM d""")
def export_manifest(t):
    d = t("documents").select("doc_id", F.concat("source", F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("digest"))
    d = d.withColumn("digest", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "digest")).otherwise(F.col("digest")))
    return d.select("doc_id", scalars.csv_guard(F.col("name")).alias("name"), scalars.csv_guard(F.col("digest")).alias("digest"))


_TYPED = """f AS (SELECT page_id AS node, 'p' || page_id || CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.xyz' END AS name, html AS head FROM pages
  UNION ALL SELECT -1, 'a.gif', 'GIF89a..' UNION ALL SELECT -2, 'a.pdf', '%PDF-1.7' UNION ALL SELECT -3, 'a.pdf', 'GIF89a..' UNION ALL SELECT -4, 'a.txt', '' UNION ALL SELECT -5, 'b.rtf', '{\\rtf1 a')"""


def _typed(t):
    ext = F.when(F.col("page_id") % 5 == 0, ".html").when(F.col("page_id") % 5 == 1, ".png").when(F.col("page_id") % 5 == 2, ".txt").when(F.col("page_id") % 5 == 3, "").otherwise(".xyz")
    pages = t("pages").select(F.col("page_id").alias("node"), F.concat(F.lit("p"), F.col("page_id").cast("string"), ext).alias("name"), F.col("html").alias("head"))
    more = t.spark.createDataFrame([(-1, "a.gif", "GIF89a.."), (-2, "a.pdf", "%PDF-1.7"), (-3, "a.pdf", "GIF89a.."), (-4, "a.txt", ""), (-5, "b.rtf", "{\\rtf1 a")], "node long, name string, head string")
    return pages.unionByName(more).withColumn("head", F.col("head").cast("binary"))


_VERDICT = f"""WITH {_TYPED}, x AS (SELECT *, nullif(lower(regexp_extract(name, '^.+\\.([^.]{{1,12}})$', 1)), '') AS extension,
    CASE WHEN head LIKE 'GIF89a%' OR head LIKE 'GIF87a%' THEN 'gif' WHEN head LIKE '%PDF-%' AND head LIKE '\\%PDF-%' ESCAPE '\\' THEN 'pdf' WHEN head LIKE '{{\\rtf%' THEN 'rtf'
      WHEN lower(head) LIKE '<!doctype html%' OR lower(head) LIKE '<html%' THEN 'html' END AS detected FROM f),
  v AS (SELECT *, CASE WHEN head = '' THEN 'empty' WHEN extension IS NULL THEN 'no extension' WHEN extension NOT IN ('gif', 'pdf', 'rtf', 'html', 'png', 'txt') THEN 'unknown extension'
      WHEN detected IS NULL AND extension = 'txt' THEN 'no signature' WHEN detected = extension THEN 'match' WHEN extension = 'txt' AND detected IN ('html', 'rtf') THEN 'match' ELSE 'mismatch' END AS verdict FROM x)"""


@query(_VERDICT + " SELECT node, name, extension, detected, verdict FROM v")
def filetype_verify(t):
    return filetype.verify(_typed(t)).select("node", "name", "extension", "detected", "verdict")


@query(_VERDICT + " SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def filetype_census(t):
    return filetype.verify(_typed(t)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(_VERDICT + """, m AS (SELECT * FROM v WHERE verdict = 'mismatch'), r AS (SELECT node, name, detected, row_number() OVER (ORDER BY CASE WHEN detected IN ('html', 'rtf') THEN 1 ELSE 0 END, name, node)::INT AS place FROM m) SELECT * FROM r WHERE place <= 100""")
def mismatch_order(t):
    return filetype.ordered_mismatches(filetype.verify(_typed(t)), 100)
