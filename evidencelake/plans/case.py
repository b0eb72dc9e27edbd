"""Queries over case tables, bound to documents and labels as tags, parts as targets, events as journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.operators import case
from evidencelake.plans.registry import query

_TAGS = "tags AS (SELECT d.doc_id, source, lang AS tag, toxic, quality FROM documents d JOIN labels l USING (doc_id))"


def _tags(t):
    return t("documents").select("doc_id", "source", F.col("lang").alias("tag")).join(t("labels"), "doc_id")


@query(f"WITH {_TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def tag_counts(t):
    return _tags(t).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"WITH {_TAGS} SELECT count(*) AS tagged, count(DISTINCT source) AS items, count(*) FILTER (WHERE toxic = 1) AS notable, max(doc_id) AS last_id FROM tags")
def case_summary(t):
    return _tags(t).agg(F.count("*").alias("tagged"), F.count_distinct("source").alias("items"), F.count_if(F.col("toxic") == 1).alias("notable"), F.max("doc_id").alias("last_id"))


@query(f"""WITH {_TAGS}, h AS (SELECT source, 'documents' AS held, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT source, 'tags', count(*) FROM tags GROUP BY source
  UNION ALL SELECT source, 'notable', count(*) FILTER (WHERE toxic = 1) FROM tags GROUP BY source) SELECT * FROM h WHERE n > 0""")
def evidence_holdings(t):
    tags = _tags(t)
    rows = t("documents").groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("documents").alias("held"), "n")
    rows = rows.unionByName(tags.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("tags").alias("held"), "n"))
    return rows.unionByName(tags.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("n")).select("source", F.lit("notable").alias("held"), "n")).where("n > 0")


_ATT = "a AS (SELECT p_type AS tactic, p_brand AS technique, p_size % 3 = 0 AS asserted FROM part)"


def _attack(t):
    return t("part").select(F.col("p_type").alias("tactic"), F.col("p_brand").alias("technique"), (F.col("p_size") % 3 == 0).alias("asserted"))


@query(f"WITH {_ATT} SELECT tactic, technique, count(*) FILTER (WHERE asserted) AS asserted, count(*) FILTER (WHERE NOT asserted) AS proposed FROM a GROUP BY ROLLUP (tactic, technique) HAVING tactic IS NOT NULL")
def attack_summary(t):
    return case.technique_summary(_attack(t))


@query("""WITH k AS (SELECT DISTINCT event_type AS kind FROM events), c AS (SELECT DISTINCT p_type AS technique, CASE p_type WHEN 'ECONOMY' THEN 'click' WHEN 'PROMO' THEN 'error' WHEN 'STANDARD' THEN 'view' END AS kind FROM part) SELECT kind, technique FROM k JOIN c USING (kind)""")
def attack_suggest(t):
    kind = F.when(F.col("p_type") == "ECONOMY", "click").when(F.col("p_type") == "PROMO", "error").when(F.col("p_type") == "STANDARD", "view")
    offered = t("part").select(F.col("p_type").alias("technique"), kind.alias("kind")).distinct()
    return t("events").select(F.col("event_type").alias("kind")).distinct().join(offered, "kind").select("kind", "technique")


@query("SELECT 'T' || p_partkey AS technique, p_name AS name, lower(p_type) AS tactic FROM part WHERE p_size % 5 <> 0")
def attack_catalogue(t):
    """A bundle for each part; every fifth size is revoked."""
    value = F.to_json(F.struct(F.array(F.struct(
        F.lit("attack-pattern").alias("type"), F.col("p_name").alias("name"), (F.col("p_size") % 5 == 0).alias("revoked"),
        F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("external_id"))).alias("external_references"),
        F.array(F.struct(F.lower("p_type").alias("phase_name"))).alias("kill_chain_phases"),
    )).alias("objects")))
    return case.stix_techniques(t("part").select(value.alias("value")))


_CHAIN = """l AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'e' || user_id END AS examiner, event_type AS action, props AS detail FROM events)"""
_PAY = '''concat_ws('|', {p}, l.seq::VARCHAR, l."at", coalesce(l.examiner, 'None'), l.action, l.detail)'''


@query(f"""WITH RECURSIVE {_CHAIN}, c AS (SELECT l.*, '' AS prev_hash, sha256({_PAY.format(p="''")}) AS hash FROM l WHERE seq = 1
    UNION ALL SELECT l.*, c.hash, sha256({_PAY.format(p='c.hash')}) FROM c JOIN l ON l.chain = c.chain AND l.seq = c.seq + 1),
  x AS (SELECT chain, seq, "at", examiner, action, CASE WHEN chain % 5 = 2 AND seq = 3 THEN 'edited' ELSE detail END AS detail, prev_hash, hash FROM c WHERE NOT (chain % 5 = 3 AND seq = 2)),
  v AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY chain ORDER BY seq), '') AS before FROM x),
  b AS (SELECT *, prev_hash <> before OR sha256({_PAY.format(p='before').replace('l.', '')}) <> hash AS bad FROM v)
  SELECT chain, count(*) AS rows, count(*) FILTER (WHERE bad) = 0 AS ok, min(seq) FILTER (WHERE bad) AS broken_at FROM b GROUP BY chain""")
def audit_verify(t):
    """A chain of each user's events, written as an audit log is; in a fifth of them a row is edited, in a fifth one removed."""
    row = F.struct("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("e"), F.col("user_id").cast("string"))).alias("examiner"), F.col("event_type").alias("action"), F.col("props").alias("detail"))
    ordered = t("events").groupBy(F.col("user_id").alias("chain")).agg(F.sort_array(F.collect_list(row)).alias("log"))
    none = F.lit("None")

    def written(done, x):
        before, seq = F.coalesce(F.try_element_at(done, F.lit(-1))["hash"], F.lit("")), F.size(done) + 1
        parts = [seq.cast("string"), *(F.coalesce(x[c], none) for c in ("at", "examiner", "action", "detail"))]
        own = F.struct(seq.cast("long").alias("seq"), x["at"].alias("at"), x["examiner"].alias("examiner"), x["action"].alias("action"), x["detail"].alias("detail"), before.alias("prev_hash"), F.sha2(F.concat_ws("|", before, *parts), 256).alias("hash"))
        return F.concat(done, F.array(own))

    empty = F.array().cast("array<struct<seq:bigint,at:string,examiner:string,action:string,detail:string,prev_hash:string,hash:string>>")
    log = ordered.select("chain", F.inline(F.aggregate("log", empty, written)))
    edited = F.when((F.col("chain") % 5 == 2) & (F.col("seq") == 3), "edited").otherwise(F.col("detail"))
    return case.audit_verify(log.withColumn("detail", edited).where(~((F.col("chain") % 5 == 3) & (F.col("seq") == 2))), ["chain"])


_USN = """u AS (SELECT event_id AS usn, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name, user_id AS mft, 'k' || (json_extract_string(props, '$.k')::INT // 25) AS reason, ts AS time FROM events)"""


def _usn(t):
    reason = F.concat(F.lit("k"), F.call_function("div", F.get_json_object("props", "$.k").cast("int"), F.lit(25)).cast("string"))
    return t("events").select(F.col("event_id").alias("usn"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"), F.col("user_id").alias("mft"), F.array(reason).alias("reasons"), F.col("ts").alias("time"))


@query(f"""WITH {_USN} SELECT lower(name) AS name_key, mft, arg_min(name, usn) AS name, count(*) AS n, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, min(time) AS first, max(time) AS last, lower(name) NOT IN ('click', 'view') AS gone FROM u GROUP BY lower(name), mft""")
def usn_fold(t):
    live = t.spark.createDataFrame([("Click",), ("VIEW",)], "name string")
    return case.usn_fold(_usn(t), live).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {_USN} SELECT usn, name, mft, reason FROM u WHERE contains(lower(name), 'ic') AND reason IN ('k1', 'k3') ORDER BY usn LIMIT 100 OFFSET 50")
def usn_filter(t):
    kept = _usn(t).where(F.contains(F.lower("name"), F.lit("ic")) & F.arrays_overlap("reasons", F.array(F.lit("k1"), F.lit("k3"))))
    return kept.orderBy("usn").offset(50).limit(100).select("usn", "name", "mft", F.get("reasons", F.lit(0)).alias("reason"))


@query(f"WITH {_USN} SELECT reason, count(*) AS n FROM u GROUP BY reason")
def usn_reasons(t):
    return _usn(t).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT doc_id AS key, quality FROM labels WHERE doc_id % 3 <> 0), r AS (SELECT doc_id AS key, n_chars AS size FROM documents WHERE doc_id % 2 = 0)
  SELECT coalesce(i.key, r.key) AS key, quality, size, CASE WHEN i.key IS NULL THEN 'content only' WHEN r.key IS NULL THEN 'record only' END AS orphan FROM i FULL JOIN r ON i.key = r.key""")
def recyclebin_pair(t):
    info = t("labels").where("doc_id % 3 <> 0").select(F.lit("b").alias("bin"), F.col("doc_id").alias("key"), "quality")
    content = t("documents").where("doc_id % 2 = 0").select(F.lit("b").alias("bin"), F.col("doc_id").alias("key"), F.col("n_chars").alias("size"))
    return case.pair_bin(info, content).drop("bin")


_HIST = """v AS (SELECT p.url, e.event_type AS title, e.ts AS visited_at, 'visits' AS source FROM events e LEFT JOIN pages p ON p.page_id = e.user_id),
  h AS (SELECT * FROM v UNION ALL SELECT url, NULL, NULL, 'urls' FROM pages WHERE url NOT IN (SELECT url FROM v WHERE url IS NOT NULL))"""


def _history(t):
    visits = t("events").select(F.col("user_id").alias("url_id"), F.col("ts").alias("visited_at"), F.lit("visits").alias("source"))
    urls = t("pages").select(F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("title"))
    return case.browser_history(visits, urls)


@query(f"WITH {_HIST} SELECT url, visited_at, source FROM h")
def browser_history(t):
    return _history(t).select("url", "visited_at", "source")


@query(f"WITH {_HIST} SELECT coalesce(nullif(regexp_extract(url, '\\.(com|net|org)', 1), ''), 'none') AS product, CASE source WHEN 'visits' THEN 'History' ELSE 'Recovered' END AS kind, count(*) AS n FROM h GROUP BY ALL")
def browser_branches(t):
    product = F.coalesce(F.nullif(F.regexp_extract("url", r"\.(com|net|org)", 1), F.lit("")), F.lit("none"))
    kind = F.when(F.col("source") == "visits", "History").otherwise("Recovered")
    return _history(t).groupBy(product.alias("product"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS messages, substr(trim(arg_min(text, turn), ' '), 1, 40) AS subject, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def mail_threads(t):
    return case.threads(t("conversations"))


@query("""WITH old AS (SELECT p_partkey AS node, p_name AS path, p_size AS digest, 1 AS ver FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS node, upper(p_name) AS path, p_size + 1000 AS digest, 2 AS ver FROM part WHERE p_partkey % 2 = 0)
  SELECT coalesce(o.node, n.node) AS node, coalesce(o.path, n.path) AS path, coalesce(n.digest, o.digest) AS digest, coalesce(n.ver, o.ver) AS ver FROM old o FULL JOIN new n USING (node)""")
def hash_upsert(t):
    """Stored digests are refreshed, paths are not."""
    made = lambda keep, path, digest, ver: t("part").where(keep).select(F.col("p_partkey").alias("node"), path.alias("path"), digest.alias("digest"), F.lit(ver).alias("ver"))
    old = made("p_partkey % 3 <> 0", F.col("p_name"), F.col("p_size"), 1)
    return case.upsert(old, made("p_partkey % 2 = 0", F.upper("p_name"), F.col("p_size") + 1000, 2), ["node"], ["digest", "ver"])


@query(f"""WITH {_TAGS}, x AS (SELECT 0 AS rank, 'high' AS severity, 'hashsets' AS kind, count(*) AS n FROM tags WHERE toxic = 1 UNION ALL SELECT 1, 'medium', 'filetype', count(*) FROM pages WHERE contains(html, '<script')
  UNION ALL SELECT 2, 'low', 'usn', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 3, 'info', 'tagged', count(*) FROM tags UNION ALL SELECT 3, 'info', 'unreadable', count(*) FROM documents WHERE text IS NULL)
  SELECT rank::INT AS rank, severity, kind, n FROM x WHERE n > 0""")
def triage(t):
    tags = _tags(t)
    return case.triage({
        "hashsets": ("high", tags.where("toxic = 1")), "filetype": ("medium", t("pages").where(F.contains("html", F.lit("<script")))), "usn": ("low", t("events").where("event_type = 'error'")),
        "tagged": ("info", tags), "unreadable": ("info", t("documents").where("text is null")),
    })
