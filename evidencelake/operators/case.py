"""Case tables: merges, counters, audit chain, techniques, change journal, browser and recycle-bin joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], refreshed: list[str]) -> DataFrame:
    """Rows of ``table`` with only the ``refreshed`` columns taken from ``changes`` where keys meet, and its new rows.

    A null in a key never meets another, so such rows are always new.
    """
    new = changes.select(*[F.col(c).alias(f"_{c}") for c in changes.columns])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    on = same[0]
    for s in same[1:]:
        on &= s
    kept = table.join(new, on, "left").select(*(F.when(F.col(f"_{keys[0]}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in refreshed else F.col(c) for c in table.columns))
    old = table.select(*[F.col(k).alias(f"_{k}") for k in keys])
    added = changes.join(old, on, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def replace_groups(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with every group of ``keys`` that ``fresh`` speaks of replaced by its rows."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def remove_evidence(tables: dict[str, DataFrame], evidence_id: int) -> dict[str, DataFrame]:
    return {n: df.where(F.col("id" if n == "evidence" else "evidence_id") != evidence_id) for n, df in tables.items()}


def audit_payload(previous: Column) -> Column:
    """What a row's hash covers; a null is written as the text None."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("seq", "at", "examiner", "action", "detail")]
    return F.concat_ws("|", previous, *parts)


def audit_verify(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, ok, broken_at): the first row whose previous hash or own hash is wrong, in each chain.

    It compares with the stored hash of the row before, so rows are tested independently of each other: one window for
    each chain. Rows cut from the end can't be seen.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    before = F.coalesce(F.lag("hash").over(order), F.lit(""))
    bad = (F.col("prev_hash") != F.col("before")) | (F.sha2(audit_payload(F.col("before")), 256) != F.col("hash"))
    marked = log.withColumn("before", before).withColumn("bad", bad)
    return marked.groupBy(*keys).agg(F.count("*").alias("rows"), (F.count_if("bad") == 0).alias("ok"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("broken_at"))


def technique_summary(tags: DataFrame) -> DataFrame:
    """(tactic, technique, asserted, proposed) with a line for each tactic (null technique)."""
    return tags.rollup("tactic", "technique").agg(F.count_if("asserted").alias("asserted"), F.count_if(~F.col("asserted")).alias("proposed")).where("tactic is not null")


def stix_techniques(bundles: DataFrame) -> DataFrame:
    """(technique, name, tactic) of JSON bundles (``value``): attack patterns that are neither revoked nor deprecated, each once."""
    schema = """objects array<struct<type:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,
      external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<phase_name:string>>>>"""
    o = bundles.select(F.inline(F.from_json("value", schema)["objects"])).where((F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    own = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    rows = o.select(own.alias("technique"), "name", F.get(F.col("kill_chain_phases.phase_name"), F.lit(0)).alias("tactic")).where("technique is not null")
    return rows.groupBy("technique").agg(F.min("name").alias("name"), F.min("tactic").alias("tactic"))


def usn_fold(records: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(name_key, mft, name, n, reasons, first, last, gone): the journal folded to files; ``gone``: no live file of that name."""
    folded = records.groupBy(F.lower("name").alias("name_key"), "mft").agg(
        F.min_by("name", "usn").alias("name"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"), F.min("time").alias("first"), F.max("time").alias("last")
    )
    if live is None:
        return folded.withColumn("gone", F.lit(False))
    there = live.select(F.lower("name").alias("name_key")).distinct().withColumn("there", F.lit(True))
    return folded.join(there, "name_key", "left").withColumn("gone", F.col("there").isNull()).drop("there")


def browser_history(visits: DataFrame, urls: DataFrame) -> DataFrame:
    """Visits with their URL, and URLs whose address no visit shows."""
    v = visits.join(urls.withColumnRenamed("id", "url_id"), "url_id", "left").select("url", "title", "visited_at", "source")
    alone = urls.join(v.select("url").where("url is not null").distinct(), "url", "left_anti")
    return v.unionByName(alone.select("url", "title", F.lit(None).cast(v.schema["visited_at"].dataType).alias("visited_at"), F.lit("urls").alias("source")))


def pair_bin(info: DataFrame, content: DataFrame) -> DataFrame:
    """$I and $R entries by bin and name: both, or what is orphaned."""
    both = info.withColumn("i", F.lit(True)).join(content.withColumn("r", F.lit(True)), ["bin", "key"], "full_outer")
    return both.withColumn("orphan", F.when(F.col("i").isNull(), "content only").when(F.col("r").isNull(), "record only")).drop("i", "r")


def threads(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, subject, first_role, last_role, roles) of (conv_id, turn, role, text)."""
    subject = F.substring(F.trim(F.min_by("text", "turn")), 1, 40)
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), subject.alias("subject"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count_distinct("role").alias("roles"))


def triage(findings: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(rank, severity, kind, n) of findings that occur: small aggregates side by side, the gravest first."""
    ranks = {"high": 0, "medium": 1, "low": 2, "info": 3}
    rows = None
    for kind, (severity, df) in findings.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(ranks[severity]).alias("rank"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.where("n > 0").orderBy("rank", "kind")
