"""Queries over times, bound to events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import scalars
from evidencelake.operators import timeline
from evidencelake.plans.registry import query
from evidencelake.session import dealt

_EV = "ev AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS sort, event_type AS action, 'u' || user_id AS path, 'u' || user_id AS name, event_type = 'error' AS flagged FROM events)"
_MIN = "mi AS (SELECT floor(sort / 60)::BIGINT AS m, count(*) AS n, count(*) FILTER (WHERE flagged) AS f FROM ev GROUP BY 1)"


def _events(t):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return t("events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sort"), F.col("event_type").alias("action"), user.alias("path"), user.alias("name"), (F.col("event_type") == "error").alias("flagged"))


@query(f"WITH {_EV}, {_MIN} SELECT m, n, f FROM mi")
def timeline_minutes(t):
    return timeline.minutes(_events(t))


def _histogram_sql(bins: int) -> str:
    return f"""WITH {_EV}, {_MIN}, tot AS (SELECT 60.0 * min(m) AS flo, 60.0 * (max(m) + 1) AS fhi, sum(n) AS total, floor(sum(n) * 0.001)::INT AS k FROM mi),
      o AS (SELECT sort, row_number() OVER (ORDER BY sort) - 1 AS up, row_number() OVER (ORDER BY sort DESC) - 1 AS down FROM ev),
      tr AS (SELECT 60.0 * floor((SELECT sort FROM o, tot WHERE up = k) / 60) AS a, 60.0 * (floor((SELECT sort FROM o, tot WHERE down = k) / 60) + 1) AS b),
      r AS (SELECT CASE WHEN k > 0 AND b - a < (fhi - flo) / 2 THEN a ELSE flo END AS lo, CASE WHEN k > 0 AND b - a < (fhi - flo) / 2 THEN b ELSE fhi END AS hi FROM tot, tr),
      w AS (SELECT 60.0 * floor(lo / 60) AS lo, hi, 60.0 * ceil((hi - lo) / {bins} / 60) AS width FROM r),
      g AS (SELECT lo, width, greatest(1, ceil((hi - lo) / width))::INT AS n FROM w),
      bars AS (SELECT unnest(range(n))::INT AS bar, lo, width FROM g)
    SELECT bar, (lo + bar * width)::DOUBLE AS start, coalesce(sum(mi.n), 0)::BIGINT AS n, coalesce(sum(mi.f), 0)::BIGINT AS f
    FROM bars LEFT JOIN mi ON m * 60.0 >= lo + bar * width AND m * 60.0 < lo + (bar + 1) * width GROUP BY bar, lo, width"""


@query(_histogram_sql(300))
def timeline_histogram(t):
    return timeline.histogram(_events(t), 300)


@query(f"""WITH {_EV}, e AS (SELECT * FROM ev WHERE sort >= 1704067200 AND sort < 1704070800), b AS (SELECT unnest(range(100))::INT AS bar)
  SELECT bar, (1704067200.0 + bar * 36.0)::DOUBLE AS start, count(e.id) AS n, count(*) FILTER (WHERE coalesce(e.flagged, false)) AS f FROM b LEFT JOIN e ON floor((e.sort - 1704067200) / 36.0) = bar GROUP BY bar""")
def timeline_histogram_fine(t):
    """An hour in bars of 36 seconds: counted by event."""
    return timeline.histogram(_events(t), 100, 1704067200.0, 1704070800.0)


@query(f"""WITH {_EV} SELECT id, sort, path, action, flagged FROM ev WHERE (name ILIKE '%u1%' OR path ILIKE '%u1%') AND sort >= 1704153600 AND sort < 1705881600
  AND (sort > 1704240000 OR (sort = 1704240000 AND (path > 'u1' OR (path = 'u1' AND (action > 'click' OR (action = 'click' AND id > 7)))))) ORDER BY sort, path, action, id LIMIT 200""")
def timeline_page(t):
    found = timeline.page(_events(t), 200, (1704240000.0, "u1", "click", 7), "U1", False, 1704153600.0, 1705881600.0)
    return found.select("id", "sort", "path", "action", "flagged")


@query(f"WITH {_EV} SELECT count(*) AS events, count(*) FILTER (WHERE flagged) AS flagged, min(sort) AS first, max(sort) AS last, arg_min(action, (sort, id)) AS first_action, arg_max(action, (sort, id)) AS last_action FROM ev")
def timeline_summary(t):
    return timeline.summary(_events(t))


_SI = """x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_shipdate AS modified, o_orderdate AS created, o_orderdate + to_days(l_linenumber - 3) + to_milliseconds(l_orderkey % 3) AS fn_created, l_shipdate + to_milliseconds(l_orderkey % 2 * 5) AS fn_modified
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_FOUND = """f AS (SELECT k, n, created, modified, CASE WHEN created < fn_created THEN 'si_before_fn' END AS a, CASE WHEN created > modified THEN 'created_after_modified' END AS b,
  CASE WHEN epoch_us(created) % 1000000 = 0 AND epoch_us(modified) % 1000000 = 0 AND (epoch_us(fn_created) % 1000000 <> 0 OR epoch_us(fn_modified) % 1000000 <> 0) THEN 'second_granularity' END AS c FROM x)"""


def _stamped(t):
    items, orders = t("lineitem"), t("orders")
    rows = items.count() + orders.count()
    items = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").cast("timestamp").alias("modified"))
    orders = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("created"))
    both = dealt(items, "k", count=rows).join(dealt(orders, "k", count=rows), "k")
    both = both.withColumn("fn_modified", F.col("modified") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("k") % 2 * 5).cast("decimal(18,6)") / 1000))
    return both.withColumn("fn_created", F.col("created") + F.make_dt_interval(F.col("n") - 3, F.lit(0), F.lit(0), (F.col("k") % 3).cast("decimal(18,6)") / 1000))


@query(f"WITH {_SI}, {_FOUND} SELECT k, n, concat_ws(',', a, b, c) AS kinds, count(*) AS rows FROM f WHERE coalesce(a, b, c) IS NOT NULL GROUP BY ALL")
def timestamp_anomalies(t):
    df = _stamped(t).withColumn("found", timeline.anomalies(F.col("created"), F.col("modified"), F.col("fn_created"), F.col("fn_modified")))
    return df.where(F.size("found") > 0).groupBy("k", "n", F.array_join("found.kind", ",").alias("kinds")).agg(F.count("*").alias("rows"))


@query("""WITH e AS (
  SELECT o_orderkey AS node, 'created' AS action, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS time FROM orders
  UNION ALL SELECT o_orderkey, 'modified', strftime(o_orderdate + to_days(o_orderkey % 90), '%Y-%m-%dT%H:%M:%SZ') FROM orders WHERE o_orderkey % 4 <> 0)
  SELECT node, action, time, epoch(strptime(time, '%Y-%m-%dT%H:%M:%SZ'))::DOUBLE AS sort FROM e WHERE time >= '1995-01-01T00:00:00Z' AND time <= '1997-06-30T00:00:00Z'""")
def timeline_events(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.col("o_orderdate").cast("timestamp")
    later = F.when(F.col("o_orderkey") % 4 != 0, text(at + F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))))
    e = t("orders").select(F.col("o_orderkey").alias("node"), text(at).alias("created"), later.alias("modified"), text(at).alias("accessed"))
    return timeline.events(e, include_accessed=False, start="1995-01-01T00:00:00Z", end="1997-06-30T00:00:00Z").select("node", "action", "time", "sort")


_EPOCH = "e AS (SELECT event_id, epoch_us(ts) AS us, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS z FROM events)"
_ISO = "CASE WHEN z = 1 THEN strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%SZ') END"


@query(f"""WITH {_EPOCH} SELECT event_id, {_ISO.format('us')} AS filetime, {_ISO.format('us')} AS webkit, {_ISO.format('(us // 1000000) * 1000000')} AS unix_s, {_ISO.format('(us // 1000) * 1000')} AS unix_ms,
  {_ISO.format('(us // 1000000) * 1000000')} AS mac, {_ISO.format('(us // 1000000) * 1000000')} AS hfs, {_ISO.format('us')} AS apfs FROM e""")
def epoch_decode(t):
    z, us = F.when(F.col("event_id") % 10 == 0, 0).otherwise(1).cast("long"), F.unix_micros(F.col("ts").cast("timestamp"))
    s = F.call_function("div", us, F.lit(1_000_000))
    made = {
        "filetime": scalars.filetime((us + scalars.FROM_1601 * 1_000_000) * 10 * z), "webkit": scalars.webkit((us + scalars.FROM_1601 * 1_000_000) * z), "unix_s": scalars.unix(s * z),
        "unix_ms": scalars.unix(F.call_function("div", us, F.lit(1000)) * z, 1000), "mac": scalars.mac_absolute((s + scalars.FROM_2001) * z), "hfs": scalars.hfs((s + scalars.FROM_1904) * z), "apfs": scalars.apfs(us * 1000 * z),
    }
    return t("events").select("event_id", *(scalars.iso(v).alias(k) for k, v in made.items()))


@query("""WITH y AS (SELECT event_id, ts, year(ts) AS y FROM events), r AS (SELECT *, make_date(y, 3, 1) AS m, make_date(y, 11, 1) AS n FROM y),
  d AS (SELECT *, m + ((7 - isodow(m)) % 7 + 7)::INT AS dst, n + ((7 - isodow(n)) % 7)::INT AS std FROM r),
  f AS (SELECT *, CASE WHEN ts >= dst + INTERVAL 10 HOUR AND ts < std + INTERVAL 9 HOUR THEN -420 ELSE -480 END AS minutes FROM d)
  SELECT event_id, minutes::INT AS minutes, strftime(ts + to_minutes(minutes), '%Y-%m-%dT%H:%M:%S') AS local FROM f""")
def tz_shift(t):
    """Pacific time by its rule: daylight from the second Sunday of March to the first of November."""
    ts, year = F.col("ts").cast("timestamp"), F.year("ts")
    hours = lambda day, h: day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(h))
    inside = (ts >= hours(scalars.nth_weekday(year, 3, "SUN", 2), 10)) & (ts < hours(scalars.nth_weekday(year, 11, "SUN", 1), 9))
    df = t("events").select("event_id", ts.alias("ts"), F.when(inside, -420).otherwise(-480).alias("minutes"))
    return df.select("event_id", "minutes", F.date_format(scalars.shifted(F.col("ts"), F.col("minutes")), "yyyy-MM-dd'T'HH:mm:ss").alias("local"))
