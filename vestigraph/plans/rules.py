"""Queries on rules over days, weeks and quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.operators import rules
from vestigraph.plans.registry import query, table
from vestigraph.streaming import usage

_DAYS = "e AS (SELECT user_id, ts, ts::DATE AS day, event_type, round(value * 100)::BIGINT AS cents FROM events)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", F.to_date("ts").alias("day"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query(f"""WITH {_DAYS}, w AS (SELECT user_id, isoyear(day)::INT AS iso_year, weekofyear(day)::INT AS iso_week, sum(cents)::BIGINT AS hours FROM e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hours DESC, iso_year, iso_week) AS nth FROM w) SELECT user_id, iso_year, iso_week, hours FROM r WHERE nth = 1 AND hours > 40000""")
def weekly_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.worst_week(_days(spark, sf_dir), "user_id", "day", "cents", 40000)


@query(f"""WITH {_DAYS}, s AS (SELECT user_id, strftime(day, '%Y-%m') AS month, CASE WHEN user_id % 2 = 0 THEN 'comprehensive' ELSE 'standard' END AS system, sum(cents)::BIGINT AS planned, coalesce(sum(cents) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS approved FROM e GROUP BY ALL),
    o AS (SELECT *, CASE system WHEN 'comprehensive' THEN greatest(planned - 150000, 0) ELSE approved END AS overtime FROM s) SELECT user_id, month, system, planned, approved, overtime FROM o WHERE overtime > 36000""")
def overtime_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    month, system = F.date_format("day", "yyyy-MM"), F.when(F.col("user_id") % 2 == 0, "comprehensive").otherwise("standard")
    return rules.monthly_overtime(_days(spark, sf_dir), "user_id", month, system, F.col("cents"), F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0), 150000, 36000)


@query(f"""WITH {_DAYS}, d AS (SELECT DISTINCT user_id, day FROM e), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM d),
    r AS (SELECT user_id, count(*) AS days, min(day) AS a, max(day) AS b FROM i GROUP BY user_id, island), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, a) AS nth FROM r)
    SELECT user_id, days, a::VARCHAR AS first_day, b::VARCHAR AS last_day FROM n WHERE nth = 1 AND days >= 6""")
def longest_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.longest_streak(_days(spark, sf_dir).select("user_id", "day").distinct(), "user_id", "day", 6)
    return found.select("user_id", "days", F.col("first_day").cast("string"), F.col("last_day").cast("string"))


@query(f"""WITH {_DAYS}, g AS (SELECT user_id, day, ts, event_type, CASE WHEN day - lag(day) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM e WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY day, ts)),
    i AS (SELECT user_id, day, sum(fresh) OVER (PARTITION BY user_id ORDER BY day, ts ROWS UNBOUNDED PRECEDING) AS island FROM g), r AS (SELECT user_id, count(*) AS days, min(day) AS a, max(day) AS b FROM i GROUP BY user_id, island),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, a) AS nth FROM r) SELECT user_id, days, a::VARCHAR AS first_day, b::VARCHAR AS last_day FROM n WHERE nth = 1 AND days >= 2""")
def streak_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over rows that repeat days: a repeated day ends a run."""
    found = rules.longest_streak(_days(spark, sf_dir).where("event_type != 'view'"), "user_id", "day", 2)
    return found.select("user_id", "days", F.col("first_day").cast("string"), F.col("last_day").cast("string"))


@query("""WITH o AS (SELECT o_orderkey, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE - 1 AS q, o_orderdate::DATE AS d FROM orders)
    SELECT o_orderkey, q::VARCHAR AS quarter_end, (q - d)::INT AS days_left, CASE WHEN q - d < 15 THEN 'high' WHEN q - d < 45 THEN 'medium' ELSE 'low' END AS level FROM o""")
def quarter_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    left = rules.days_to_quarter_end(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.quarter_end(day).cast("string").alias("quarter_end"), left.alias("days_left"), F.when(left < 15, "high").when(left < 45, "medium").otherwise("low").alias("level"))


@query(f"WITH {_DAYS} SELECT user_id, count_if(NOT (hour(ts) BETWEEN 10 AND 15)) AS absences FROM e GROUP BY 1 HAVING absences > 40")
def core_absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.absences(_days(spark, sf_dir), "user_id", F.hour("ts").between(10, 15), 40)


@query(f"""WITH {_DAYS}, d AS (SELECT user_id, day, bool_or(event_type = 'signup') AS trip, bool_or(event_type = 'purchase') AS closed, bool_or(event_type = 'view') AS located, bool_or(event_type = 'click') AS access FROM e GROUP BY ALL),
    j AS (SELECT a.*, NOT a.access AND coalesce(b.access, false) AS contrast FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND b.day = a.day - 1),
    c AS (SELECT user_id, day, round(0.35 * trip::INT + 0.30 * closed::INT + 0.22 * located::INT + 0.13 * contrast::INT, 4) AS confidence FROM j)
    SELECT user_id, day::VARCHAR AS day, confidence::DOUBLE AS confidence, CASE WHEN confidence >= 0.8 THEN 'accepted' WHEN confidence >= 0.5 THEN 'review' ELSE 'rejected' END AS conclusion FROM c""")
def weighted_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda t: F.bool_or(F.col("event_type") == t)
    days = _days(spark, sf_dir).groupBy("user_id", "day").agg(has("signup").alias("trip"), has("purchase").alias("closed"), has("view").alias("located"), has("click").alias("access"))
    before = days.select("user_id", F.date_add("day", 1).alias("day"), F.col("access").alias("before"))
    rows = days.join(before, ["user_id", "day"], "left")
    contrast = ~F.col("access") & F.coalesce("before", F.lit(False))
    sure = rules.confidence({"trip_approved": F.col("trip"), "order_closed": F.col("closed"), "location_match": F.col("located"), "access_contrast": contrast})
    return rows.select("user_id", F.col("day").cast("string").alias("day"), sure.alias("confidence")).withColumn("conclusion", rules.conclusion(F.col("confidence")))


_POLICY = """
    p AS (SELECT s_nationkey AS source_no, s_suppkey AS segment_no, CASE s_suppkey % 4 WHEN 0 THEN 'monthly_standard_hours' WHEN 1 THEN 'monthly_overtime_cap' WHEN 2 THEN 'consecutive_days_limit' ELSE 'core_hours_required' END AS key,
          CASE s_suppkey % 4 WHEN 0 THEN 160 + s_suppkey % 10 WHEN 1 THEN 30 + s_suppkey % 7 WHEN 2 THEN 5 + s_suppkey % 9 ELSE 6.5 END::DOUBLE AS value, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 5 END AS pattern_no FROM supplier)
"""


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of a policy for each supplier; its nation is the source."""
    k = F.col("s_suppkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("标准工时制：月标准工时为"), 160 + k % 10, F.lit("小时"))).when(k % 4 == 1, F.concat(F.lit("月累计加班超过 "), 30 + k % 7, F.lit(" 小时"))).when(k % 4 == 2, F.concat(F.lit("连续出勤达到 "), 5 + k % 9, F.lit(" 天"))).otherwise("核心在岗时段为 10:00 至 16:30")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source_no"), k.alias("segment_no"), said.alias("text"))


@query(f"WITH {_POLICY} SELECT key, value, source_no, segment_no, pattern_no FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_no, segment_no) = 1")
def policy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's first source and segment count, whichever of its patterns matches there."""
    return rules.first_match(_policies(spark, sf_dir), list(rules.POLICY_PATTERNS), ["source_no", "segment_no"])


@query(f"WITH {_POLICY} SELECT key FROM (VALUES ('weekly_hours_cap'), ('monthly_standard_hours'), ('core_hours_required'), ('consecutive_days_limit'), ('made_up')) t(key) WHERE key NOT IN (SELECT key FROM p WHERE segment_no % 4 < 2)")
def policy_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.first_match(_policies(spark, sf_dir).where("segment_no % 4 < 2"), list(rules.POLICY_PATTERNS), ["source_no", "segment_no"])
    return rules.unresolved(found, ["weekly_hours_cap", "monthly_standard_hours", "core_hours_required", "consecutive_days_limit", "made_up"])


@query("""SELECT source, doc_id::VARCHAR AS reference, substr(regexp_replace(text, '^ +| +$', '', 'g'), 1, 200) AS text FROM documents WHERE contains(text, 'The ') ORDER BY source, doc_id LIMIT 5""")
def policy_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("reference"), "text")
    return rules.sentences(segments, "The ", ["source", "doc_id"])


@query("""WITH u AS (SELECT user_id, round(sum(value), 2) AS earned, round(sum(CASE WHEN event_id % 40 = 0 THEN value ELSE 0 END), 2) AS used FROM events WHERE event_type <> 'view' GROUP BY 1), l AS (SELECT max(ts)::DATE AS d FROM events),
    q AS (SELECT ((date_trunc('quarter', d) + INTERVAL 3 MONTH)::DATE - 1 - d)::INT AS days_left FROM l)
    SELECT user_id, earned, days_left, CASE WHEN days_left < 61 THEN 'high' ELSE 'medium' END AS level FROM u, q WHERE earned > 0 AND used <= 0""")
def comp_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events earn time and whose events have no round number, which stands for using it; the last day of the data is observed."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "event_type", "event_id", "value")
    day = rules.observation_day(days)
    rows = days.where("event_type != 'view'").join(F.broadcast(day)).withColumn("used", F.when(F.col("event_id") % 40 == 0, F.col("value")).otherwise(0.0))
    found = rules.comp_off(rows.withColumn("who", F.struct("user_id", "day")), "who", "value", "used", F.col("who.day"), 61)
    return found.select("who.user_id", "earned", "days_left", "level")


_CLAUSES = """
    c AS (SELECT doc_id, text, 'clause-' || doc_id AS clause_id, length(text) // 2 AS s, least(length(text), length(text) // 2 + 12) AS e FROM documents WHERE text <> ''),
    f AS (SELECT *, CASE WHEN contains(substr(text, greatest(s - 1200, 0) + 1, least(s, 1200)), chr(10) || chr(10)) THEN greatest(s - 1200, 0) + length(regexp_extract(substr(text, greatest(s - 1200, 0) + 1, least(s, 1200)), '(?s)^.*\n\n')) ELSE 0 END AS a,
                 CASE WHEN contains(substr(text, e + 1, 1200), chr(10) || chr(10)) THEN e + instr(substr(text, e + 1, 1200), chr(10) || chr(10)) - 1 ELSE length(text) END AS b FROM c),
    p AS (SELECT doc_id, clause_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substr(text, a + 1, b - a) END AS block, coalesce(lang, '') AS name, substr(text, s + 1, e - s) AS mention FROM f JOIN documents USING (doc_id, text)),
    t AS (SELECT *, name || ' ' || mention || coalesce(' ' || block, '') AS text FROM p)
"""
_SYSTEMS = "n AS (SELECT name, min(id) AS system_id FROM (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT p_partkey, lower(substr(p_type, 1, 3)) FROM part) GROUP BY 1)"
_BRIDGE = f"""{_CLAUSES}, {_SYSTEMS},
    h AS (SELECT system_id, clause_id, doc_id, substr(text, 1, 200) AS evidence FROM t JOIN n ON contains(text, n.name)),
    w AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '2024-01-0' || (1 + doc_id % 9) WHEN doc_id % 3 = 1 THEN '2020-05-0' || (1 + doc_id % 9) END AS valid_from, CASE doc_id % 3 WHEN 0 THEN 'inherited' WHEN 1 THEN 'doc_scope' ELSE 'no_window' END AS origin FROM h)"""


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause in the middle of each document; every fourth one's place is not known."""
    docs = table(spark, sf_dir, "documents").where("text != ''")
    start = F.floor(F.length("text") / 2).cast("int")
    end = F.least(F.length("text"), start + 12)
    block = rules.paragraph(F.col("text"), F.when(F.col("doc_id") % 4 != 0, start), end)
    return docs.select(F.concat(F.lit("clause-"), "doc_id").alias("clause_id"), "doc_id", F.col("lang").alias("name"), F.substr("text", start + 1, end - start).alias("mention"), block.alias("block"))


@query(f"WITH {_CLAUSES} SELECT clause_id, block, text FROM t")
def clause_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph around each clause, and the text that it is judged by."""
    return _clauses(spark, sf_dir).select("clause_id", "block", rules.clause_text(F.col("name"), F.col("mention"), F.col("block")).alias("text"))


def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = _clauses(spark, sf_dir).select("clause_id", "doc_id", rules.clause_text(F.col("name"), F.col("mention"), F.col("block")).alias("text"))
    part = table(spark, sf_dir, "part")
    each = F.concat(F.array("p_name", F.lower(F.substring("p_type", 1, 3))), F.split("p_name", " "))
    systems = part.select(F.col("p_partkey").alias("id"), F.explode(each).alias("name")).groupBy("name").agg(F.min("id").alias("system_id"))
    window = lambda begin: (F.concat(F.lit(begin), 1 + F.col("doc_id") % 9).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    own = clauses.where("doc_id % 3 = 0").select("clause_id", *window("2024-01-0"))
    document = clauses.where("doc_id % 3 < 2").select("doc_id", *window("2020-05-0"))
    return rules.bridged(clauses, systems, own, document)


@query(f"WITH {_BRIDGE} SELECT system_id, clause_id, evidence, valid_from, origin FROM w")
def policy_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, their words and the beginnings of their types as systems that clauses name; a third of the clauses has a window of its own, a third its document's."""
    return _bridge(spark, sf_dir).where("system_id is not null").select("system_id", "clause_id", "evidence", "valid_from", "origin")


@query(f"WITH {_BRIDGE} SELECT 'unmatched' AS what, count(*) AS n FROM t WHERE clause_id NOT IN (SELECT clause_id FROM h) HAVING count(*) > 0 UNION ALL SELECT origin, count(*) FROM w GROUP BY 1 UNION ALL SELECT 'system:' || system_id, count(*) FROM w GROUP BY 1")
def policy_bridge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.bridge_counts(_bridge(spark, sf_dir))


@query(f"""WITH {_DAYS}, d AS (SELECT DISTINCT user_id, day FROM e), x AS (SELECT user_id, day, event_type, cents % 3 AS site FROM e),
    t AS (SELECT user_id, day + k AS day, nullif(site, 0) AS site FROM x, (VALUES (0), (1)) v(k) WHERE event_type = 'signup'),
    tt AS (SELECT user_id, day, count(site) > 0 AS sited FROM t GROUP BY 1, 2), o AS (SELECT user_id, day, bool_or(cents % 2 = 0) AS closed FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
    l AS (SELECT user_id, day, bool_or(NOT coalesce(sited, false) OR EXISTS (SELECT 1 FROM t WHERE t.user_id = x.user_id AND t.day = x.day AND t.site = x.site)) AS ok FROM x LEFT JOIN tt USING (user_id, day) WHERE event_type = 'view' GROUP BY 1, 2),
    a AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'click')
    SELECT d.user_id AS who, d.day::VARCHAR AS day, tt.user_id IS NOT NULL AS trip_approved, coalesce(closed, false) AS order_closed, coalesce(ok, false) AS location_match, EXISTS (SELECT 1 FROM a WHERE a.user_id = d.user_id AND a.day = d.day - 1) AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = d.user_id AND a.day = d.day) AS access_contrast
    FROM d LEFT JOIN tt USING (user_id, day) LEFT JOIN o USING (user_id, day) LEFT JOIN l USING (user_id, day)""")
def attribution_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as trips of two days, purchases as orders, views as places, clicks as access."""
    e = _days(spark, sf_dir).withColumnRenamed("user_id", "who").withColumn("site", (F.col("cents") % 3).cast("string"))
    of = lambda t: e.where(F.col("event_type") == t)
    trips = of("signup").select("who", F.col("day").alias("start"), F.date_add("day", 1).alias("end"), F.when(F.col("site") != "0", F.col("site")).otherwise("").alias("site"), F.lit("approved").alias("status"))
    orders = of("purchase").select("who", "day", (F.col("cents") % 2 == 0).alias("closed"))
    return rules.day_facts(e, trips, orders, of("view").select("who", "day", "site"), of("click")).withColumn("day", F.col("day").cast("string"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, DATE '1995-01-01' + (10592 + o_orderkey % 30)::INT AS d FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT o_orderkey, event_id FROM o JOIN events e ON e.user_id = o.user_id AND ts::DATE >= d AND ts::DATE <= d + 2 WHERE event_type = 'purchase'""")
def trip_order_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders, moved into the month of the events, and the purchases of the mapped user within two days."""
    day = F.expr("date_add(to_date('1995-01-01'), cast(10592 + o_orderkey % 30 as int))")
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), day.alias("d"))
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("on"))
    # Equal keys and equal days: each order stands for its three days.
    each = orders.select("o_orderkey", "user_id", F.explode(F.sequence("d", F.date_add("d", 2))).alias("on"))
    return each.join(bought, ["user_id", "on"]).select("o_orderkey", "event_id")


@query("SELECT ts::DATE::VARCHAR AS day, event_type AS stage, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def stream_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.stream_daily(spark, f"{sf_dir}/events.parquet", "ts", "event_type", "value").withColumn("day", F.col("day").cast("string"))


@query("SELECT ts::DATE::VARCHAR AS day, event_type AS stage, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("day", F.col("day").cast("string"))


@query("SELECT ts::DATE::VARCHAR AS day, event_type AS stage, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT user_id) AS n_docs, round(sum(round(value * 100)::BIGINT)::DOUBLE / count(DISTINCT user_id), 4) AS cents_per_doc FROM events GROUP BY 1, 2")
def stream_daily_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with each day's distinct users, who stand for documents."""
    found = usage.stream_daily(spark, f"{sf_dir}/events.parquet", "ts", "event_type", "value", doc="user_id")
    return found.withColumn("day", F.col("day").cast("string")).withColumn("cents_per_doc", F.round("cents_per_doc", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nr FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS n FROM s GROUP BY user_id, nr""")
def sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usage.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return found.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss"))
