"""Queries on relationship patterns, alignment and facts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.operators import alignment, patterns, temporal, versions
from vestigraph.plans.registry import query, table

AS_OF = "1996-06-01"
CENTS = "decimal(14,2)"


def _attribute_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> (nation, balance to hundreds), valid from the customer's first order."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("src")).agg(F.min(F.to_date("o_orderdate")).alias("valid_from"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.concat_ws("|", "c_nationkey", F.floor(F.col("c_acctbal") / 100)).alias("dst"))
    return customers.join(first, "src", "left").withColumn("valid_to", F.lit(None).cast("date"))


_ATTRIBUTES = """
    f AS (SELECT o_custkey, min(o_orderdate)::DATE AS valid_from FROM orders GROUP BY 1),
    e AS (SELECT c_custkey AS src, c_nationkey::VARCHAR || '|' || floor(c_acctbal / 100)::BIGINT::VARCHAR AS dst, valid_from
          FROM customer LEFT JOIN f ON o_custkey = c_custkey)
"""


@query(f"""WITH {_ATTRIBUTES}, live AS (SELECT * FROM e WHERE valid_from IS NULL OR valid_from <= DATE '{AS_OF}')
    SELECT a.src AS left_id, b.src AS right_id, a.dst AS shared FROM live a JOIN live b ON a.dst = b.dst AND a.src < b.src""")
def shared_attribute_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.shared_pairs(_attribute_edges(spark, sf_dir), AS_OF)


@query(f"""WITH {_ATTRIBUTES}, live AS (SELECT * FROM e WHERE valid_from IS NULL OR valid_from <= DATE '{AS_OF}'), g AS (SELECT dst, count(*) AS group_size, min(src) AS class_id FROM live GROUP BY 1 HAVING count(*) > 1)
    SELECT src AS member_id, dst AS shared, group_size, class_id FROM live JOIN g USING (dst)""")
def shared_attribute_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.shared_groups(_attribute_edges(spark, sf_dir), AS_OF)


@query("""WITH e AS (SELECT DISTINCT s_suppkey AS src, s_nationkey || '-' || s_suppkey % 4 AS dst FROM supplier) SELECT a.src AS left_id, b.src AS right_id, a.dst AS shared FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src""")
def shared_phone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a made-up phone; phones have no validity, so edges that ended count too."""
    phones = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.concat_ws("-", "s_nationkey", F.col("s_suppkey") % 4).alias("dst"), F.lit(None).cast("date").alias("valid_from"), F.lit("1990-01-01").cast("date").alias("valid_to"))
    return patterns.shared_pairs(phones, temporal=False)


@query("""WITH o AS (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS dst FROM orders),
    e AS (SELECT DISTINCT src, dst FROM o WHERE src <> dst),
    w2 AS (SELECT a.src AS n1, a.dst AS n2, b.dst AS n3 FROM e a JOIN e b ON a.dst = b.src WHERE a.dst > a.src AND b.dst >= a.src),
    w3 AS (SELECT w2.*, c.dst AS n4 FROM w2 JOIN e c ON n3 = c.src WHERE c.dst >= n1 AND NOT (n1 = n3 AND n2 = c.dst)),
    w4 AS (SELECT w3.* FROM w3 JOIN e d ON n4 = d.src AND d.dst = n1 WHERE NOT (n2 = n4 AND n3 = d.dst) AND NOT (n1 = n4 AND n2 = d.dst))
    SELECT DISTINCT n1, n2, NULL::BIGINT AS n3, NULL::BIGINT AS n4, 2 AS hops FROM w2 WHERE n3 = n1
    UNION ALL SELECT DISTINCT n1, n2, n3, NULL, 3 FROM w3 WHERE n4 = n1
    UNION ALL SELECT DISTINCT n1, n2, n3, n4, 4 FROM w4""")
def ownership_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order leads to the next order of the same day: those edges' cycles."""
    orders = table(spark, sf_dir, "orders")
    from pyspark.sql import Window

    follower = F.lead("o_custkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return patterns.cycles(orders.select(F.col("o_custkey").alias("src"), follower.alias("dst")).where("dst is not null"))


_AMOUNTS = """
    l AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2))) AS net, sum(l_extendedprice::DECIMAL(14,2)) AS gross FROM lineitem GROUP BY 1),
    m AS (SELECT o_orderkey, o_orderpriority, o_totalprice::DECIMAL(14,2)::DOUBLE AS booked, net::DECIMAL(18,2)::DOUBLE AS invoiced, gross::DOUBLE AS contracted FROM orders JOIN l ON l_orderkey = o_orderkey),
    s AS (SELECT *, round(greatest(booked, invoiced, contracted) - least(booked, invoiced, contracted), 2) AS spread FROM m WHERE NOT (booked = invoiced AND invoiced = contracted))
"""


def _mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast(CENTS)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,2)").cast("double").alias("invoiced"), F.sum(price).cast("double").alias("contracted"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast(CENTS).cast("double").alias("booked"))
    a, b, c = (F.col(x) for x in ("booked", "invoiced", "contracted"))
    return orders.join(lines, "o_orderkey").where(patterns.amounts_disagree(a, b, c)).withColumn("spread", F.round(patterns.spread(a, b, c), 2))


@query(f"WITH {_AMOUNTS} SELECT o_orderkey, o_orderpriority, booked, invoiced, contracted, spread FROM s")
def three_way_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mismatches(spark, sf_dir)


@query(f"""WITH {_AMOUNTS}, r AS (SELECT o_orderkey, spread, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS evidence_rank FROM s JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT o_orderkey, spread, l_partkey, l_suppkey, l_linenumber, evidence_rank::INT AS evidence_rank FROM r WHERE evidence_rank <= 6""")
def suspicion_evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    order = [F.desc("l_extendedprice"), *(F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))]
    found = patterns.with_evidence(_mismatches(spark, sf_dir).select("o_orderkey", "spread"), lines, "o_orderkey", order)
    return found.select("o_orderkey", "spread", "l_partkey", "l_suppkey", "l_linenumber", "evidence_rank")


@query(f"WITH {_AMOUNTS} SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM s GROUP BY 1")
def suspicion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.summary(_mismatches(spark, sf_dir), "o_orderpriority")


_SEVERITY = "CASE WHEN spread >= 400000 THEN 'high' WHEN spread >= 100000 THEN 'medium' ELSE 'low' END"


@query(f"""WITH {_AMOUNTS} SELECT o_orderkey, {_SEVERITY} AS severity, spread FROM s
    ORDER BY CASE {_SEVERITY} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, spread DESC, o_orderkey LIMIT 5""")
def suspicion_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("spread") >= 400000, "high").when(F.col("spread") >= 100000, "medium").otherwise("low")
    rows = _mismatches(spark, sf_dir).select("o_orderkey", severity.alias("severity"), "spread")
    return rows.orderBy(patterns.severity_rank(F.col("severity")), F.desc("spread"), "o_orderkey").limit(5)


_ALIGN = """
    s AS (SELECT s_suppkey, s_nationkey::VARCHAR || '|' || floor(s_acctbal / 500)::BIGINT::VARCHAR AS tax_id, CASE WHEN s_suppkey % 3 = 0 THEN regexp_extract(s_name, '#0*([1-9][0-9]*)$', 1) END AS name, s_nationkey AS address FROM supplier),
    c AS (SELECT c_custkey, c_nationkey::VARCHAR || '|' || floor(c_acctbal / 500)::BIGINT::VARCHAR AS tax_id, nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1), '') AS name, c_nationkey AS address FROM customer),
    k1 AS (SELECT tax_id, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS id FROM s WHERE tax_id IS NOT NULL GROUP BY 1),
    k2 AS (SELECT name, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS id FROM s WHERE nullif(name, '') IS NOT NULL GROUP BY 1),
    k3 AS (SELECT address, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS id FROM s WHERE address IS NOT NULL GROUP BY 1),
    j AS (SELECT c_custkey, CASE WHEN k1.n IS NOT NULL THEN 'tax_id' WHEN k2.n IS NOT NULL THEN 'name' WHEN k3.n IS NOT NULL THEN 'address' END AS lv, coalesce(k1.n, k2.n, k3.n) AS n, coalesce(k1.id, k2.id, k3.id) AS id
          FROM c LEFT JOIN k1 USING (tax_id) LEFT JOIN k2 USING (name) LEFT JOIN k3 USING (address)),
    a AS (SELECT c_custkey, CASE WHEN n = 1 THEN lv END AS level, CASE WHEN n = 1 THEN id END AS aligned_id, CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN 'multiple_candidates' ELSE 'no_match' END AS reason FROM j)
"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = lambda c: F.nullif(F.regexp_extract(c, "#0*([1-9][0-9]*)$", 1), F.lit(""))
    tax = lambda nation, balance: F.concat_ws("|", nation, F.floor(F.col(balance) / 500))
    subjects = table(spark, sf_dir, "supplier").select("s_suppkey", tax("s_nationkey", "s_acctbal").alias("tax_id"), F.when(F.col("s_suppkey") % 3 == 0, digits("s_name")).alias("name"), F.col("s_nationkey").alias("address"))
    records = table(spark, sf_dir, "customer").select("c_custkey", tax("c_nationkey", "c_acctbal").alias("tax_id"), digits("c_name").alias("name"), F.col("c_nationkey").alias("address"))
    return alignment.cascade(records, subjects, ["tax_id", "name", "address"], "s_suppkey")


@query(f"WITH {_ALIGN} SELECT c_custkey, level, aligned_id, reason FROM a")
def alignment_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("c_custkey", "level", "aligned_id", "reason")


@query(f"WITH {_ALIGN} SELECT level, reason, count(*) AS n, round((SELECT count(level) FROM a) / (SELECT count(*) FROM a), 6) AS alignment_rate FROM a GROUP BY 1, 2")
def alignment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.statistics(_aligned(spark, sf_dir))


@query(f"WITH {_ALIGN} SELECT count(level) AS aligned, count(*) AS total, round(count(level) / count(*), 6) AS alignment_rate, count(level) / count(*) >= 0.95 AS passed FROM a")
def alignment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.rate(_aligned(spark, sf_dir))


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))


@query("""WITH p AS (SELECT p_name || ' ' || lower(p_type) AS name, count(*) AS members, min(p_partkey) AS id FROM part GROUP BY 1),
    g AS (SELECT *, list_distinct(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) AS b FROM p),
    m AS (SELECT x.name AS left_name, y.name AS right_name, x.id AS left_id, y.id AS right_id, x.members AS left_members, y.members AS right_members,
          round(len(list_intersect(x.b, y.b)) / len(list_distinct(list_concat(x.b, y.b))), 6) AS similarity FROM g x JOIN g y ON substr(x.name, 1, 2) = substr(y.name, 1, 2) AND x.name < y.name)
    SELECT *, CASE WHEN similarity >= 0.9 THEN 'auto_merged' ELSE 'human_review' END AS tier FROM m WHERE similarity >= 0.7""")
def entity_resolution_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.candidates(_part_names(spark, sf_dir), with_ratio=False)


@query()
def entity_resolution_with_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.candidates(_part_names(spark, sf_dir))


_STATUS = """e AS (SELECT o_orderkey AS fact_id, o_custkey AS head, o_orderpriority AS tail, o_orderdate::DATE AS valid_from, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def _status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("head"), F.col("o_orderpriority").alias("tail"), day.alias("valid_from"), F.lead(day).over(w).alias("valid_to"))


@query(f"WITH {_STATUS} SELECT fact_id, head, tail, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM e WHERE valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to > DATE '{AS_OF}')")
def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.snapshot(_status_edges(spark, sf_dir), AS_OF)
    return found.select("fact_id", "head", "tail", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


@query(f"WITH {_STATUS} SELECT tail, count(*) AS n, count(valid_from) AS with_from, count(valid_to) AS with_to FROM e GROUP BY 1")
def edge_temporal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.coverage(_status_edges(spark, sf_dir), "tail")


_POLICIES = [("F", "single_current"), ("P", "append"), ("*", "single_current")]
_FACTS = """
    f AS (SELECT o_orderkey AS fact_id, o_custkey AS head, o_orderstatus AS relation, o_orderpriority AS tail, o_orderdate::DATE AS d, o_orderkey % 50 AS source, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate::DATE + 5 END AS ends FROM orders WHERE o_orderstatus <> 'P'),
    r1 AS (SELECT a.fact_id, min(b.d) AS expires_at FROM f a JOIN f b ON a.head = b.head AND a.relation = b.relation AND a.tail <> b.tail AND a.source <> b.source AND b.d > a.d WHERE a.ends IS NULL GROUP BY 1)
"""


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's priority by status, told by the fifty sources that orders come from; some facts have ended."""
    day = F.to_date("o_orderdate")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("head"), F.col("o_orderstatus").alias("relation"), F.col("o_orderpriority").alias("tail"), day.alias("valid_from"), (F.col("o_orderkey") % 50).alias("source"), F.when(F.col("o_orderkey") % 9 == 0, F.date_add(day, 5)).alias("valid_to"))
    return facts, spark.createDataFrame(_POLICIES, "relation string, policy string")


@query(f"WITH {_FACTS} SELECT fact_id, expires_at::VARCHAR AS expires_at FROM r1")
def single_current_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.earliest_expiry(temporal.superseded(*_facts(spark, sf_dir))).select("fact_id", F.col("expires_at").cast("string"))


@query(f"WITH {_FACTS} SELECT o_orderkey AS fact_id, coalesce(ends, expires_at)::VARCHAR AS valid_to FROM orders LEFT JOIN f ON fact_id = o_orderkey LEFT JOIN r1 USING (fact_id)")
def arbitration_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact with the day that closes it; facts whose relation appends stay open."""
    facts, policies = _facts(spark, sf_dir)
    appends = F.when(F.col("relation") != "P", F.col("valid_to")).alias("valid_to")
    rows = temporal.sealed(facts.select("fact_id", appends), temporal.superseded(facts, policies))
    return rows.select("fact_id", F.col("valid_to").cast("string"))


_ANCHORED = """
    l AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id, l_suppkey AS head, l_returnflag AS relation, l_partkey % 5 AS tail, CASE WHEN l_quantity > 1 THEN date_trunc('month', l_shipdate)::DATE END AS d, CASE WHEN l_quantity < 50 THEN l_linenumber END AS pos, [l_orderkey, l_partkey, l_suppkey, l_quantity::BIGINT] AS ord FROM lineitem),
    g AS (SELECT head, relation, d, count(*) AS n, count(pos) AS known, arg_max(tail, [[pos]::BIGINT[], ord]) AS kept FROM l WHERE d IS NOT NULL AND relation <> 'A' GROUP BY 1, 2, 3)
"""


@query(f"WITH {_ANCHORED} SELECT fact_id, min(l.d)::VARCHAR AS expires_at FROM l JOIN g USING (head, relation, d) WHERE n > 1 AND n = known AND tail <> kept GROUP BY 1")
def same_anchor_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a supplier delivers in a month: of several parts the last by line stays, where all lines are known."""
    ordinal = F.array("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), F.col("l_suppkey").alias("head"), F.col("l_returnflag").alias("relation"), (F.col("l_partkey") % 5).alias("tail"),
        F.when(F.col("l_quantity") > 1, F.trunc("l_shipdate", "month")).alias("valid_from"), F.when(F.col("l_quantity") < 50, F.col("l_linenumber")).alias("tail_position"), ordinal.alias("ordinal"),
    )
    policies = spark.createDataFrame([("N", "single_current"), ("R", "single_current")], "relation string, policy string")
    return temporal.earliest_expiry(temporal.same_anchor(lines, policies)).select("fact_id", F.col("expires_at").cast("string"))


@query("""WITH present AS (SELECT n_nationkey AS id, unnest(CASE n_nationkey % 4 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [1, 2] WHEN 2 THEN [2] ELSE [0, 2] END) AS rank FROM nation),
    scopes AS (SELECT n_nationkey AS id, unnest(CASE n_nationkey % 8 WHEN 1 THEN [0] WHEN 2 THEN [1] WHEN 3 THEN [1] ELSE [0]::INT[] END) AS rank FROM nation),
    p AS (SELECT id, min(rank) AS rank FROM present GROUP BY 1),
    d AS (SELECT id, min(rank) AS gone FROM (SELECT * FROM scopes EXCEPT SELECT * FROM present) GROUP BY 1)
    SELECT id, rank FROM p LEFT JOIN d USING (id) WHERE gone IS NULL OR rank < gone""")
def version_chain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the nations: kept, superseded, removed and made anew."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    ranks = lambda *x: F.array(*(F.lit(i) for i in x))
    kind = F.col("id") % 4
    present = n.select("id", F.explode(F.when(kind == 0, ranks(0, 1, 2)).when(kind == 1, ranks(1, 2)).when(kind == 2, ranks(2)).otherwise(ranks(0, 2))).alias("rank"))
    kind = F.col("id") % 8
    scopes = n.select("id", F.when(kind.isin(2, 3), 1).otherwise(0).alias("rank"))
    return versions.visible(present, scopes)


@query("""SELECT l_orderkey, l_partkey, l_linenumber::INT AS l_linenumber, l_shipdate::DATE::VARCHAR AS shipped FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC) AS nth FROM lineitem) WHERE nth = 1""")
def newest_edge_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions.newest_per(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], [F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_suppkey")])
    return rows.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("int"), F.to_date("l_shipdate").cast("string").alias("shipped"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate::DATE::VARCHAR AS ready_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS nth FROM orders WHERE o_orderstatus = 'F') WHERE nth = 1""")
def latest_ready_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finished order of each customer, as the latest ready version of a tenant."""
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return versions.newest_per(ready, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("ready_at"))
