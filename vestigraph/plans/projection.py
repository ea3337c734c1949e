"""Queries on what readers are shown: overview, details, listings, and the life of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.functions import scope
from vestigraph.functions import text as tx
from vestigraph.operators import evaluation, ingest, patterns, projection, versions
from vestigraph.plans.registry import query, table

_SEEN = """
    n AS (SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ORG' WHEN 'BUILDING' THEN '法规' WHEN 'FURNITURE' THEN 'PERSON' WHEN 'MACHINERY' THEN '平台' END AS type, CASE WHEN c_custkey % 3 <> 0 THEN round(greatest(c_acctbal, 0) / 10000, 2) END AS confidence, c_nationkey FROM customer),
    own AS (SELECT * FROM (VALUES ('PERSON', 'org'), ('ORG', 'system')) t(type, cat))
"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = F.when(c("c_mktsegment") == "AUTOMOBILE", "ORG").when(c("c_mktsegment") == "BUILDING", "法规").when(c("c_mktsegment") == "FURNITURE", "PERSON").when(c("c_mktsegment") == "MACHINERY", "平台")
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), kind.alias("type"), F.when(c("c_custkey") % 3 != 0, F.round(F.greatest("c_acctbal", F.lit(0.0)) / 10000, 2)).alias("confidence"), "c_nationkey")


@query(f"""WITH {_SEEN} SELECT id, coalesce(type, '') AS type, CASE WHEN coalesce(type, '') = '' THEN 'topic' ELSE coalesce(cat, CASE type WHEN 'ORG' THEN 'org' WHEN '法规' THEN 'norm' WHEN '平台' THEN 'system' END, 'topic') END AS category,
    round(0.3 + least(coalesce(nullif(confidence, 0), 0.5), 1.0) * 1.35, 2)::DOUBLE AS weight, round((('0x' || substr(md5(id::VARCHAR), 1, 2))::INT) / 255.0, 3)::DOUBLE AS x FROM n LEFT JOIN own USING (type)""")
def overview_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes: category by the tenant's vocabulary, the built-in one or none, size by confidence, a seeded place."""
    own = spark.createDataFrame([("PERSON", "org"), ("ORG", "system")], "type string, cat string")
    rows = _customers(spark, sf_dir).join(own, "type", "left")
    return rows.select("id", F.coalesce("type", F.lit("")).alias("type"), projection.category(F.col("type"), F.col("cat")).alias("category"), projection.weight(F.col("confidence")).alias("weight"), projection.seed(F.col("id").cast("string"))["x"].alias("x"))


_TRADES = """
    r(kg_version, rank) AS (VALUES ('F', 1), ('O', 0)), e AS (SELECT o_orderkey AS id, o_custkey AS src, (o_orderkey * 7) % 150 AS dst, CASE WHEN o_orderpriority = '5-LOW' THEN 'PARTY_TO' WHEN o_orderpriority = '1-URGENT' THEN 'OWES' END AS semantic, CASE WHEN o_orderkey % 2 = 0 THEN 'RELATION' ELSE 'SUPPLIES_TO' END AS physical, o_orderstatus AS kg_version FROM orders),
    k AS (SELECT *, CASE WHEN semantic = 'PARTY_TO' THEN semantic WHEN physical = 'SUPPLIES_TO' THEN physical ELSE 'MENTIONS' END AS kind FROM e)
"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic = F.when(F.col("o_orderpriority") == "5-LOW", "PARTY_TO").when(F.col("o_orderpriority") == "1-URGENT", "OWES")
    physical = F.when(F.col("o_orderkey") % 2 == 0, "RELATION").otherwise("SUPPLIES_TO")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % 150).alias("dst"), projection.relation_type(semantic, physical).alias("kind"), F.col("o_orderstatus").alias("kg_version"))


@query(f"""WITH {_TRADES}, v AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 1000), b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY rank, id) AS nth FROM k JOIN r USING (kg_version) WHERE src <> dst AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v))
    SELECT src, dst, id, kind FROM b WHERE nth = 1""")
def overview_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges of versions F and O, of which O is newer; an edge for each ordered pair of customers in credit."""
    chain = spark.createDataFrame([("O", 0), ("F", 1)], "kg_version string, rank int")
    visible = table(spark, sf_dir, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("id"))
    return projection.overview_edges(_trades(spark, sf_dir), visible, chain)


@query(f"""WITH {_TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, kind, id) AS nth FROM k WHERE src <> dst), d AS (SELECT src AS id, count(*) AS n, sum((src <> dst)::INT) AS others FROM k GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM k GROUP BY 1)
    SELECT c_custkey AS id, o.dst AS neighbour, o.kind, coalesce(others, 0) > 5 AS has_more, coalesce(d.n, 0)::BIGINT AS out_degree, coalesce(i.n, 0)::BIGINT AS in_degree FROM customer LEFT JOIN d ON d.id = c_custkey LEFT JOIN i ON i.id = c_custkey LEFT JOIN o ON o.src = c_custkey AND nth <= 5""")
def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first five out-neighbours, whether there are more, and its edges out and in."""
    return projection.neighbours(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), _trades(spark, sf_dir), 5)


@query("""SELECT c_custkey AS id, unnest(['segment', 'balance']) AS label, unnest([c_mktsegment, c_acctbal::VARCHAR]) AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_custkey % 2 = 1""")
def entity_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' properties without what is stored or shown elsewhere, and without nulls."""
    c, key = F.col, F.col("c_custkey")
    props = F.create_map(*(x for k, v in {"id": key.cast("string"), "kg_version": F.lit("v"), "pii_flags": F.lit("x"), "name": c("c_name"), "segment": c("c_mktsegment"), "balance": F.when(key % 2 == 0, c("c_acctbal").cast("string"))}.items() for x in (F.lit(k), v)))
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), projection.stripped(props).alias("properties"))
    return projection.attributes(rows)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'RELATED' END AS kind FROM orders""")
def type_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("never",)], "kind string")
    return projection.typed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind")), known)


_NODE_KINDS = "CASE o_orderstatus WHEN 'F' THEN 'SHIFT' WHEN 'O' THEN 'LEAVE' ELSE 'OTHER' END"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'key' || o_custkey WHEN o_orderkey % 5 = 0 THEN 'name' || o_custkey ELSE CASE {_NODE_KINDS} WHEN 'SHIFT' THEN o_orderdate::DATE::VARCHAR || ' early' WHEN 'LEAVE' THEN 'annual ' || o_orderdate::DATE::VARCHAR ELSE 'OTHER:' || o_orderkey END END AS name FROM orders""")
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own key, else name, else the template of the type, else the id."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    kind = F.expr(_NODE_KINDS)
    templates = {"SHIFT": F.concat_ws(" ", day, F.lit("early")), "LEAVE": F.concat_ws(" ", F.lit("annual"), day)}
    own = lambda n, word: F.when(key % n == 0, F.concat(F.lit(word), "o_custkey"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), ingest.node_name(kind, own(7, "key"), own(5, "name"), templates, F.concat(kind, F.lit(":"), key)).alias("name"))


_SUSPECTED = "s AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 200000 THEN 'medium' ELSE 'low' END AS severity, o_orderdate AS created_at, o_orderstatus AS status FROM orders)"


def _suspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_totalprice") > 400000, "high").when(F.col("o_totalprice") > 200000, "medium").otherwise("low")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), severity.alias("severity"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))


@query(f"WITH {_SUSPECTED} SELECT id, severity FROM s WHERE status = 'F' ORDER BY severity, created_at, id LIMIT 200")
def suspicion_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing goes by the severity's name, unlike the summary."""
    return projection.suspicions(_suspected(spark, sf_dir), status="F", severity=None).select("id", "severity")


@query(f"WITH {_SUSPECTED} SELECT id AS employee_id, severity AS level, status AS rule, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id, status) AS nth FROM s WHERE status = 'P' AND severity <> 'low'")
def finding_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _suspected(spark, sf_dir).where("severity != 'low'").select(F.col("id").alias("employee_id"), F.col("severity").alias("level"), F.col("status").alias("rule"))
    return projection.numbered(projection.findings(rows, rule="P"))


_ATTENDANCE = "a AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'ent_' ELSE 'EMPLOYEE:' END || user_id AS employee_id, ts::DATE::VARCHAR AS date, CASE event_type WHEN 'error' THEN 'absent' WHEN 'signup' THEN 'missing_check_in' WHEN 'click' THEN 'missing_check_out' ELSE 'normal' END AS status FROM events)"


@query(f"WITH {_ATTENDANCE} SELECT substr(employee_id, 10) AS employee_id, date, status FROM a WHERE status IN ('absent', 'missing_check_in') AND employee_id LIKE 'EMPLOYEE:%'")
def anomaly_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attendance: a missing check-out is no anomaly, and extracted people don't count."""
    who = F.concat(F.when(F.col("user_id") % 5 == 0, "ent_").otherwise("EMPLOYEE:"), "user_id")
    status = F.when(F.col("event_type") == "error", "absent").when(F.col("event_type") == "signup", "missing_check_in").when(F.col("event_type") == "click", "missing_check_out").otherwise("normal")
    return projection.anomalies(table(spark, sf_dir, "events").select(who.alias("employee_id"), F.to_date("ts").cast("string").alias("date"), status.alias("status")))


@query("""SELECT o_custkey AS org_id, arg_max(o_orderkey, [epoch_us(o_orderdate), o_orderkey]) AS id, max(o_orderdate)::DATE::VARCHAR AS completed_at FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 0 GROUP BY 1""")
def latest_completed_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("org_id"), F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("completed_at"))
    return projection.latest_task(tasks).select("org_id", "id", F.to_date("completed_at").cast("string").alias("completed_at"))


@query("""WITH d AS (SELECT doc_id, sha256('file' || doc_id || '.pdf') AS filename_hash, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 30 END AS version_id FROM documents) SELECT doc_id, filename_hash, version_id, n AS entity_count FROM d LEFT JOIN (SELECT c_nationkey AS version_id, count(*) AS n FROM customer GROUP BY 1) USING (version_id) WHERE filename_hash LIKE 'a%'""")
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose file name's digest begins with A, with the entity count of their version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.filename_hash(F.concat(F.lit("file"), "doc_id", F.lit(".pdf"))).alias("filename_hash"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 30).alias("version_id"))
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("version_id")).agg(F.count("*").alias("entity_count"))
    return projection.with_counts(projection.hash_search(docs, " A "), counts).select("doc_id", "filename_hash", "version_id", "entity_count")


@query("SELECT c_nationkey AS org_id FROM customer UNION SELECT s_nationkey FROM supplier")
def tenant_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.tenants(*(table(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").alias("org_id")) for t in ("customer", "supplier")))


@query("""WITH a AS (SELECT 'shared_address' AS kind, x.s_suppkey AS a, y.s_suppkey AS b, x.s_nationkey AS s FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)
    SELECT kind, a || ',' || b || ',' || s AS members, NULL::VARCHAR AS details FROM a UNION ALL SELECT 'cycle', l_orderkey || ',' || l_partkey, 'hops 2' FROM lineitem""")
def suspicion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits and algorithm hits in one shape."""
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("string").alias("dst"))
    rules = patterns.pairs_by_tiles(members).select(F.lit("shared_address").alias("kind"), F.col("left_id").cast("string").alias("a"), F.col("right_id").cast("string").alias("b"), "shared")
    cycles = table(spark, sf_dir, "lineitem").select(F.lit("cycle").alias("kind"), F.array(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("members"), F.lit("hops 2").alias("details"))
    return projection.hits(rules, cycles).withColumn("members", F.array_join("members", ","))


@query("""WITH h AS (SELECT conv_id AS path_id, turn AS hop, conv_id % 40 AS source_id, turn % 7 AS target_id, regexp_extract(text, '[A-Z][a-z]{6,}') AS target_name, text FROM conversations), c AS (SELECT conv_id AS path_id, turn AS nth, 'c' || turn AS chunk_id, text FROM conversations WHERE role = 'user'), e AS (SELECT DISTINCT o_custkey % 40 AS a, o_orderkey % 7 AS b FROM orders WHERE o_orderkey % 5 = 0)
    SELECT path_id, hop, CASE WHEN ev IS NOT NULL THEN 'document' WHEN EXISTS (SELECT 1 FROM e WHERE (a = source_id AND b = target_id) OR (a = target_id AND b = source_id)) THEN 'graph' ELSE 'cypher' END AS origin, ev AS evidence
    FROM (SELECT h.*, (SELECT 'chunk:' || arg_min(c.chunk_id, c.nth) FROM c WHERE c.path_id = h.path_id AND h.target_name <> '' AND contains(c.text, h.target_name)) AS ev FROM h)""")
def hop_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as hops to what they name: said by a user, known as an edge, or found by the search."""
    talk = table(spark, sf_dir, "conversations")
    hops = talk.select(F.col("conv_id").alias("path_id"), F.col("turn").alias("hop"), (F.col("conv_id") % 40).alias("source_id"), (F.col("turn") % 7).alias("target_id"), F.regexp_extract("text", "[A-Z][a-z]{6,}", 0).alias("target_name"))
    chunks = talk.where("role = 'user'").select(F.col("conv_id").alias("path_id"), F.concat(F.lit("c"), "turn").alias("chunk_id"), F.col("turn").alias("nth"), "text")
    edges = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select((F.col("o_custkey") % 40).alias("src"), (F.col("o_orderkey") % 7).alias("dst"))
    return projection.hop_origin(hops, edges, chunks).select("path_id", "hop", "origin", "evidence")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus || ',' END || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',c' || o_custkey % 7 END AS ids FROM orders""")
def anchored_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's status and priority first, then what else was found, each once; either may be missing."""
    k = F.col("o_orderkey")
    anchors = F.when(k % 5 != 0, F.array("o_orderstatus", "o_orderpriority", "o_orderstatus"))
    found = F.when((k % 3 != 0) | (k % 5 == 0), F.when(k % 3 == 0, F.array("o_orderpriority", "o_orderpriority")).otherwise(F.array("o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey") % 7))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(projection.ordered_union(anchors, found), ",").alias("ids"))


_ACTIONS = "a AS (SELECT c_nationkey AS org, 'v' || (c_custkey % 17) AS result, CASE WHEN c_custkey % 4 <> 0 THEN 'v' || ((c_custkey * 5 + 3) % 17) END AS parent, c_custkey AS created_at FROM customer)"


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    ids = F.to_json(F.struct(F.array(F.concat(F.lit("e"), key), F.concat(F.lit("e"), key % 3)).alias("entity_ids"), F.when(key % 2 == 0, F.array(F.concat(F.lit("n"), key))).alias("new_entity_ids")))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), F.concat(F.lit("v"), key % 17).alias("result"), F.when(key % 4 != 0, F.concat(F.lit("v"), (key * 5 + 3) % 17)).alias("parent"), key.alias("created_at"), key.alias("id"), F.when(key % 10 != 0, ids).otherwise("{broken").alias("target_entities"))


@query(f"""WITH RECURSIVE {_ACTIONS}, p AS (SELECT org, result, arg_max(parent, created_at) AS parent FROM a WHERE parent IS NOT NULL GROUP BY 1, 2), s AS (SELECT n_nationkey AS org, 'v' || n_nationkey % 17 AS version FROM nation),
    w AS (SELECT org, version AS start, version, [version] AS seen, 0 AS rank FROM s UNION ALL SELECT w.org, start, parent, list_append(seen, parent), rank + 1 FROM w JOIN p ON p.org = w.org AND p.result = w.version WHERE NOT list_contains(seen, parent) AND rank < 5)
    SELECT org, start, version, rank FROM w""")
def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as corrections that made one of seventeen versions; the chain of each nation's version, at most six long, cycles cut."""
    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org"), F.concat(F.lit("v"), F.col("n_nationkey") % 17).alias("version"))
    return versions.chains(starts, _actions(spark, sf_dir), 6)


@query(f"WITH {_ACTIONS}, u AS (SELECT org, result AS version, unnest(['e' || created_at, 'e' || created_at % 3, CASE WHEN created_at % 2 = 0 THEN 'n' || created_at END]) AS id FROM a WHERE created_at % 10 <> 0) SELECT DISTINCT * FROM u WHERE id IS NOT NULL")
def action_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each correction said it would change; broken JSON says nothing."""
    return versions.scopes(_actions(spark, sf_dir))


@query("""WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN 'o' || c_nationkey % 2 END AS org FROM customer) SELECT k AS id, CASE WHEN org IS NULL THEN 'missing' WHEN org = 'o1' THEN 'ok' ELSE 'leaked' END AS verdict FROM (SELECT DISTINCT o_custkey + 10 AS k FROM orders) LEFT JOIN e ON e.id = k""")
def scope_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted customers of tenant o1: its own, another tenant's, or not there at all."""
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("o"), F.col("c_nationkey") % 2)).alias("org_id"))
    return versions.probed(table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("id")), entities, "o1")


_STATES = ("pending", "building", "ready", "failed")


@query("""WITH s AS (SELECT o_orderkey AS version, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'building' WHEN 2 THEN 'ready' ELSE 'failed' END AS status, CASE o_orderkey // 4 % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'building' WHEN 2 THEN 'ready' WHEN 3 THEN 'failed' END AS wish FROM orders),
    g AS (SELECT *, coalesce((status, wish) IN (('pending', 'building'), ('building', 'ready'), ('building', 'failed'), ('pending', 'failed')), false) AS good FROM s)
    SELECT version, CASE WHEN good THEN wish ELSE status END AS status, CASE WHEN good AND wish = 'ready' THEN version END AS entity_count, CASE WHEN good AND wish = 'failed' THEN 'E' || version END AS error_code, wish IS NOT NULL AND NOT good AS refused FROM g""")
def version_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions in every state, each asked to move to another, or left alone."""
    key = F.col("o_orderkey")
    pick = lambda n: F.try_element_at(F.array(*(F.lit(s) for s in _STATES)), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(key.alias("version"), pick(key % 4).alias("status"), pick(F.expr("o_orderkey div 4 % 5")).alias("to"))
    changes = rows.where("to is not null").select("version", "to", F.col("version").alias("entity_count"), F.col("version").alias("relation_count"), F.concat(F.lit("E"), "version").alias("error_code"))
    return versions.moved(rows.drop("to"), changes).select("version", "status", "entity_count", "error_code", "refused")


@query("""WITH t AS (SELECT c_custkey AS org, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE 'v' || c_custkey % 3 END AS active, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS found, CASE WHEN c_custkey % 4 <> 0 THEN 'v' || c_custkey % 2 END AS manifest FROM customer),
    c AS (SELECT *, CASE WHEN coalesce(active, '') = '' THEN 'no_active_version' WHEN found IS NULL THEN 'graph_unreachable' WHEN found THEN 'pg_graph_consistent' ELSE 'ghost_version' END AS code FROM t)
    SELECT org, code, code IN ('no_active_version', 'pg_graph_consistent') AS ok, coalesce(active <> '' AND manifest <> active, false) AS drift FROM c""")
def version_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenants: with an active version or none or an empty name, in the graph or not or unreachable, and a backup that may name another."""
    k, v = F.col("c_custkey"), lambda n: F.concat(F.lit("v"), F.col("c_custkey") % n)
    active = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 11 == 0, "").otherwise(v(3))
    found = F.when(k % 5 == 1, False).when(k % 5 != 0, True)
    return table(spark, sf_dir, "customer").select(k.alias("org"), versions.consistency(active, found, F.when(k % 4 != 0, v(2))).alias("c")).select("org", "c.*")


@query("""SELECT c_custkey, c_nationkey % 3 = 0 OR c_nationkey % 3 = 1 AS permissive, coalesce(c_nationkey % 3 = 1, false) AS semi, c_nationkey % 3 = 1 AS strict, (SELECT count(*) FROM customer WHERE c_nationkey % 3 = 2) AS leaked FROM customer""")
def tenant_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three forms of the tenant's predicate, and how many rows belong to others."""
    kind = F.col("c_nationkey") % 3
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(kind != 0, F.concat(F.lit("o"), kind)).alias("org_id"))
    leaked = scope.leaked(rows, "o1")
    seen = rows.select("c_custkey", scope.permissive_tenant(F.col("org_id"), "o1").alias("permissive"), scope.semi_strict_tenant(F.col("org_id"), "o1").alias("semi"), scope.strict_tenant(F.col("org_id"), "o1").alias("strict"))
    return seen.join(F.broadcast(leaked))


@query("SELECT o_orderkey AS id, o_orderstatus AS kg_version FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderstatus = 'F') OR (o_orderkey % 3 = 1 AND o_orderstatus = 'O')")
def version_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a selection of (id, version) names."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kg_version"))
    wanted = rows.select("id", F.when(F.col("id") % 3 == 0, "F").when(F.col("id") % 3 == 1, "O").alias("kg_version"))
    return scope.in_selection(rows, wanted)


@query("""SELECT 'type ' || p_brand AS measure, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'ungrounded', count_if(p_size <= 25) FROM part UNION ALL SELECT 'derived', count_if(l_quantity = 50) FROM lineitem""")
def extraction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), (F.col("p_size") > 25).alias("grounded"))
    return evaluation.extraction_stats(entities, table(spark, sf_dir, "lineitem").select((F.col("l_quantity") == 50).alias("derived")))


@query("""SELECT o_orderkey, 'fact' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS fact, lpad(o_orderkey::VARCHAR, CASE WHEN o_orderkey % 4 = 0 THEN 17 ELSE 18 END, '0') ~ '^[0-9A-HJ-NPQRTUWXY]{18}$' AS tax_ok FROM orders""")
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading dates of texts, and the form of tax ids."""
    key = F.col("o_orderkey")
    day = F.when(key % 3 == 0, "n/a").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 08:00")))
    tax = F.lpad(key.cast("string"), F.when(key % 4 == 0, 17).otherwise(18), F.lit("0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("fact"), F.coalesce(tx.fact_date(day), F.lit(""))).alias("fact"), tx.is_tax_id(tax).alias("tax_ok"))
