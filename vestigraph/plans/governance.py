"""Queries on masking, access, listings, validation and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.functions import text as tx
from vestigraph.operators import governance
from vestigraph.plans.registry import query, table
from vestigraph.sources import tables


@query("""WITH c AS (SELECT c_custkey, '1' || lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '0') AS phone, '6228' || lpad((c_custkey * 104729 % 1000000000000000)::VARCHAR, (8 + c_custkey % 8)::INT, '0') AS account, 'INV' || c_custkey AS invoice, c_name AS person FROM customer)
    SELECT c_custkey, CASE WHEN length(phone) < 8 THEN '****' ELSE substr(phone, 1, 3) || '****' || right(phone, 4) END AS phone, substr(account, 1, 4) || ' ' || trim(repeat('**** ', ceil((length(account) - 8) / 4)::INT)) || ' ' || right(account, 4) AS account,
    CASE WHEN length(invoice) < 8 THEN '****' ELSE substr(invoice, 1, 4) || '****' || right(invoice, 4) END AS invoice, sha256('salt|' || lower(regexp_replace(person, '[^0-9A-Za-z]', '', 'g'))) AS person FROM c""")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    phone = F.concat(F.lit("1"), F.lpad((key * 7919 % 10000000000).cast("string"), 10, "0"))
    account = F.concat(F.lit("6228"), F.expr("lpad(cast(c_custkey * 104729 % 1000000000000000 as string), cast(8 + c_custkey % 8 as int), '0')"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.mask_phone(phone).alias("phone"), tx.mask_account(account).alias("account"), tx.mask_invoice(F.concat(F.lit("INV"), key)).alias("invoice"), tx.mask_hashed(F.col("c_name"), "salt").alias("person"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS d FROM customer)
    SELECT k, 'amount' AS category, CASE WHEN k % 9 = 0 THEN '' ELSE '***,***.00' END AS masked FROM c UNION ALL SELECT k, 'invoice', CASE WHEN k % 9 = 0 THEN '****' ELSE 'INV2****' || right(d, 4) END FROM c
    UNION ALL SELECT k, 'account', CASE WHEN k % 9 = 0 THEN '****' ELSE '6228 **** ' || right(d, 4) END FROM c UNION ALL SELECT k, 'phone', CASE WHEN k % 9 = 0 THEN '****' ELSE '861****' || right(d, 4) END FROM c
    UNION ALL SELECT k, 'filename', sha256(n || '.pdf') FROM c UNION ALL SELECT k, 'hashed', sha256('salt|' || lower(regexp_replace(n, '[^0-9A-Za-z]', '', 'g'))) FROM c""")
def mask_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all categories for each customer, written in several ways; of every ninth too short to show anything."""
    k, short = F.col("c_custkey"), F.col("c_custkey") % 9 == 0
    d = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0")
    values = {
        "amount": F.when(short, " ").otherwise(F.concat("c_acctbal", F.lit(" 元"))), "invoice": F.when(short, "INV 1").otherwise(F.concat(F.lit("INV 2024 "), d)), "account": F.when(short, "12345678").otherwise(F.concat(F.lit("６２２８ "), d)),
        "phone": F.when(short, "123-4567").otherwise(F.concat(F.lit("+86 1"), d)), "filename": F.concat("c_name", F.lit(".pdf")), "hashed": F.col("c_name"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), v.alias("value")) for c, v in values.items())))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), each.alias("v")).select("k", "v.*")
    out = F.when(F.lit(False), F.col("value"))
    for category in tx.SENSITIVE:
        out = out.when(F.col("category") == category, tx.masked(F.col("value"), category, "salt"))
    return rows.select("k", "category", out.alias("masked"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{"amount": "***,***.00", "note": "' || c_mktsegment || '", "who": {"phone": "138****' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '", "deep": [{"tax_id": "' || sha256('salt|t' || c_custkey) || '"}, "13812345678"]}, "n": ' || c_nationkey || '}'
    WHEN 1 THEN '{"secret": "****"}' WHEN 2 THEN '****' END AS masked, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE 'segment=' || c_mktsegment || ' phone=138****' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS fields FROM customer""")
def mask_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log record for each customer: nested objects and lists, a field of an unknown category, what is no object, none; and its fields as a map."""
    k, phone = F.col("c_custkey"), F.concat(F.lit("138 0000 "), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    deep = F.concat(F.lit('{"amount": "'), "c_acctbal", F.lit('", "note": "'), "c_mktsegment", F.lit('", "who": {"phone": "'), phone, F.lit('", "deep": [{"tax_id": "T-'), k, F.lit('"}, "13812345678"]}, "n": '), "c_nationkey", F.lit("}"))
    payload = F.when(k % 4 == 0, deep).when(k % 4 == 1, F.concat(F.lit('{"secret": "'), k, F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit("["), k, F.lit("]")))
    fields = tx.masked_map(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("phone"), phone), "salt")
    joined = F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.masked_json(payload, "salt", {"secret": "unknown"}).alias("masked"), F.when(k % 4 != 3, joined).alias("fields"))


_GRANTS = [("ana", "reader", "nation", "read", "0,1,2"), ("ana", "auditor", "nation", "read", "2,3"), ("ben", "admin", "nation", "read", None), ("ben", "reader", "nation", "read", "4"), ("cy", "reader", "nation", "write", "5")]


@query(f"""WITH g(person, role, resource, action, scope) AS (VALUES {', '.join(str(x).replace('None', 'NULL') for x in _GRANTS)}), s AS (SELECT person, bool_or(scope IS NULL) AS every, string_agg(scope, ',') AS ids FROM g WHERE resource = 'nation' AND action = 'read' GROUP BY 1)
    SELECT person, n_nationkey FROM s JOIN nation ON every OR list_contains(string_split(ids, ','), n_nationkey::VARCHAR)""")
def rbac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = spark.createDataFrame(_GRANTS, "person string, role string, resource string, action string, scope string")
    roles = spark.createDataFrame([(r, r, "o1") for r in ("reader", "auditor", "admin")], "role_id string, role string, org_id string")
    own = governance.role_grants(grants.withColumnRenamed("role", "role_id").withColumn("org_id", F.lit("o1")), roles)
    return governance.permitted(own, table(spark, sf_dir, "nation").select("n_nationkey"), "nation", "read", "n_nationkey")


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey % 40 AS person, split_part(o_orderpriority, '-', 1)::INT AS resource, CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'write' ELSE 'delete' END AS action, CASE WHEN o_orderkey % 6 = 0 THEN 's' || o_orderkey % 4 END AS scene, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 END AS doc FROM orders),
    r AS (SELECT DISTINCT c_custkey % 40 AS person, 'role' || c_nationkey % 3 AS role FROM customer WHERE c_custkey % 40 % 9 <> 8), m AS (SELECT 'role' || i AS role, j AS resource, a AS action FROM range(3) t(i), range(1, 6) u(j), (VALUES ('read', 0), ('write', 1)) v(a, w) WHERE (i + j + w) % 3 <> 0),
    x AS (SELECT q.*, coalesce(scene, CASE WHEN resource < 4 THEN 's' || resource END) AS asked FROM q)
    SELECT id, CASE WHEN person NOT IN (SELECT person FROM r) THEN 'no_role_assignment' WHEN NOT EXISTS (SELECT 1 FROM r JOIN m USING (role) WHERE r.person = x.person AND m.resource = x.resource AND m.action = x.action) THEN 'action_not_permitted'
        WHEN asked IS NOT NULL AND person % 4 = 1 AND asked NOT IN ('s1', 's2') THEN 'scene_not_in_scope' WHEN doc IS NOT NULL AND person % 5 = 2 AND doc >= 5 OR doc IS NOT NULL AND person % 5 = 3 THEN 'document_not_in_scope' END AS reason FROM x""")
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests of forty people: roles from their customers' nations, a matrix of roles, scenes of most resources, and limits to scenes, documents or nothing."""
    k, person = F.col("o_orderkey"), (F.col("o_custkey") % 40).alias("person")
    action = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "write").otherwise("delete")
    requests = table(spark, sf_dir, "orders").select(k.alias("id"), person, F.substring_index("o_orderpriority", "-", 1).cast("int").alias("resource"), action.alias("action"), F.when(k % 6 == 0, F.concat(F.lit("s"), k % 4)).alias("scene"), F.when(k % 3 != 0, (k % 10).cast("string")).alias("document_id"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("person"), "c_nationkey")
    roles = customer.where("person % 9 != 8").select("person", F.concat(F.lit("role"), F.col("c_nationkey") % 3).alias("role")).distinct()
    matrix = [(f"role{i}", j, a) for i in range(3) for j in range(1, 6) for w, a in enumerate(("read", "write")) if (i + j + w) % 3]
    scenes = spark.createDataFrame([(j, f"s{j}") for j in range(1, 4)], "resource int, scene string")
    people = customer.select("person").distinct()
    of = lambda condition, kind, ids: people.where(condition).select("person", F.lit(kind).alias("kind"), F.explode(F.array(*(F.lit(i) for i in ids))).alias("id"))
    limits = of("person % 4 = 1", "scene", ("s1", "s2")).unionByName(of("person % 5 = 2", "document", ("0", "1", "2", "3", "4"))).unionByName(people.where("person % 5 = 3").select("person", F.lit("document").alias("kind"), F.lit(None).cast("string").alias("id")))
    return governance.decisions(requests, roles, spark.createDataFrame(matrix, "role string, resource int, action string"), scenes, limits).select("id", "reason")


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.page(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 20, 40)


@query("""SELECT o_orderkey::VARCHAR AS key, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT (o_totalprice > 1000) THEN 'amount' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_orderdate < TIMESTAMP '1995-02-01' THEN 'date' END]) AS rule FROM orders) WHERE rule IS NOT NULL
    UNION ALL SELECT o_totalprice::DECIMAL(14,2)::VARCHAR, 'unique price' FROM orders GROUP BY o_totalprice::DECIMAL(14,2) HAVING count(*) > 1""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(14,2)"))
    broken = {"amount": ~(F.col("o_totalprice") > 1000), "status": ~F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") < F.lit("1995-02-01").cast("timestamp")}
    return tables.violations(rows, "o_orderkey", broken, ["price"])


@query("SELECT c_custkey, c_name, NULL::VARCHAR AS region FROM customer")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.projected(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "region"])


@query("""SELECT o_custkey AS src, o_orderpriority AS dst, CASE WHEN c_custkey IS NULL THEN 'src' WHEN o_orderpriority = '5-LOW' THEN 'dst' END AS missing_end FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey""")
def csv_edges_same_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> priority edges, kept where both ends are nodes; the rest with the end that is missing."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"))
    nodes = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("id")).unionByName(edges.where("dst != '5-LOW'").select(F.col("dst").alias("id")))
    good, lost = tables.linked(edges, nodes, ("src", "dst"))
    return good.withColumn("missing_end", F.lit(None).cast("string")).unionByName(lost).withColumn("src", F.col("src").cast("long"))


@query("""SELECT props, (regexp_extract(props, '"k": ([0-9]+)', 1))::BIGINT AS k, 'int' AS kind, count(*) AS n FROM events GROUP BY ALL""")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select("props", value.cast("long").alias("k"), tx.coerced(value)["kind"].alias("kind"))
    return rows.groupBy("props", "k", "kind").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, list_transform([regexp_extract(text, '[0-9A-Za-z]+(?:[-_./][0-9A-Za-z]+)*')], lambda x: nullif(lower(x), ''))[1] AS first_token, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS snippet, 'DOC:' || substr(sha256(doc_id::VARCHAR || '|' || source), 1, 16) AS node_id FROM documents""")
def document_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.nullif(F.lower(F.regexp_extract("text", tx.TOKEN, 1)), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("first_token"), tx.snippet(F.col("text"), 80).alias("snippet"), tx.hashed_id("DOC", F.col("doc_id").cast("string"), F.col("source")).alias("node_id"))
