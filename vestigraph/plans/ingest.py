"""Queries from records to graph rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.functions import text as tx
from vestigraph.operators import alignment, ingest
from vestigraph.plans.registry import query, table


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), v AS (SELECT 'name' AS kind, k, CASE k % 4 WHEN 0 THEN '股份' ELSE 'Org' || n END AS normal FROM s UNION ALL SELECT 'address', k, 'No' || k || '浦东ab' || n FROM s)
    SELECT *, substr(sha256(normal), 1, 16) AS digest FROM v""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and addresses of suppliers, written with wide digits, white space, marks and a suffix, or as a suffix alone."""
    wide = lambda c: F.translate(c.cast("string"), "0123456789", "０１２３４５６７８９")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    name = F.when(k % 4 == 0, "股份有限公司").when(k % 4 == 1, F.concat(F.lit("Org "), wide(n), F.lit(" 股份有限公司"))).when(k % 4 == 2, F.concat(F.lit(" Ｏrg"), n, F.lit("有限责任公司"))).otherwise(F.concat(F.lit("Org　"), wide(n), F.lit("有限公司")))
    address = F.concat(F.lit("No. "), wide(k), F.lit("，浦东（ab）-"), n, F.lit("!"))
    each = F.explode(F.array(F.struct(F.lit("name").alias("kind"), tx.normal_name(name).alias("normal")), F.struct(F.lit("address").alias("kind"), tx.normal_address(address).alias("normal"))))
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), each.alias("v")).select("k", "v.*")
    return rows.withColumn("digest", F.substring(tx.shared_id("X", F.col("normal")), 3, 16))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '{"a": ' || c_custkey || '}' WHEN 1 THEN '{"a": {"b": "' || c_name || '"}}' WHEN 2 THEN '{"entities": []}' END AS object FROM customer""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer on each customer: fenced, among words, alone, no object, none at all, two at once."""
    k = F.col("c_custkey")
    answer = F.when(k % 6 == 0, F.concat(F.lit('```json\n{"a": '), k, F.lit("}\n```"))).when(k % 6 == 1, F.concat(F.lit('Here it is: {"a": {"b": "'), "c_name", F.lit('"}} as asked'))).when(k % 6 == 2, '{"entities": []}').when(k % 6 == 3, F.concat(F.lit("["), k, F.lit("]"))).when(k % 6 == 4, F.concat(F.lit('{"a": '), k, F.lit('} and {"b": 2}')))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.json_object(answer).alias("object"))


@query("""WITH e AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN 'n' || c_nationkey END AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE ' ' END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS type, c_custkey FROM customer)
    SELECT id, arg_min(name, c_custkey) AS name, coalesce(arg_min(struct_pack(t := type), c_custkey).t, 'OTHER') AS type, 'segment' AS fields FROM e WHERE id IS NOT NULL AND trim(name) <> '' GROUP BY 1""")
def entity_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities of their nation: blank ids and names go, the first of each id stays, flags are never stored."""
    c, key = F.col, F.col("c_custkey")
    attributes = F.create_map(F.lit("pii_flags"), F.lit("x"), F.lit("segment"), c("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.when(key % 10 != 0, F.concat(F.lit("n"), "c_nationkey")).alias("id"), F.when(key % 7 != 0, c("c_name")).otherwise(" ").alias("name"), F.when(key % 3 != 0, c("c_mktsegment")).alias("type"), attributes.alias("attributes"), key)
    return ingest.entity_rows(rows, ["c_custkey"]).select("id", "name", "type", F.array_join(F.map_keys("attributes"), ",").alias("fields"))


_KINDS = "CASE o_orderpriority WHEN '1-URGENT' THEN '控股' WHEN '2-HIGH' THEN '股权持有' WHEN '3-MEDIUM' THEN '经营业务板块' WHEN '4-NOT SPECIFIED' THEN NULL ELSE '别的' END"


@query(f"""WITH e AS (SELECT c_name AS name, min('c' || c_custkey) AS id FROM customer WHERE c_acctbal >= 0 GROUP BY 1), r AS (SELECT 'r' || o_orderkey AS rel_id, c_name AS head, 'Customer#' || lpad((o_orderkey % 150 + 1)::VARCHAR, 9, '0') AS tail, coalesce({_KINDS}, '关联') AS relation FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT rel_id, relation, h.id AS head_id, t.id AS tail_id, CASE WHEN h.id IS NULL OR t.id IS NULL THEN 'unresolved' ELSE CASE relation WHEN '控股' THEN 'AFFILIATED_WITH' WHEN '股权持有' THEN 'AFFILIATED_WITH' WHEN '经营业务板块' THEN 'OPERATES_SEGMENT' ELSE 'RELATED' END END AS token FROM r LEFT JOIN e h ON h.name = head LEFT JOIN e t ON t.name = tail""")
def relation_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as relations between customers' names; customers in debt are no entities, so some names lead nowhere."""
    customers = table(spark, sf_dir, "customer")
    entities = customers.where("c_acctbal >= 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    tail = F.concat(F.lit("Customer#"), F.lpad((F.col("o_orderkey") % 150 + 1).cast("string"), 9, "0"))
    relations = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("r"), "o_orderkey").alias("id"), F.col("c_name").alias("head"), tail.alias("tail"), F.expr(_KINDS).alias("relation"), F.create_map().cast("map<string,string>").alias("attributes"))
    good, lost = ingest.relation_rows(relations, entities)
    shape = lambda df, token: df.select("rel_id", "relation", "head_id", "tail_id", token.alias("token"))
    return shape(good, F.col("token")).unionByName(shape(lost, F.lit("unresolved")))


@query("""WITH h AS (SELECT 'T' || o_orderkey AS id, (o_custkey % 150)::VARCHAR AS who, (DATE '2024-01-01' + (o_orderkey % 30)::INT) AS a FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT 'E' || event_id AS id, user_id::VARCHAR AS who, ts::DATE AS d FROM events WHERE event_type = 'purchase')
    SELECT 'TRIP_FOR_ORDER:' || h.id || '->' || t.id AS id, 'TRIP_FOR_ORDER' AS relation_type, h.id AS head, t.id AS tail, d::VARCHAR AS valid_from FROM h JOIN t USING (who) WHERE d BETWEEN a AND a + 2 AND t.id NOT LIKE '%7'""")
def mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as trips of three days, and the purchases of the mapped user within them; purchases whose number ends in 7 are no nodes."""
    day = F.expr("date_add(to_date('2024-01-01'), cast(o_orderkey % 30 as int))")
    trips = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("T"), "o_orderkey").alias("id"), (F.col("o_custkey") % 150).alias("who"), day.alias("start"), F.date_add(day, 2).alias("end"))
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("E"), "event_id").alias("id"), F.col("user_id").alias("who"), F.col("ts").cast("string").alias("closed_at"))
    nodes = trips.select("id").unionByName(bought.where("not id like '%7'").select("id"))
    return ingest.matched_edges(trips, bought, ["who"], "TRIP_FOR_ORDER", "id", "id", nodes, ("start", "end", "closed_at"), "tail", "closed_at")


_ADDRESS = "'No. ' || (s_suppkey % 6) || ', Harbour-Street'"
_SHARED = "substr(sha256(%s), 1, 16)"
_BUSINESS = f"""
    s AS (SELECT 'SUBJECT:' || lpad(s_suppkey::VARCHAR, 18, '0') AS s, s_name, s_suppkey AS k, 'ADDRESS:' || {_SHARED % "'No' || (s_suppkey % 6) || 'HarbourStreet'"} AS a, {_ADDRESS} AS address, 'LEGALPERSON:' || {_SHARED % "'Rep' || (s_suppkey % 9) || '|ID' || (s_suppkey % 9)"} AS p, 'Rep ' || (s_suppkey % 9) AS rep, 'PHONE:' || {_SHARED % "'+8610' || (s_suppkey % 7)"} AS t FROM supplier),
    z AS (SELECT count(*) AS n FROM supplier),
    o AS (SELECT o_orderkey, o_orderstatus AS st, o_totalprice AS amount, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderkey % 5 <> 0 THEN 'TR' || (o_orderkey // 4) END AS ref, CASE WHEN o_orderkey % 4 <> 0 THEN 'SUBJECT:' || lpad((o_custkey % n)::VARCHAR, 18, '0') END AS aligned, 'SUBJECT:' || lpad((o_orderkey % n)::VARCHAR, 18, '0') AS party, CASE o_orderstatus WHEN 'F' THEN 'INVOICE:' WHEN 'O' THEN 'VOUCHER:' ELSE 'CONTRACT:' END || o_orderkey AS n FROM orders, z),
    told AS (SELECT aligned AS s, list_sort(list(n)) AS ids FROM o WHERE st IN ('F', 'O') AND aligned IS NOT NULL GROUP BY 1),
    own AS (SELECT 'SUBJECT:' || lpad('9', 18, '9') AS s WHERE EXISTS (SELECT 1 FROM o WHERE st = 'P'))
"""


@query(f"""WITH {_BUSINESS}
    SELECT 'node' AS what, s AS id, 'Subject' AS kind, s_name AS name, coalesce(ids[1], '') AS other, coalesce(len(ids), 0)::BIGINT AS n FROM s LEFT JOIN told USING (s) UNION ALL SELECT 'node', s, 'Subject', 'Own', '', 0 FROM own
    UNION ALL SELECT 'node', a, 'Address', min(address), min(s), count(*) FROM s GROUP BY a UNION ALL SELECT 'node', p, 'LegalPerson', min(rep), min(s), count(*) FROM s GROUP BY p UNION ALL SELECT 'node', t, 'Phone', 'phone', min(s), count(*) FROM s GROUP BY t
    UNION ALL SELECT 'node', n, CASE st WHEN 'F' THEN 'Invoice' WHEN 'O' THEN 'Voucher' ELSE 'Contract' END, o_orderkey::VARCHAR, n, 1 FROM o
    UNION ALL SELECT 'edge', 'REGISTERED_AT:' || s || '->' || a, 'REGISTERED_AT', s, a, 0 FROM s UNION ALL SELECT 'edge', 'LEGAL_REP:' || s || '->' || p, 'LEGAL_REP', s, p, 0 FROM s UNION ALL SELECT 'edge', 'CONTACT_PHONE:' || s || '->' || t, 'CONTACT_PHONE', s, t, 0 FROM s
    UNION ALL SELECT 'edge', 'ISSUED:' || aligned || '->' || n, 'ISSUED', aligned, n, 0 FROM o WHERE st = 'F' AND aligned IS NOT NULL UNION ALL SELECT 'edge', 'POSTED_IN:' || n || '->' || aligned, 'POSTED_IN', n, aligned, 0 FROM o WHERE st = 'O' AND aligned IS NOT NULL
    UNION ALL SELECT 'edge', 'PARTY_TO:' || party || '->' || n || ':A', 'PARTY_TO', party, n, 0 FROM o WHERE st = 'P' UNION ALL SELECT 'edge', 'PARTY_TO:SUBJECT:' || lpad('9', 18, '9') || '->' || n || ':B', 'PARTY_TO', 'SUBJECT:' || lpad('9', 18, '9'), n, 0 FROM o WHERE st = 'P'
    UNION ALL SELECT 'edge', 'SHARES_HOLDER:' || x.s || '->' || y.s, 'SHARES_HOLDER', x.s, y.s, 0 FROM s x JOIN s y ON y.k = x.k + 1""")
def business_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as subjects, orders as invoices, vouchers and contracts by status; each supplier holds the next one."""
    c, k = F.col, F.col("s_suppkey")
    tax = lambda x: F.lpad(x.cast("string"), 18, "0")
    supplier = table(spark, sf_dir, "supplier")
    suppliers = supplier.select(tax(k).alias("tax_id"), c("s_name").alias("name"), F.expr(f"concat({_ADDRESS.replace('||', ',')})").alias("address"), F.concat(F.lit("+86 (10) "), k % 7).alias("phone"), F.concat(F.lit("Rep "), k % 9).alias("rep_name"), F.concat(F.lit("id"), k % 9).alias("rep_id"))
    n = supplier.agg(F.count("*").alias("n"))
    key = c("o_orderkey")
    orders = table(spark, sf_dir, "orders").join(F.broadcast(n)).select("o_orderstatus", key.cast("string").alias("key"), c("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"), F.when(key % 5 != 0, F.concat(F.lit("TR"), F.expr("o_orderkey div 4"))).alias("trade_ref"), F.when(key % 4 != 0, F.concat(F.lit("SUBJECT:"), tax(c("o_custkey") % c("n")))).alias("aligned_id"), tax(key % c("n")).alias("party_a"), F.lit("A").alias("party_a_name"), F.lit("9" * 18).alias("party_b"), F.lit("Own").alias("party_b_name"))
    holders = supplier.select(tax(k).alias("holder"), k).join(supplier.select((k - 1).alias("s_suppkey"), tax(k).alias("held")), "s_suppkey")
    of = lambda s: orders.where(c("o_orderstatus") == s)
    nodes, edges = ingest.business_graph(suppliers, of("F"), of("O"), of("P"), holders)
    a = nodes.select(F.lit("node").alias("what"), "id", c("label").alias("kind"), "name", F.coalesce(F.try_element_at("source_entity_ids", F.lit(1)), F.lit("")).alias("other"), F.size("source_entity_ids").cast("long").alias("n"))
    return a.unionByName(edges.select(F.lit("edge").alias("what"), "id", "kind", c("head").alias("name"), c("tail").alias("other"), F.lit(0).cast("long").alias("n")))


@query("""WITH s AS (SELECT s_nationkey AS d, s_suppkey AS k, s_name AS name FROM supplier), nx AS (SELECT a.*, b.name AS held FROM s a LEFT JOIN s b ON b.k = a.k + 1)
    SELECT 'entity' AS what, name AS a, '公司' AS b, CASE WHEN EXISTS (SELECT 1 FROM s p WHERE p.k = s.k - 1 AND p.d = s.d) THEN 'false true' ELSE 'true false' END AS c, d::VARCHAR AS d FROM s UNION ALL SELECT 'entity', 'rev ' || k, '财务指标', 'true false', d::VARCHAR FROM s UNION ALL SELECT DISTINCT 'entity', '营收' || k % 3, '财务指标', 'false true', d::VARCHAR FROM s
    UNION ALL SELECT 'entity', held, '公司', 'false true', d::VARCHAR FROM nx WHERE held IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.name = held AND s.d = nx.d)
    UNION ALL SELECT DISTINCT 'relation', name || '|' || '营收' || k % 3, '具有财务指标', 'true', d::VARCHAR FROM s UNION ALL SELECT 'relation', name || '|' || held, '控股', 'false', d::VARCHAR FROM nx WHERE held IS NOT NULL""")
def extraction_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each nation with records of its suppliers: companies, their figures, what they hold; repeats, blanks and records without a head are among them."""
    s = table(spark, sf_dir, "supplier")
    held = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("held"))
    rows, k = s.join(held, "s_suppkey", "left"), F.col("s_suppkey")
    record = lambda step, kind, text, *pairs: F.struct((k * 10 + step).alias("nth"), F.lit(kind).alias("kind"), text.alias("text"), F.create_map(*pairs).cast("map<string,string>").alias("attributes"), F.lit(True).alias("grounded"))
    owner = (F.lit("主体"), F.col("s_name"))
    hold = F.when(F.col("held").isNotNull(), F.concat_ws(" ", "s_name", "held"))
    each = F.array(
        record(1, "公司", F.col("s_name")), record(2, "财务指标", F.concat(F.lit("rev "), k), *owner, F.lit("指标名称"), F.concat(F.lit("营收"), k % 3)), record(3, "公司", F.lit("  ")),
        record(4, "控股关系", hold, *owner, F.lit("标的"), F.col("held"), F.lit("关系类型"), F.lit("控股")), record(5, "控股关系", hold, *owner, F.lit("标的"), F.col("held"), F.lit("关系类型"), F.lit("控股")), record(6, "控股关系", F.lit("nobody's")),
    )
    entities, relations = ingest.from_extraction(rows.select(F.col("s_nationkey").cast("string").alias("doc"), F.explode(each).alias("r")).select("doc", "r.*"))
    flags = F.concat_ws(" ", F.col("grounded").cast("string"), F.col("auto_created").cast("string"))
    a = entities.select(F.lit("entity").alias("what"), F.col("name").alias("a"), F.col("type").alias("b"), flags.alias("c"), F.col("doc").alias("d"))
    return a.unionByName(relations.select(F.lit("relation").alias("what"), F.concat_ws("|", "head", "tail").alias("a"), F.col("relation").alias("b"), F.col("derived").cast("string").alias("c"), F.col("doc").alias("d")))


_AFFILIATED = f"""
    r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'PERSON' ELSE 'ORG' END AS st, ' Org ' || o_custkey % 50 || ' ' AS sn, CASE WHEN o_orderkey % 3 = 0 THEN 'ADDRESS' ELSE 'LEGAL_PERSON' END AS tt, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'Name ' || o_orderkey % 40 END AS tn, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'REGISTERED_AT' ELSE 'LEGAL_REP' END AS rt, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate::DATE::VARCHAR END AS f, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderdate::DATE + 30)::VARCHAR END AS t, 'doc' || o_orderkey % 20 AS told, o_orderkey AS place FROM orders),
    g AS (SELECT *, 'sub-' || {_SHARED % 'trim(sn)'} AS head, CASE tt WHEN 'ADDRESS' THEN 'adr-' ELSE 'lpr-' END || {_SHARED % 'trim(tn)'} AS tail FROM r WHERE st = 'ORG' AND trim(tn) <> '' AND (rt = 'LEGAL_REP') = (tt = 'LEGAL_PERSON')),
    n AS (SELECT *, row_number() OVER (PARTITION BY rt, head, tail ORDER BY told, place) AS first, row_number() OVER (PARTITION BY rt, head, tail ORDER BY f NULLS LAST, told, place) AS early, row_number() OVER (PARTITION BY rt, head, tail ORDER BY t IS NULL, told, place) AS ended FROM g)
"""


@query(f"""WITH {_AFFILIATED} SELECT 'v9:' || CASE rt WHEN 'LEGAL_REP' THEN 'lr' ELSE 'ra' END || ':' || head || ':' || tail AS id, CASE WHEN bool_or(first = 1 AND f IS NULL) THEN NULL ELSE min(f) END AS valid_from, max(CASE WHEN ended = 1 THEN t END) AS valid_to, CASE WHEN bool_or(first = 1 AND f IS NULL) THEN max(CASE WHEN first = 1 THEN told END) ELSE max(CASE WHEN early = 1 THEN told END) END AS source_document_id FROM n GROUP BY rt, head, tail
    UNION ALL SELECT head, 'Subject', min(trim(sn)), string_agg(DISTINCT 'o' || k, ',' ORDER BY 'o' || k) FROM g GROUP BY head UNION ALL SELECT tail, CASE tt WHEN 'ADDRESS' THEN 'Address' ELSE 'LegalPerson' END, min(trim(tn)), string_agg(DISTINCT 'p' || k, ',' ORDER BY 'p' || k) FROM g GROUP BY tail, tt""")
def affiliation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a document's statement that an organisation has a representative or an address."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumns({"s": F.concat(F.lit("o"), k), "t": F.concat(F.lit("p"), k)})
    orgs = o.select(F.col("s").alias("id"), F.when(k % 11 == 0, "PERSON").otherwise("ORG").alias("entity_type"), F.concat(F.lit(" Org "), F.col("o_custkey") % 50, F.lit(" ")).alias("canonical_name"), F.lit(0).cast("long").alias("char_start"))
    tails = o.select(F.col("t").alias("id"), F.when(k % 3 == 0, "ADDRESS").otherwise("LEGAL_PERSON").alias("entity_type"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("Name "), k % 40)).alias("canonical_name"), k.alias("char_start"))
    day = F.to_date("o_orderdate")
    relations = o.select(F.col("s").alias("source_entity_id"), F.col("t").alias("target_entity_id"), F.when((k % 3 == 0) & (k % 7 != 0), "REGISTERED_AT").otherwise("LEGAL_REP").alias("relation_type"), F.when(k % 6 != 0, day.cast("string")).alias("valid_from"), F.when(k % 5 == 0, F.date_add(day, 30).cast("string")).alias("valid_to"), F.concat(F.lit("doc"), k % 20).alias("source_document_id"))
    nodes, edges = ingest.affiliation_rows(orgs.unionByName(tails), relations, "v9")
    a = nodes.select("id", F.col("label").alias("valid_from"), F.col("name").alias("valid_to"), F.array_join("source_entity_ids", ",").alias("source_document_id"))
    return edges.select("id", "valid_from", "valid_to", "source_document_id").unionByName(a)


_PROFILES = """
    p AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_type) AS name, p_brand AS tax, p_size AS phone FROM part),
    g AS (SELECT *, list_distinct(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) AS b FROM p),
    m AS (SELECT x.id AS raw_id, y.id AS canonical_id, CASE WHEN x.name = y.name THEN 1.0 ELSE round(len(list_intersect(x.b, y.b)) / len(list_distinct(list_concat(x.b, y.b))), 6) END AS sim, 0.05 * (x.phone = y.phone)::INT AS bonus, x.tax, y.tax AS other FROM g x JOIN g y ON substr(x.name, 1, 2) = substr(y.name, 1, 2) WHERE x.id % 3 = 0 AND y.id % 3 <> 0 AND x.tax <> y.tax),
    s AS (SELECT raw_id, canonical_id, round(least(least(1.0, sim + bonus), 0.85), 6) AS similarity FROM m)
"""


@query(f"WITH {_PROFILES} SELECT raw_id, canonical_id, similarity::DOUBLE AS similarity, 'human_review' AS tier FROM s WHERE similarity >= 0.7")
def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the parts as unaligned rows against the others; brands stand for tax ids, so pairs of different brands contradict each other."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.col("p_brand").alias("tax_id"), F.lit(None).cast("string").alias("address"), F.col("p_size").cast("string").alias("phone"), F.lit(None).cast("string").alias("legal_rep"))
    return alignment.raw_candidates(rows.where("id % 3 = 0"), rows.where("id % 3 != 0"), with_ratio=False)


@query("""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 10 END AS aligned, CASE WHEN c_custkey % 4 <> 0 THEN 'name' END AS level, CASE WHEN c_custkey % 4 = 0 THEN 'no_match' END AS reason FROM customer)
    SELECT id, CASE WHEN aligned IS NULL AND id % 3 = 0 THEN 'resolution' ELSE level END AS level, CASE WHEN aligned IS NULL AND id % 3 = 0 THEN 77 ELSE aligned END AS aligned_id, CASE WHEN aligned IS NULL AND id % 3 = 0 THEN NULL ELSE reason END AS reason FROM a""")
def merged_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of whom a quarter is not aligned; of those a third was merged since."""
    key = F.col("c_custkey")
    aligned = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 4 != 0, "name").alias("level"), F.when(key % 4 != 0, key % 10).alias("aligned_id"), F.when(key % 4 == 0, "no_match").alias("reason"))
    return ingest.merged_back(aligned, aligned.where("id % 3 = 0").select("id", F.lit(77).cast("long").alias("canonical_id")), "id")


_MENTIONS = """
    m AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}'))) AS ms, text FROM documents), e AS (SELECT doc_id, i, ms[i] AS name, instr(text, ms[i]) - 1 AS a, len(ms) AS n FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
    n AS (SELECT *, 'ent_' || substr(sha256(doc_id || '|' || name || '|NAME|' || a || '|' || (a + length(name))), 1, 12) AS id FROM e)
"""


@query(f"""WITH {_MENTIONS} SELECT 'entity' AS what, doc_id, id, name AS detail FROM n
    UNION ALL SELECT 'relation', x.doc_id, 'rel_' || substr(sha256(x.id || '|NEXT|' || coalesce(y.id, 'end')), 1, 12), x.id || ' ' || coalesce(y.id, 'end') FROM n x LEFT JOIN n y ON y.doc_id = x.doc_id AND y.i = x.i + 1""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in each document under numbers that an extraction happened to give, each twice, with relations to the next one; ids that depend on what they name alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))).alias("ms"))
    each = docs.select("doc_id", "text", F.size("ms").alias("n"), F.posexplode("ms").alias("i", "name")).withColumn("a", F.instr("text", F.col("name")) - 1)
    run = F.explode(F.array(F.lit("x"), F.lit("y"))).alias("run")
    rows = each.select("doc_id", "n", "i", run, F.col("name").alias("canonical_name"), F.lit("NAME").alias("entity_type"), F.col("a").alias("char_start"), (F.col("a") + F.length("name")).alias("char_end"))
    entities = rows.withColumn("id", F.concat("run", F.col("i").cast("string")))
    after = F.when(F.col("i") + 1 < F.col("n"), F.concat("run", (F.col("i") + 1).cast("string"))).otherwise("end")
    relations = entities.select("doc_id", F.col("id").alias("source_entity_id"), F.lit("NEXT").alias("relation_type"), after.alias("target_entity_id"))
    found, links = ingest.stable_ids(entities.drop("n", "i", "run"), relations)
    a = found.select(F.lit("entity").alias("what"), "doc_id", "id", F.col("canonical_name").alias("detail"))
    return a.unionByName(links.select(F.lit("relation").alias("what"), "doc_id", "id", F.concat_ws(" ", "source_entity_id", "target_entity_id").alias("detail")))
