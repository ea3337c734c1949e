"""Queries on the property graph: overview, neighbours, paths and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vestigraph.operators import paths, projection, versions
from vestigraph.plans.registry import query, table


@query("""WITH d AS (SELECT 'C' || o_custkey::VARCHAR AS id, count(*) AS degree FROM orders GROUP BY 1 UNION ALL SELECT 'S' || l_suppkey::VARCHAR, count(*) FROM lineitem GROUP BY 1)
    SELECT id, degree, (SELECT count(*) FROM d) > 500 AS truncated FROM d ORDER BY degree DESC, id LIMIT 500""")
def overview_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("id")).unionByName(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    total = degree.agg((F.count("*") > 500).alias("truncated"))
    return degree.orderBy(F.desc("degree"), "id").limit(500).join(F.broadcast(total))


@query("""WITH e AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS nth, count(*) OVER (PARTITION BY l_suppkey) AS out_degree FROM e)
    SELECT s_suppkey, l_partkey AS neighbour, n AS edges, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(out_degree, 0) > 20 AS has_more FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey AND nth <= 20""")
def entity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's 20 closest parts, how many there are in all, and whether there are more."""
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("neighbour")).agg(F.count("*").alias("edges"))
    degree = edges.groupBy("s_suppkey").agg(F.count("*").alias("degree"))
    first = edges.withColumn("nth", F.row_number().over(Window.partitionBy("s_suppkey").orderBy(F.desc("edges"), "neighbour"))).where("nth <= 20")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").join(degree, "s_suppkey", "left").join(first, "s_suppkey", "left")
    out = F.coalesce("degree", F.lit(0))
    return rows.select("s_suppkey", "neighbour", "edges", out.cast("long").alias("out_degree"), (out > 20).alias("has_more"))


_GRAPH = """
    s AS (SELECT s_suppkey, min(l_shipdate)::DATE AS since FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
    e AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'has' AS kind, DATE '1990-01-01' AS f, NULL::DATE AS t FROM nation
          UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'seat', since, CASE WHEN s_suppkey % 2 = 0 THEN since + 1000 END FROM supplier LEFT JOIN s USING (s_suppkey)),
    u AS (SELECT src, dst, src || '>' || dst AS edge, f, t FROM e UNION ALL SELECT dst, src, src || '>' || dst, f, t FROM e),
    h1 AS (SELECT 'R' || r_regionkey AS start, u.dst AS terminal, ['R' || r_regionkey, u.dst] AS ids, [edge] AS used, [f] AS froms, [t] AS tos, 1 AS hops FROM region JOIN u ON u.src = 'R' || r_regionkey),
    h2 AS (SELECT start, u.dst AS terminal, list_append(ids, u.dst) AS ids, list_append(used, edge) AS used, list_append(froms, f) AS froms, list_append(tos, t) AS tos, 2 AS hops FROM h1 JOIN u ON u.src = h1.terminal AND NOT list_contains(used, edge) WHERE h1.terminal NOT LIKE 'R%'),
    h3 AS (SELECT start, u.dst AS terminal, list_append(ids, u.dst) AS ids, list_append(used, edge) AS used, list_append(froms, f) AS froms, list_append(tos, t) AS tos, 3 AS hops FROM h2 JOIN u ON u.src = h2.terminal AND NOT list_contains(used, edge) WHERE h2.terminal NOT LIKE 'R%'),
    p AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3),
    v AS (SELECT start, terminal, hops, array_to_string(ids, '/') AS path, ids, CASE WHEN len(list_filter(froms, lambda x: x IS NULL)) > 0 THEN 'unknown' WHEN list_min(tos) IS NULL OR list_max(froms) <= list_min(tos) THEN 'consistent' ELSE 'inconsistent' END AS verdict,
                 coalesce(froms[-1] <= DATE '1999-01-01' AND (tos[-1] IS NULL OR tos[-1] > DATE '1999-01-01'), false) AS proven FROM p)
"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """starts, edges and nodes of region - nation - supplier."""
    name = lambda letter, c: F.concat(F.lit(letter), c)
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    since = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min(F.to_date("l_shipdate")).alias("valid_from"))
    has = nation.select(name("R", "n_regionkey").alias("src"), name("N", "n_nationkey").alias("dst"), F.lit("has").alias("kind"), F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    seat = supplier.join(since, "s_suppkey", "left").select(name("N", "s_nationkey").alias("src"), name("S", "s_suppkey").alias("dst"), F.lit("seat").alias("kind"), "valid_from", F.when(F.col("s_suppkey") % 2 == 0, F.date_add("valid_from", 1000)).alias("valid_to"))
    starts = table(spark, sf_dir, "region").select(name("R", "r_regionkey").alias("id"))
    nodes = starts.withColumn("type", F.lit("REGION")).unionByName(nation.select(name("N", "n_nationkey").alias("id"), F.lit("NATION").alias("type"))).unionByName(supplier.select(name("S", "s_suppkey").alias("id"), F.lit("SUPPLIER").alias("type")))
    return starts, has.unionByName(seat), nodes


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks both ways from each region; regions are hubs."""
    return paths.paths(*_graph(spark, sf_dir), 3, hub="REGION")


@query("""WITH s AS (SELECT s_suppkey, min(l_shipdate)::DATE AS since FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
    e AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation WHERE n_nationkey % 5 <> 4
          UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier JOIN s USING (s_suppkey) WHERE s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AND since <= DATE '1996-01-01' AND (s_suppkey % 2 <> 0 OR since + 1000 > DATE '1996-01-01')),
    u AS (SELECT src, dst, src || '>' || dst AS edge FROM e UNION ALL SELECT dst, src, src || '>' || dst FROM e),
    h1 AS (SELECT 'R' || r_regionkey AS start, dst AS terminal, 'R' || r_regionkey || '/' || dst AS path, edge FROM region JOIN u ON src = 'R' || r_regionkey)
    SELECT start, terminal, 1 AS hops, path FROM h1 UNION ALL SELECT start, u.dst, 2, path || '/' || u.dst FROM h1 JOIN u ON u.src = h1.terminal AND u.edge <> h1.edge""")
def paths_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of two hops over one tenant's edges, of two versions of three, valid on a day."""
    starts, edges, nodes = _graph(spark, sf_dir)
    number = F.substring("dst", 2, 9).cast("int")
    mine = F.when(F.col("kind") == "has", number % 5 != 4).otherwise(number % 3 != 0)
    version = F.when((F.col("kind") == "seat") & (number % 7 == 0), "v0").when(number % 2 == 0, "v1").otherwise("v2")
    chain = spark.createDataFrame([("v2",), ("v1",)], "kg_version string")
    rows = paths.scoped(edges.withColumn("org_id", F.when(mine, "o1").otherwise("o2")).withColumn("kg_version", version), "1996-01-01", "o1", chain)
    return paths.paths(starts, rows, nodes, 2).select("start", "terminal", "hops", F.array_join("ids", "/").alias("path"))


@query(f"WITH {_GRAPH} SELECT start, terminal, hops, path FROM v")
def path_1_to_3_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("start", "terminal", "hops", F.array_join("ids", "/").alias("path"))


@query(f"WITH {_GRAPH} SELECT start, path, hops, verdict, proven FROM v")
def path_temporal_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1999-01-01").cast("date")
    found = _paths(spark, sf_dir)
    return found.select("start", F.array_join("ids", "/").alias("path"), "hops", paths.verdict(F.col("froms"), F.col("tos")).alias("verdict"), paths.last_hop_holds(F.col("froms"), F.col("tos"), day).alias("proven"))


@query(f"""WITH {_GRAPH}, r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY (terminal NOT LIKE 'S%')::INT, (terminal NOT LIKE 'N%')::INT, hops, CASE verdict WHEN 'consistent' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, (NOT proven)::INT, ids) AS nth FROM v)
    SELECT start, path, hops, verdict, proven FROM r WHERE nth = 1""")
def best_path_seven_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_type = lambda t: F.when(F.col("terminal_type") == t, 0).otherwise(1)
    best = paths.search_best(*_graph(spark, sf_dir), is_type("SUPPLIER"), is_type("NATION"), F.lit("1999-01-01").cast("date"), 3, hub="REGION")
    return best.select("start", F.array_join("ids", "/").alias("path"), "hops", "verdict", "proven")


@query("""SELECT r_name, count(*) AS n_paths, count(DISTINCT n_nationkey) AS n_nations, count(DISTINCT s_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def fixed_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_nationkey", "r_name")
    # Lines are counted by supplier before they meet their places; only parts need the lines themselves, by two keys.
    counted = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n")).join(places, "s_suppkey")
    paths = counted.groupBy("r_name").agg(F.sum("n").alias("n_paths"), F.count_distinct("n_nationkey").alias("n_nations"), F.count_distinct("s_suppkey").alias("n_suppliers"))
    sold = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").join(places.select("s_suppkey", "r_name"), "s_suppkey").select(F.col("r_name").alias("name"), "l_partkey").distinct()
    parts = sold.groupBy("name").agg(F.count("l_partkey").alias("n_parts"))
    return paths.join(parts, F.col("r_name").eqNullSafe(F.col("name"))).drop("name")


def _nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("aliases"), (F.col("n_nationkey") / 100).alias("confidence"))
    t = lambda n: table(spark, sf_dir, n)
    trade = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = trade.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.lit("sells").alias("kind")).distinct()
    return nodes, edges


_TRADE = "e AS (SELECT DISTINCT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"


@query(f"""WITH {_TRADE}, m AS (SELECT DISTINCT CASE src WHEN 7 THEN 3 ELSE src END AS src, CASE dst WHEN 7 THEN 3 ELSE dst END AS dst FROM e)
    SELECT 'edge' AS what, src AS id, dst AS other, NULL AS name FROM m WHERE src <> dst
    UNION ALL SELECT 'node', n_nationkey::BIGINT, NULL, n_name || CASE n_nationkey WHEN 3 THEN ' = NATION_7' ELSE '' END FROM nation WHERE n_nationkey <> 7""")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = versions.merge_entities(*_nation_graph(spark, sf_dir), 3, 7)
    return _rows(nodes, edges)


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, [' ' || p_brand || ' ', '', p_partkey || ' ' || split_part(p_name, ' ', 1) || ' 2', '3 ' || split_part(p_name, ' ', 2) || ' 3', ' '] AS aliases, p_retailprice / 10000 AS confidence FROM part),
    m AS (SELECT list_concat(a.aliases, [b.name], b.aliases) AS every, greatest(a.confidence, b.confidence) AS confidence FROM n a, n b WHERE a.id = 4 AND b.id = 9),
    k AS (SELECT id, name, CASE id WHEN 4 THEN (SELECT list_filter(list_transform(every, lambda x: trim(x)), lambda x: x <> '') FROM m) ELSE aliases END AS aliases, CASE id WHEN 4 THEN (SELECT confidence FROM m) ELSE confidence END AS confidence FROM n WHERE id <> 9),
    u AS (SELECT id, name, confidence, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS i FROM k)
    SELECT id, name, round(confidence, 6) AS confidence, alias, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS place FROM (SELECT * FROM u QUALIFY id <> 4 OR row_number() OVER (PARTITION BY id, alias ORDER BY i) = 1)""")
def merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with aliases that hold digits and blanks; part 9 becomes an alias of part 4."""
    part = table(spark, sf_dir, "part")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    aliases = F.array(F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.lit(""), F.concat("p_partkey", F.lit(" "), word(1), F.lit(" 2")), F.concat(F.lit("3 "), word(2), F.lit(" 3")), F.lit(" "))
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), aliases.alias("aliases"), (F.col("p_retailprice") / 10000).alias("confidence"))
    edges = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit("next").alias("kind"))
    kept, _ = versions.merge_entities(nodes, edges, 4, 9)
    return kept.select("id", "name", F.round("confidence", 6).alias("confidence"), F.posexplode("aliases").alias("place", "alias"))


def _rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    alias = F.when(F.size("aliases") > 0, F.concat(F.lit(" = "), F.array_join("aliases", ","))).otherwise("")
    out = edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(None).cast("string").alias("name"))
    return out.unionByName(nodes.select(F.lit("node").alias("what"), "id", F.lit(None).cast("long").alias("other"), F.concat("name", alias).alias("name")))


@query(f"""WITH {_TRADE}, part AS (SELECT 100 AS new_id, 'NATION_1' AS new_name UNION ALL SELECT 101, 'NATION_2'), names AS (SELECT n_nationkey::BIGINT AS other, n_name AS new_name FROM nation),
    t AS (SELECT src, dst, CASE src WHEN 5 THEN dst ELSE src END AS other FROM e WHERE (src = 5) <> (dst = 5)),
    moved AS (SELECT CASE src WHEN 5 THEN new_id ELSE src END AS src, CASE dst WHEN 5 THEN new_id ELSE dst END AS dst FROM t JOIN names USING (other) JOIN part USING (new_name)),
    n AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT new_id, new_name FROM part)
    SELECT 'edge' AS what, src AS id, dst AS other, NULL AS name FROM e WHERE src <> 5 AND dst <> 5 UNION ALL SELECT 'edge', src, dst, NULL FROM moved
    UNION ALL SELECT 'node', id, NULL, CASE id WHEN 9 THEN 'RENAMED = NATION_9' ELSE name END FROM n""")
def split_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.createDataFrame([(100, "NATION_1"), (101, "NATION_2")], "new_id long, new_name string")
    nodes, edges = versions.split_entity(*_nation_graph(spark, sf_dir), 5, parts)
    return _rows(versions.renamed(nodes, 9, "RENAMED"), edges)


@query("""WITH seed AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_acctbal < -900), e AS (SELECT DISTINCT 'C' || o_custkey AS src, 'N' || o_orderpriority AS dst FROM orders),
    a AS (SELECT id FROM seed UNION SELECT dst FROM e WHERE src IN (SELECT id FROM seed) UNION SELECT src FROM e WHERE dst IN (SELECT id FROM seed))
    SELECT 'edge' AS what, src, dst, 'v2' AS kg_version FROM e WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a) UNION ALL SELECT 'node', 'C' || c_custkey, c_name, 'v2' FROM customer WHERE 'C' || c_custkey IN (SELECT id FROM a)""")
def incremental_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new version holds what the changed customers touch: those nodes, and edges with both ends among them."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("N"), "o_orderpriority").alias("dst")).distinct()
    nodes, inner = versions.rewritten(customers.drop("c_acctbal"), edges, versions.affected(edges, customers.where("c_acctbal < -900")), "v2")
    rows = inner.select(F.lit("edge").alias("what"), "src", "dst", "kg_version")
    return rows.unionByName(nodes.select(F.lit("node").alias("what"), F.col("id").alias("src"), F.col("name").alias("dst"), "kg_version"))


@query("""SELECT c_custkey, round((('0x' || substr(md5(c_custkey::VARCHAR), 1, 2))::INT) / 255.0, 3)::DOUBLE AS x, round((('0x' || substr(md5(c_custkey::VARCHAR), 3, 2))::INT) / 255.0, 3)::DOUBLE AS y FROM customer""")
def layout_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", projection.seed(F.col("c_custkey").cast("string")).alias("s")).select("c_custkey", "s.x", "s.y")
