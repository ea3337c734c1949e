"""Queries on retrieval: a question set against documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.functions import text as tx
from vestigraph.operators import evidence, lexical_index, retrieval, substrings
from vestigraph.operators import vectors as vec
from vestigraph.plans.registry import query, table

_TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+(?:[-_./][0-9A-Za-z]+)*'), lambda x: lower(x))"
_BM25 = f"""
    d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), q AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS token FROM benchmark),
    s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
    tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    r AS (SELECT item_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (token) JOIN tf USING (token), s GROUP BY 1, 2),
    k AS (SELECT item_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM r)
"""


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k)


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank::INT AS rank FROM k WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).withColumn("score", F.round("score", 4))


@query(f"""WITH {_BM25}, l AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1)
    SELECT item_id, doc_id, 'lexical' AS origin FROM k WHERE rank <= 5 UNION ALL SELECT item_id, doc_id, 'graph' FROM benchmark, l WHERE doc_id % 40 = item_id % 40 AND NOT EXISTS (SELECT 1 FROM k WHERE rank <= 5 AND k.item_id = benchmark.item_id AND k.doc_id = l.doc_id)""")
def lexical_graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits, and the labelled documents that a question's topic leads to, less those already there. Remainders by 40 stand for topics."""
    lexical = _bm25(spark, sf_dir, 5).select("item_id", "doc_id", F.lit("lexical").alias("origin"))
    linked = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 1").select("doc_id", (F.col("doc_id") % 40).alias("topic"))
    graph = linked.join(table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 40).alias("topic")), "topic").select("item_id", "doc_id")
    return lexical.unionByName(graph.join(lexical, ["item_id", "doc_id"], "left_anti").withColumn("origin", F.lit("graph")))


@query(f"""WITH {_BM25}, t AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY length(token) DESC, token) AS nth FROM q), g AS (SELECT item_id, doc_id FROM t JOIN tf USING (token) WHERE nth = 1),
    h AS (SELECT item_id, g.doc_id, rank FROM g LEFT JOIN k USING (item_id, doc_id))
    SELECT item_id, count(*) AS n_gold, count_if(rank <= 32) AS n_pool, count_if(rank <= 8) AS n_final FROM h GROUP BY 1""")
def recall_at_k_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question's key, its longest token, and how many of them the pool and its head contain."""
    questions, index = table(spark, sf_dir, "benchmark"), retrieval.indexed(table(spark, sf_dir, "documents"))
    words = F.explode(F.array_distinct(tx.tokens(F.coalesce("text", F.lit(""))))).alias("token")
    keys = questions.select("item_id", words).groupBy("item_id").agg(F.min_by("token", F.struct(-F.length("token"), "token")).alias("term"))
    gold = lexical_index.holding(index, keys.select("term").distinct()).join(keys, "term").select("item_id", "doc_id")
    pool = retrieval.bm25_top(index, questions, 32).select("item_id", "doc_id", "rank")
    found = gold.join(pool, ["item_id", "doc_id"], "left")
    return found.groupBy("item_id").agg(F.count("*").alias("n_gold"), F.count("rank").alias("n_pool"), F.count_if(F.col("rank") <= 8).alias("n_final"))


@query(f"""WITH {_BM25}, t AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY length(token) DESC, token) AS nth FROM q WHERE length(token) <= 6), g AS (SELECT item_id, documents.doc_id FROM t JOIN documents ON contains(lower(text), token) WHERE nth = 1),
    h AS (SELECT item_id, g.doc_id, rank FROM g LEFT JOIN k USING (item_id, doc_id))
    SELECT item_id, count(*) AS n_gold, count_if(rank <= 64) AS n_pool, count_if(rank <= 32) AS n_final, count_if(rank <= 32) > 0 AS hit FROM h GROUP BY 1""")
def recall_contains_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text contains a question's key, a token of up to six characters, wherever it stands; how many of them the pool of 64 and the final 32 hold."""
    words = F.explode(F.array_distinct(tx.tokens(F.coalesce("text", F.lit(""))))).alias("token")
    asked = table(spark, sf_dir, "benchmark").select("item_id", words).where(F.length("token") <= 6)
    keys = asked.groupBy("item_id").agg(F.min_by("token", F.struct(-F.length("token"), "token")).alias("name"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    gold = substrings.occurring(texts, keys.select("name"), "doc_id").join(keys, "name").select("item_id", "doc_id")
    found = gold.join(_bm25(spark, sf_dir, 64).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    final = F.count_if(F.col("rank") <= 32)
    return found.groupBy("item_id").agg(F.count("*").alias("n_gold"), F.count("rank").alias("n_pool"), final.alias("n_final"), (final > 0).alias("hit"))


_GRAMS = "list_distinct(list_transform(list_zip(c[:-2], c[2:]), lambda x: x[1] || x[2]))"
_OVERLAP = f"""
    b AS (SELECT item_id, {_GRAMS} AS g FROM (SELECT item_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS c FROM benchmark)),
    e AS (SELECT doc_id, source, size, {_GRAMS} AS g FROM (SELECT doc_id, source, length(text) AS size, string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS c FROM documents)),
    x AS (SELECT doc_id, item_id, source, size, CASE WHEN len(b.g) > 0 THEN round(len(list_intersect(b.g, e.g)) / len(b.g), 6) ELSE 0 END AS score FROM e, b)
"""


@query(f"WITH {_OVERLAP} SELECT doc_id, max(score)::DOUBLE AS best_overlap FROM x GROUP BY 1")
def bigram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best coverage of any question's bigrams by each document."""
    return retrieval.best_coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(q.v, e.v) AS score FROM q JOIN e ON query_id <> vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 4) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vec.dense_topk(vectors, vectors.where("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 4))


@query("""WITH d AS (SELECT c_custkey AS id, c_mktsegment AS kind, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS nth FROM d), s AS (SELECT *, nth <= greatest(floor(100 / (SELECT count(DISTINCT kind) FROM d)), 1) AS sure FROM n)
    SELECT id, kind, degree, sure FROM s ORDER BY sure DESC, CASE WHEN sure THEN kind END NULLS LAST, CASE WHEN sure THEN nth END NULLS LAST, degree DESC, id LIMIT 100""")
def quota_node_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind")).join(degree, "id", "left")
    return retrieval.quota_nodes(nodes.select("id", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("degree")), 100)


@query(f"""WITH {_OVERLAP}, y AS (SELECT *, nullif(source, 'src0') AS grp, size AS mentions, doc_id % 3 AS spans, doc_id // 2 AS char_start FROM x),
    n AS (SELECT *, grp IS NOT NULL AND row_number() OVER (PARTITION BY item_id, grp ORDER BY score DESC, mentions DESC, char_start, doc_id) <= greatest(floor(64 / (SELECT count(DISTINCT grp) FROM y)), 1) AS sure FROM y),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sure DESC, score DESC, sure OR spans > 0 DESC, mentions DESC, char_start, doc_id) AS rank FROM n)
    SELECT item_id, doc_id, score::DOUBLE AS score, sure, rank::INT AS rank FROM r WHERE rank <= 64""")
def quota_evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for every question: each source but the first has sure places, the rest fills up, rows with a place in the text first."""
    docs = table(spark, sf_dir, "documents")
    facts = docs.select("doc_id", "text", F.nullif("source", F.lit("src0")).alias("source"), F.length("text").alias("mentions"), (F.col("doc_id") % 3).alias("spans"), F.expr("doc_id div 2").alias("char_start"))
    rows = retrieval.covering(facts, table(spark, sf_dir, "benchmark"), 64, "source")
    return evidence.selected(rows, 64, "item_id", "source", "doc_id").select("item_id", "doc_id", "score", "sure", "rank")


@query("""WITH n AS (SELECT name, min(id) AS id FROM (SELECT 'TYPE:' || p_partkey AS id, lower(p_type) AS name FROM part UNION ALL SELECT 'NAME:' || p_partkey, p_name FROM part UNION ALL SELECT 'WORD:' || p_partkey, split_part(p_name, ' ', 2) FROM part) WHERE length(trim(name)) >= 2 GROUP BY 1), q AS (SELECT p_partkey AS question_id, 'which ' || p_name || ' of type ' || lower(p_type) || ' is best' AS question FROM part),
    h AS (SELECT question_id, name, id FROM q JOIN n ON contains(question, name)),
    m AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.question_id = h.question_id AND length(x.name) > length(h.name) AND contains(x.name, h.name))),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY length(name) DESC, id) AS rank FROM m) SELECT question_id, id, name, rank::INT AS rank FROM r WHERE rank <= 3""")
def anchor_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and types in a question on each part; fragments without a namespace are left out."""
    part = table(spark, sf_dir, "part")
    own = lambda kind, c: F.struct(F.concat(F.lit(kind), "p_partkey").alias("id"), c.alias("name"))
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    nodes = part.select(F.explode(F.array(own("TYPE:", F.lower("p_type")), own("NAME:", F.col("p_name")), own("WORD:", word), own("ent_", word))).alias("n")).select("n.*")
    asked = part.select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("which "), "p_name", F.lit(" of type "), F.lower("p_type"), F.lit(" is best")).alias("question"))
    return retrieval.anchors(asked, retrieval.derived_only(nodes))


@query("SELECT source, count(*) AS n, substr(sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)), 1, 16) AS fingerprint FROM documents GROUP BY 1")
def pool_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.fingerprints(table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("id")), "source", "id")
    return found.withColumn("fingerprint", F.substring("fingerprint", 1, 16))


@query(f"""WITH q AS (SELECT item_id AS query_id, trim(text) AS query FROM benchmark UNION ALL SELECT 10000000 + p_partkey, p_name || ' ' || lower(p_type) FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT 20000000 + p_partkey, split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 20 = 0),
    n AS (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT p_partkey + 10000000, lower(p_type) FROM part UNION ALL SELECT p_partkey + 20000000, split_part(p_name, ' ', 2) FROM part),
    m AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(query, '{"|".join(tx.STOP_WORDS)}', ' ', 'g'), '{tx.QUERY_MARKS.replace("'", "''")}', ' ', 'g'), ' '), lambda x: x <> '') AS parts FROM q WHERE query <> ''),
    t AS (SELECT query_id, query, list_distinct([query] || parts || flatten(list_transform(parts, lambda x: regexp_extract_all(x, '[A-Za-z0-9]{{2,}}')))) AS ts FROM m),
    s AS (SELECT query_id, id, name, CASE WHEN query = name THEN 100 WHEN contains(name, query) THEN 95 WHEN contains(query, name) THEN 90 WHEN list_contains(list_filter(ts, lambda x: x <> query), name) THEN 85 WHEN len(list_filter(ts, lambda x: x <> query AND contains(name, x))) > 0 THEN 70 WHEN len(list_filter(ts, lambda x: length(x) >= 2 AND contains(x, name))) > 0 THEN 65
        WHEN len(list_intersect(list_distinct(string_split(name, '')), list_distinct(string_split(query, '')))) >= 2 AND len(list_intersect(list_distinct(string_split(name, '')), list_distinct(string_split(query, '')))) / length(name) >= 0.5 THEN 40 END AS score FROM t, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score IS NOT NULL)
    SELECT query_id, id, name, score, rank::INT AS rank FROM r WHERE rank <= 8""")
def entity_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, their types and words of them that answer all benchmark texts, and names and words of every twentieth part."""
    part, some = table(spark, sf_dir, "part"), table(spark, sf_dir, "part").where("p_partkey % 20 = 0")
    of = lambda df, shift, c, key, name: df.select((F.col("p_partkey") + shift).alias(key), c.alias(name))
    names = of(part, 0, F.col("p_name"), "id", "name").unionByName(of(part, 10000000, F.lower("p_type"), "id", "name")).unionByName(of(part, 20000000, F.split_part("p_name", F.lit(" "), F.lit(2)), "id", "name"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = asked.unionByName(of(some, 10000000, F.concat_ws(" ", "p_name", F.lower("p_type")), "query_id", "query")).unionByName(of(some, 20000000, F.split_part("p_name", F.lit(" "), F.lit(1)), "query_id", "query"))
    return retrieval.matches(names, asked)


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(coalesce(text, ''), ''), lambda x: x <> '')) AS g FROM documents), q AS (SELECT list_distinct(string_split('Zürich quartz jukebox, 1984?', '')) AS g)
    SELECT doc_id, round(len(list_intersect(q.g, t.g)) / len(q.g), 6) AS overlap FROM t, q""")
def character_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(tx.character_overlap(F.lit("Zürich quartz jukebox, 1984?"), F.col("text")), 6).alias("overlap"))
