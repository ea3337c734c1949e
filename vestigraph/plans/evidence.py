"""Queries on evidence: which chunks mention what is asked for, back from nodes to texts, and a document's part of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.operators import evidence
from vestigraph.plans.registry import query, table

_NAME = "[A-Z][a-z]{4,}"
#: Each document is a chunk of its source; capitalised words are entities, and the longer ones have their place in the text.
_TEXTS = f"""
    c AS (SELECT 'chunk-' || doc_id AS chunk_id, doc_id AS n, coalesce(text, '') AS text, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 5 END AS page, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 10 END AS char_start, source, 'v' || (1 + doc_id % 3) AS kg_version FROM documents),
    m AS (SELECT chunk_id, n, kg_version, lower(mention) AS entity_id, mention, CASE WHEN length(mention) > 5 THEN instr(text, mention) - 1 END AS pos FROM (SELECT *, unnest(list_distinct(regexp_extract_all(text, '{_NAME}'))) AS mention FROM c)),
    h AS (SELECT source AS doc_id, chunk_id FROM c WHERE n % 11 <> 0),
    w AS (SELECT DISTINCT item_id, lower(x) AS entity_id FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_NAME}')) AS x FROM benchmark))
"""


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """chunks, mentions, held and wanted (item_id, entity_id)."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    n, words = F.col("doc_id"), lambda: F.array_distinct(F.regexp_extract_all("text", F.lit(_NAME), F.lit(0)))
    start = F.when(n % 3 != 0, n * 10)
    chunk_id, version = F.concat(F.lit("chunk-"), n).alias("chunk_id"), F.concat(F.lit("v"), 1 + n % 3).alias("kg_version")
    chunks = docs.select(chunk_id, "text", F.when(n % 5 != 0, n % 5).alias("page"), start.alias("char_start"), (start + F.length("text")).alias("char_end"), version)
    each = docs.select(chunk_id, version, "text", F.explode(words()).alias("mention"))
    at = F.when(F.length("mention") > 5, F.instr("text", F.col("mention")) - 1)
    mentions = each.select("chunk_id", "kg_version", F.lower("mention").alias("entity_id"), "mention", at.alias("char_start"), (at + F.length("mention")).alias("char_end"))
    held = docs.where(n % 11 != 0).select(F.col("source").alias("doc_id"), chunk_id)
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words()).alias("e")).select("item_id", F.lower("e").alias("entity_id")).distinct()
    return chunks, mentions, held, wanted


_INDEX = "k AS (SELECT DISTINCT chunk_id FROM m WHERE entity_id IN (SELECT entity_id FROM w)), s AS (SELECT chunk_id, count(*) AS mentions, count(pos) AS spans FROM m GROUP BY 1), i AS (SELECT c.chunk_id, doc_id, coalesce(char_start, 0) AS char_start, mentions, spans, substr(text, 1, 400) AS snippet FROM c JOIN k USING (chunk_id) JOIN s USING (chunk_id) LEFT JOIN h USING (chunk_id))"


@query(f"WITH {_TEXTS}, {_INDEX} SELECT * FROM i")
def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that mention what any question names."""
    chunks, mentions, held, wanted = _texts(spark, sf_dir)
    return evidence.index(chunks, mentions, held, wanted)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["char_start"], s["char_end"], s["mention"])), " ")).drop("char_end")


_SPANS = "p AS (SELECT chunk_id, string_agg(pos || ':' || (pos + length(mention)) || ':' || mention, ' ' ORDER BY pos, length(mention), mention) AS spans FROM m WHERE pos IS NOT NULL GROUP BY 1)"


@query(f"WITH {_TEXTS}, {_INDEX}, {_SPANS} SELECT c.chunk_id, doc_id, text, page, c.char_start, coalesce(p.spans, '') AS spans FROM c JOIN k USING (chunk_id) LEFT JOIN h USING (chunk_id) LEFT JOIN p USING (chunk_id)")
def evidence_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those chunks whole, with the places of what they mention."""
    chunks, mentions, held, wanted = _texts(spark, sf_dir)
    return _flat(evidence.fetched(chunks, mentions, held, evidence.index(chunks, mentions, held, wanted)))


@query(f"WITH {_TEXTS}, {_SPANS} SELECT c.chunk_id, doc_id, text, page, coalesce(c.char_start, 0) AS char_start, coalesce(p.spans, '') AS spans FROM c LEFT JOIN h USING (chunk_id) LEFT JOIN p USING (chunk_id) ORDER BY c.chunk_id LIMIT 500")
def chunk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of a dense baseline: the first 500 chunks by id."""
    chunks, mentions, held, _ = _texts(spark, sf_dir)
    return _flat(evidence.pool(chunks, mentions, held, 500))


@query(f"WITH {_TEXTS}, {_SPANS} SELECT c.chunk_id, doc_id, text, page, c.char_start, coalesce(p.spans, '') AS spans FROM c JOIN h USING (chunk_id) LEFT JOIN p USING (chunk_id) WHERE doc_id = 'src3'")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, mentions, held, _ = _texts(spark, sf_dir)
    return _flat(evidence.of_document(chunks, mentions, held, "src3"))


@query(f"WITH {_TEXTS} SELECT DISTINCT 'Q' || item_id AS node_id, c.chunk_id, doc_id, page, char_start FROM w JOIN m USING (entity_id) JOIN c USING (chunk_id) LEFT JOIN h USING (chunk_id)")
def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as nodes whose sources are what they name, back to the chunks that mention those."""
    chunks, mentions, held, wanted = _texts(spark, sf_dir)
    nodes = wanted.groupBy(F.concat(F.lit("Q"), "item_id").alias("node_id")).agg(F.collect_set("entity_id").alias("source_entity_ids"))
    return evidence.traced(nodes, chunks, mentions, held).select("node_id", "chunk_id", "doc_id", "page", "char_start")


@query(f"WITH {_TEXTS}, {_INDEX}, a AS (SELECT (SELECT count(*) FROM i) AS n_rows, (SELECT count(DISTINCT chunk_id) FROM i) AS candidates, (SELECT count(*) FROM c) AS total_chunks) SELECT *, n_rows >= 900 AS truncated, candidates < total_chunks AS short, round(candidates / total_chunks, 6) AS coverage, n_rows >= 900 OR candidates < total_chunks AS narrow FROM a")
def evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, mentions, held, wanted = _texts(spark, sf_dir)
    return evidence.window_check(evidence.index(chunks, mentions, held, wanted), chunks, 900)


@query(f"""WITH {_TEXTS}, r(kg_version, rank) AS (VALUES ('v3', 0), ('v2', 1)), d AS (SELECT DISTINCT source AS doc_id, 'v' || v AS kg_version FROM c, (VALUES (1), (2), (3)) t(v) WHERE (length(source) + v + n) % 2 = 0),
    nd AS (SELECT doc_id, arg_min(kg_version, rank) AS kg_version FROM d JOIN r USING (kg_version) GROUP BY 1), own AS (SELECT h.doc_id, c.chunk_id, c.kg_version FROM h JOIN nd USING (doc_id) JOIN c USING (chunk_id) JOIN r ON r.kg_version = c.kg_version),
    e AS (SELECT DISTINCT entity_id AS id, kg_version FROM m), sel AS (SELECT id, arg_min(kg_version, rank) AS kg_version FROM e JOIN r USING (kg_version) GROUP BY 1),
    ids AS (SELECT DISTINCT own.doc_id, m.entity_id AS id FROM own JOIN m USING (chunk_id) JOIN r ON r.kg_version = m.kg_version)
    SELECT doc_id, 'document' AS what, doc_id AS id, kg_version FROM nd UNION ALL SELECT doc_id, 'chunk', chunk_id, kg_version FROM own UNION ALL SELECT doc_id, 'entity', id, kg_version FROM ids JOIN sel USING (id)""")
def document_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents with copies in three versions, of which the chain has two; each entity's newest version on it is visible."""
    chunks, mentions, held, _ = _texts(spark, sf_dir)
    chain = spark.createDataFrame([("v3", 0), ("v2", 1)], "kg_version string, rank int")
    n = F.col("doc_id")
    copies = table(spark, sf_dir, "documents").select("source", n, F.explode(F.array(*(F.lit(v) for v in (1, 2, 3)))).alias("v")).where((F.length("source") + F.col("v") + n) % 2 == 0)
    documents = copies.select(F.col("source").alias("doc_id"), F.concat(F.lit("v"), "v").alias("kg_version")).distinct()
    entities = mentions.select(F.col("entity_id").alias("id"), "kg_version").distinct()
    selection = entities.join(chain, "kg_version").groupBy("id").agg(F.min_by("kg_version", "rank").alias("kg_version"))
    return evidence.document_subgraph(documents, chunks, held, mentions, entities, chain, selection)


@query("SELECT c_custkey AS id, (c_nationkey % 3)::VARCHAR AS kg_version, CASE WHEN c_custkey % 4 <> 0 THEN 'o' || c_custkey % 4 END AS org_id FROM customer WHERE c_nationkey % 3 = 1 AND (c_custkey % 4 = 0 OR c_custkey % 4 = 2)")
def version_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version's nodes of one tenant or of none."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).cast("string").alias("kg_version"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("o"), F.col("c_custkey") % 4)).alias("org_id"))
    return evidence.in_version(rows, "1", "o2")
