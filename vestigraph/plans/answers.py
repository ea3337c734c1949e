"""Queries on recorded answers, layouts, evidence, inherited windows and versions in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.operators import citations, documents, evaluation, layout, temporal, versions
from vestigraph.plans.registry import query, table

_MENTION = "[A-Z][a-z]{4,}"
_PIECE = "(?s).{1,400}"
_CITED = f"""
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    c AS (SELECT 'chunk-' || doc_id || 'x' || i AS chunk_id, doc_id, i, (i - 1) * 400 AS base, ps[i] AS body FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{_PIECE}') AS ps FROM d))),
    s AS (SELECT chunk_id, mention, instr(body, mention) - 1 AS a FROM (SELECT chunk_id, body, unnest(list_distinct(regexp_extract_all(body, '{_MENTION}'))) AS mention FROM c)),
    i AS (SELECT doc_id AS answer_id, chunk_id, i - 1 AS nth, '' AS said FROM c UNION ALL SELECT doc_id, chunk_id, 100000 + i - 1, lower(regexp_extract(body, '{_MENTION}')) FROM c UNION ALL SELECT doc_id, 'chunk-' || (doc_id + 1) || 'x1', 1000000, '' FROM d),
    l AS (SELECT answer_id, i.chunk_id, nth, coalesce(a, 0) AS x, CASE WHEN a IS NULL THEN length(c.body) ELSE least(length(c.body), a + length(mention)) END AS y FROM i /*given*/ JOIN c ON c.chunk_id = i.chunk_id LEFT JOIN s ON s.chunk_id = i.chunk_id AND lower(mention) = said AND said <> ''),
    lx AS (SELECT answer_id, chunk_id, nth, arg_min(x, (x, y)) AS x, arg_min(y, (x, y)) AS y FROM l GROUP BY 1, 2, 3),
    b AS (SELECT answer_id, chunk_id, min(nth) AS nth, arg_min(x, (y - x, nth)) AS char_offset, arg_min(y, (y - x, nth)) AS char_end FROM lx GROUP BY 1, 2),
    g AS (SELECT doc_id AS answer_id, trim(unnest(regexp_extract_all(t, '{citations.HARD}'))) AS f FROM d UNION SELECT d.doc_id, mention FROM d JOIN c ON c.doc_id = d.doc_id OR c.chunk_id = 'chunk-' || (d.doc_id + 1) || 'x1' JOIN s ON s.chunk_id = c.chunk_id WHERE contains(t, mention)),
    fs AS (SELECT answer_id, list(f) AS fs FROM g WHERE length(f) >= 2 GROUP BY 1)
"""


def _citations(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    chunk = lambda doc, n: F.concat(F.lit("chunk-"), doc, F.lit("x"), n)
    pieces = F.regexp_extract_all("t", F.lit(_PIECE), F.lit(0))
    parts = docs.select("doc_id", F.posexplode(pieces).alias("nr", "text"))
    chunks = parts.select(chunk(F.col("doc_id"), F.col("nr") + 1).alias("chunk_id"), "doc_id", (F.col("nr") * 400).alias("char_start"), "text", (F.floor(F.col("nr") / 2) + 1).cast("int").alias("page"))
    names = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(_MENTION), F.lit(0)))
    each = chunks.select("chunk_id", "text", "char_start", F.explode(names("text")).alias("mention"))
    spans = each.select("chunk_id", "mention", (F.col("char_start") + F.instr("text", F.col("mention")) - 1).alias("char_start")).withColumn("char_end", F.col("char_start") + F.length("mention"))
    own = F.transform("ps", lambda p, i: chunk(F.col("doc_id"), i + 1))
    named = F.transform("ps", lambda p, i: F.concat(F.lit("see "), chunk(F.col("doc_id"), i + 1), F.lit("#"), F.regexp_extract(p, _MENTION, 0)))
    other = chunk(F.col("doc_id") + 1, F.lit(1))
    rows = docs.withColumn("ps", pieces)
    evidence = F.concat(own, named, F.array(other, F.lit("chunk-none"), F.lit("no id")))
    answers = rows.select(F.col("doc_id").alias("answer_id"), F.col("t").alias("answer"), evidence.alias("evidence"), F.size("ps").alias("n"))
    given = F.concat(own, F.array(other)) if every else F.filter(own, lambda _, i: i % 2 == 0)
    injected = rows.select(F.col("doc_id").alias("answer_id"), F.explode(given).alias("chunk_id"))
    found = citations.located(answers, chunks, spans, injected)
    kept = citations.grounded(found, answers, injected, chunks, spans).join(answers.select("answer_id", "n"), "answer_id")
    nth = F.when(F.col("nth") < F.col("n"), F.col("nth")).when(F.col("nth") < 2 * F.col("n"), 100000 + F.col("nth") - F.col("n")).otherwise(1000000)
    return kept.withColumn("nth", nth).drop("n")


@query(f"WITH {_CITED} SELECT answer_id, b.chunk_id, nth, char_offset, char_end FROM b JOIN c USING (chunk_id) LEFT JOIN fs USING (answer_id) WHERE fs IS NULL OR len(list_filter(fs, lambda f: contains(body, f))) > 0")
def citation_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, whole, as an answer that cites all its chunks, the first name in each, its neighbour's first chunk and what doesn't exist."""
    return _citations(spark, sf_dir, True).select("answer_id", "chunk_id", "nth", "char_offset", "char_end")


@query(rf"""WITH {_CITED.replace("/*given*/", "JOIN c g ON g.chunk_id = i.chunk_id AND g.doc_id = i.answer_id AND g.i % 2 = 1").replace("d.doc_id OR c.chunk_id = 'chunk-' || (d.doc_id + 1) || 'x1'", "d.doc_id AND c.i % 2 = 1")},
    v AS (SELECT chunk_id, regexp_replace(body, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS v FROM c)
    SELECT answer_id, b.chunk_id, nth, char_offset, char_end, ((i - 1) // 2 + 1)::INT AS page, CASE WHEN length(v) <= 200 THEN v ELSE substr(v, 1, 200) || '…' END AS snippet
    FROM b JOIN c USING (chunk_id) JOIN v USING (chunk_id) LEFT JOIN fs USING (answer_id) WHERE fs IS NULL OR len(list_filter(fs, lambda f: contains(body, f))) > 0""")
def citation_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers where only every other chunk was given: the others, and the neighbour's, are no citations."""
    return _citations(spark, sf_dir, False).select("answer_id", "chunk_id", "nth", "char_offset", "char_end", "page", "snippet")


_BLOCK = 400


@query(rf"""WITH p AS (SELECT doc_id, i, substr(text, i * {_BLOCK} + 1, {_BLOCK}) AS t FROM (SELECT doc_id, text, unnest(range((length(text) + {_BLOCK} - 1) // {_BLOCK})) AS i FROM documents)),
    q AS (SELECT doc_id, i, t, regexp_replace(t, '^[\s\p{{Z}}]+', '') AS b FROM p), r AS (SELECT doc_id, i, length(t) - length(b) AS lead, regexp_replace(b, '[\s\p{{Z}}]+$', '') AS b FROM q)
    SELECT doc_id, i * {_BLOCK} + lead AS char_start, i * {_BLOCK} + lead + length(b) AS char_end, (i // 2 + 1)::INT AS page FROM r WHERE b <> ''""")
def page_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as two blocks a page, found again in their text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    flat = F.transform(pieces, lambda p, i: F.struct(p.alias("text"), F.floor(i / 2).alias("page_idx")))
    return layout.page_spans(docs.where("length(text) > 0").withColumn("layout", F.to_json(flat)))


@query("""WITH e AS (SELECT l_partkey AS clause, CASE WHEN l_linenumber = 7 THEN date_trunc('month', l_shipdate)::DATE END AS f FROM lineitem), o AS (SELECT clause, CASE count(DISTINCT f) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS found, CASE WHEN count(DISTINCT f) = 1 THEN min(f) END AS own FROM e GROUP BY 1),
    g AS (SELECT l_partkey AS clause, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN DATE '2000-01-01' + min(l_suppkey)::INT END AS doc FROM lineitem WHERE l_linenumber = 6 GROUP BY 1)
    SELECT p_partkey AS clause, coalesce(found, 'none') AS found, coalesce(own, doc) AS valid_from FROM part LEFT JOIN o ON o.clause = p_partkey LEFT JOIN g ON g.clause = p_partkey""")
def clause_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as clauses, order lines as dated edges; suppliers stand for documents that declare a window."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "clause")
    none = F.lit(None).cast("date").alias("valid_to")
    edges = lines.select("clause", F.when(F.col("l_linenumber") == 7, F.trunc("l_shipdate", "month")).alias("valid_from"), none)
    claims = lines.where("l_linenumber = 6").select("clause", F.date_add(F.lit("2000-01-01").cast("date"), F.col("l_suppkey").cast("int")).alias("valid_from"), none)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clause"))
    rows = temporal.inherited_window(parts, temporal.single_window(edges, "clause"), temporal.single_window(claims, "clause"), "clause")
    return rows.select("clause", "found", F.col("window.valid_from").alias("valid_from"))


@query("""WITH f AS (SELECT l_suppkey AS head, l_partkey AS tail, l_orderkey AS source, l_linenumber AS n, CASE WHEN l_returnflag <> 'R' THEN l_shipdate::DATE END AS f, CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE + l_linenumber END AS t FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY source, n) AS first, row_number() OVER (PARTITION BY head, tail ORDER BY f NULLS LAST, source, n) AS early, row_number() OVER (PARTITION BY head, tail ORDER BY t IS NULL, source, n) AS ended FROM f)
    SELECT head, tail, CASE WHEN bool_or(first = 1 AND f IS NULL) THEN NULL ELSE min(f) END AS valid_from, max(CASE WHEN ended = 1 THEN t END) AS valid_to, CASE WHEN bool_or(first = 1 AND f IS NULL) THEN max(CASE WHEN first = 1 THEN source END) ELSE max(CASE WHEN early = 1 THEN source END) END AS source FROM r GROUP BY 1, 2""")
def earliest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier - part facts told by many orders, as one fact each."""
    day = F.to_date("l_shipdate")
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("head"), F.col("l_partkey").alias("tail"), F.col("l_orderkey").alias("source"), F.col("l_orderkey").alias("told"), "l_linenumber",
        F.when(F.col("l_returnflag") != "R", day).alias("valid_from"), F.when(F.col("l_linestatus") == "F", F.date_add(day, F.col("l_linenumber"))).alias("valid_to"),
    )
    return temporal.earliest_fact(facts, ["head", "tail"], ["told", "l_linenumber"])


@query("""WITH e AS (SELECT *, round(value * 100)::BIGINT AS tokens FROM events), s AS (SELECT sum(tokens)::BIGINT AS tokens, count(DISTINCT user_id) AS n_docs, sum(CASE WHEN event_type IN ('click', 'view') THEN tokens ELSE 0 END)::BIGINT AS i, sum(CASE WHEN event_type = 'purchase' THEN tokens ELSE 0 END)::BIGINT AS a FROM e)
    SELECT tokens, n_docs, CASE WHEN n_docs > 0 THEN round(tokens / n_docs, 6) ELSE 0 END::DOUBLE AS per_doc, CASE WHEN a > 0 THEN round(i / a, 6) ELSE 0 END::DOUBLE AS cost_ratio FROM s""")
def cost_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows by kind of event, put together: a user who occurs in several rows counts once."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("tokens"), F.col("user_id").alias("doc"))
    days, docs = evaluation.accumulated(rows, ["day", "stage"], "doc", "tokens")
    spent = lambda *kinds: F.when(F.col("stage").isin(*kinds), F.col("tokens")).otherwise(0)
    return evaluation.dashboard(days.withColumn("incremental", spent("click", "view")).withColumn("full", spent("purchase")), docs)


@query("""WITH e AS (SELECT ts::DATE AS day, event_type AS stage, round(value * 100)::BIGINT AS tokens, user_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
    SELECT day::VARCHAR AS day, stage, count(*) AS n, sum(tokens)::BIGINT AS tokens, count(DISTINCT user_id) AS n_docs FROM e GROUP BY 1, 2""")
def cost_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("tokens"), "user_id")
    return evaluation.stage_series(rows, "day", "stage", "tokens", "user_id", "2024-01-05", "2024-01-20").withColumn("day", F.col("day").cast("string"))


@query("""WITH e AS (SELECT ts::DATE AS day, event_type AS stage, round(value * 100)::BIGINT AS tokens, user_id FROM events), t AS (SELECT day, stage, sum(tokens)::BIGINT AS tokens, count(DISTINCT user_id) AS n FROM e GROUP BY 1, 2)
    SELECT DISTINCT day::VARCHAR AS day, stage, user_id, round_even(t.tokens / n, 0)::BIGINT AS token_usage_total, 'completed' AS outcome, 0 AS sequence FROM e JOIN t USING (day, stage)""")
def cost_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's tokens of a stage dealt over its users."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("tokens"), "user_id")
    totals, docs = evaluation.accumulated(rows, ["day", "stage"], "user_id", "tokens")
    return evaluation.cost_records(totals, docs, ["day", "stage"], "user_id", "tokens").withColumn("day", F.col("day").cast("string"))


@query("""WITH t AS (SELECT o_orderkey, o_custkey, o_orderpriority, 'o_orderkey: ' || o_orderkey || '; o_custkey: ' || o_custkey || '; o_orderstatus: ' || o_orderstatus || '; o_orderpriority: ' || o_orderpriority AS text FROM orders)
    SELECT 'chunk-' || substr(sha256('orders|' || o_orderkey || '|' || text), 1, 12) AS chunk_id, text, unnest([o_custkey::VARCHAR, o_orderpriority]) AS mention FROM t""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.evidence_rows(table(spark, sf_dir, "orders"), "orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_custkey", "o_orderpriority"])


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, max(l_discount) * 10 AS sure FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY sure DESC, l_linenumber) AS nth FROM u WHERE sure >= 0.5), k AS (SELECT l_orderkey, l_linenumber FROM r WHERE nth <= 3)
    SELECT l_orderkey, k.l_linenumber AS head, j.l_linenumber AS tail FROM k JOIN k j USING (l_orderkey) WHERE j.l_linenumber = k.l_linenumber + 1""")
def confidence_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most certain lines of an order, and the relations between neighbouring lines that survive with them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_discount") * 10).alias("confidence"))
    found = lines.select("*", F.col("l_linenumber").alias("char_start"), F.col("l_linenumber").alias("char_end"), F.lit("LINE").alias("entity_type"))
    relations = lines.select("l_orderkey", F.col("l_linenumber").alias("head"), (F.col("l_linenumber") + 1).alias("tail"))
    return documents.surviving(relations, documents.clamped(found, 3, "l_orderkey"), "l_orderkey", "l_linenumber", ("head", "tail")).select("l_orderkey", "head", "tail")


@query("""WITH l AS (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'm' END AS mention, CASE WHEN l_quantity < 3 THEN 'high' ELSE (l_discount * 10)::VARCHAR END AS c, CASE WHEN l_partkey % 9 <> 0 THEN l_linenumber END AS pos FROM lineitem),
    k AS (SELECT l_suppkey, trim(mention) = '' OR c = 'high' OR pos IS NULL AS bad, TRY_CAST(c AS DOUBLE) < 0.5 AS low FROM l)
    SELECT l_suppkey, count_if(NOT bad AND NOT low) AS kept, count_if(bad) AS malformed, count_if(NOT bad AND low) AS low_confidence FROM k GROUP BY 1""")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as extracted records, some without a name, a number or a place."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(c("l_linenumber") == 7, " ").otherwise("m").alias("mention"), F.when(c("l_quantity") < 3, "high").otherwise((c("l_discount") * 10).cast("string")).alias("confidence"), F.when(c("l_partkey") % 9 != 0, c("l_linenumber")).alias("char_start"))
    return documents.floored(rows, ["l_suppkey"])[1]


@query("""WITH v AS (SELECT o_custkey % 7 AS org, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'active' ELSE 'building' END AS status FROM orders), n AS (SELECT org, max(version) AS new FROM v WHERE status = 'ready' AND org < 5 GROUP BY 1)
    SELECT org, version, CASE WHEN version = new THEN 'active' WHEN new IS NOT NULL AND status = 'active' THEN 'superseded' ELSE status END AS status FROM v LEFT JOIN n USING (org)""")
def activate_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "active").otherwise("building")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("org"), F.col("o_orderkey").alias("version"), status.alias("status"))
    chosen = rows.where("status = 'ready' and org < 5").groupBy("org").agg(F.max("version").alias("version"))
    return versions.activated(rows, chosen)
