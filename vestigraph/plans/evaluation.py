"""Queries on measures: recall, coverage, cost, bounds and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vestigraph.operators import evaluation
from vestigraph.plans.registry import query, table


@query("""WITH g AS (SELECT doc_id FROM labels WHERE quality = 1), d AS (SELECT doc_id FROM documents WHERE n_chars BETWEEN 200 AND 3000), n AS (SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM d) AS n_detected, (SELECT count(*) FROM g JOIN d USING (doc_id)) AS n_hit)
    SELECT *, round(n_hit / n_gold, 6) AS recall, round((n_detected - n_hit) / n_detected, 6) AS false_positive_rate FROM n""")
def recall_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").where("quality = 1")
    return evaluation.recall_and_false_positives(gold, table(spark, sf_dir, "documents").where("n_chars between 200 and 3000"), "doc_id")


_PAIRS = """l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), b AS (SELECT 'shared' AS kind, array_to_string(list_sort(list(l_suppkey)), ',') AS members, min(l_orderkey) AS o FROM l GROUP BY l_orderkey)"""


@query(f"""WITH {_PAIRS}, g AS (SELECT DISTINCT kind, members FROM b WHERE o % 3 <> 0), d AS (SELECT DISTINCT kind, members FROM b WHERE o % 2 = 0), n AS (SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM d) AS n_detected, (SELECT count(*) FROM g JOIN d USING (kind, members)) AS n_hit)
    SELECT *, round(n_hit / n_gold, 6) AS recall, round((n_detected - n_hit) / n_detected, 6) AS false_positive_rate FROM n""")
def finding_key_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings are the supplier groups of orders; two detectors of the same kind are compared by sorted members."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("m"))
    keyed = groups.select("l_orderkey", evaluation.finding_key(F.lit("shared"), F.col("m")).alias("finding"))
    return evaluation.recall_and_false_positives(keyed.where("l_orderkey % 3 != 0"), keyed.where("l_orderkey % 2 = 0"), "finding")


@query("""WITH a AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS cites, len(text) < 40 AS refused FROM conversations WHERE role = 'assistant')
    SELECT count(*) AS n_answers, count_if(refused) AS n_refused, round(avg(CASE WHEN NOT refused THEN (len(cites) > 0)::INT END), 6) AS coverage, round(avg((refused OR len(cites) > 0)::INT), 6) AS coverage_with_refused FROM a""")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with at least one capitalised reference, refused (very short) ones apart."""
    cites = F.size(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), 1)) > 0
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(cites.alias("cited"), (F.length("text") < 40).alias("refused"))
    of = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.agg(F.count("*").alias("n_answers"), F.count_if("refused").alias("n_refused"), of(F.when(~F.col("refused"), F.col("cited"))).alias("coverage"), of(F.col("refused") | F.col("cited")).alias("coverage_with_refused"))


@query("""WITH r AS (SELECT user_id, round(value * 100)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type <> 'error'), t AS (SELECT count(DISTINCT user_id) AS docs, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events)
    SELECT user_id, tokens, docs, total, round(total / docs, 4) AS per_doc FROM r, t WHERE nth = 1""")
def cost_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last successful record of each user, beside totals over distinct users."""
    events = table(spark, sf_dir, "events").withColumn("tokens", F.round(F.col("value") * 100).cast("long"))
    last = evaluation.cost_per_document(events.where("event_type != 'error'"), "user_id", "tokens", F.struct("ts", "event_id"))
    by = events.groupBy("user_id").agg(F.sum("tokens").alias("t")).agg(F.count("*").alias("docs"), F.sum("t").alias("total"))
    return last.join(F.broadcast(by)).withColumn("per_doc", F.round(F.col("total") / F.col("docs"), 4))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, (floor(quantile_cont(value, 0.9) * 1.2 / 100 + 0.5) * 100)::BIGINT AS ceiling FROM events GROUP BY 1""")
def percentile_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.percentiles(table(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"), "ceiling")


@query()
def binomial_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels by source, with exact one-sided bounds."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counts = rows.groupBy("source").agg(F.sum("toxic").cast("int").alias("k"), F.count("*").cast("int").alias("n"))
    return counts.withColumn("b", evaluation.exact_bounds(F.col("k"), F.col("n"))).select("source", "k", "n", F.round("b.lower", 6).alias("lower"), F.round("b.upper", 6).alias("upper"))


_BASES = [(f"src{i}", round(0.3 + 0.02 * i, 2)) for i in range(20) if i % 5]
_WAYS = [(f"src{i}", i % 2 == 0) for i in range(19)]


@query(f"""WITH r AS (SELECT source AS criterion, round(avg(quality), 6) AS value, count(*) AS gold_count, sum(toxic)::BIGINT AS detected_count FROM labels JOIN documents USING (doc_id) GROUP BY 1), b(criterion, base) AS (VALUES {', '.join(map(str, _BASES))}), w(criterion, up) AS (VALUES {', '.join(map(str, _WAYS))})
    SELECT criterion, value, base::DOUBLE AS base, CASE WHEN gold_count > 0 AND detected_count = 0 THEN 'empty_graph' WHEN value IS NULL THEN 'not_measured' WHEN base IS NULL THEN 'no_baseline' WHEN up IS NULL THEN 'no_direction' WHEN CASE WHEN up THEN base - value ELSE value - base END > 0.02 THEN 'regressed' ELSE 'passed' END AS verdict FROM r LEFT JOIN b USING (criterion) LEFT JOIN w USING (criterion)""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's share of good documents against a baseline; for odd sources less is better."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    results = rows.groupBy(F.col("source").alias("criterion")).agg(F.round(F.avg("quality"), 6).alias("value"), F.count("*").alias("gold_count"), F.sum("toxic").alias("detected_count"))
    return evaluation.gate(results, spark.createDataFrame(_BASES, "criterion string, base double"), spark.createDataFrame(_WAYS, "criterion string, higher_is_better boolean"))


_ANSWERS = r"""a AS (SELECT conv_id, turn, text, length(text) < 40 AS refused, list_transform(regexp_extract_all(text, '[A-Z][a-z]{5,}'), lambda w: 'chunk-' || lower(w)) AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'assistant')"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of assistants; capitalised words stand for cited chunks, and very short answers for refusals."""
    ids = F.transform(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), 1), lambda w: F.concat(F.lit("chunk-"), F.lower(w)))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", (F.length("text") < 40).alias("refused"), ids.alias("citation_ids"), F.col("text").alias("answer"))


@query(f"""WITH {_ANSWERS} SELECT x.conv_id, x.turn, CASE WHEN x.refused <> y.refused THEN 'refusal_flip' WHEN x.ids <> y.ids THEN 'evidence_drift' WHEN trim(regexp_replace(x.text, '\\s+', ' ', 'g')) <> trim(regexp_replace(y.text, '\\s+', ' ', 'g')) THEN 'wording_drift' ELSE 'identical' END AS drift
    FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.nth = x.nth + 1""".replace("\\\\s", "\\s"))
def answer_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer of a conversation against the next one."""
    said = _answers(spark, sf_dir).select("conv_id", "turn", F.struct("refused", "citation_ids", "answer").alias("a"))
    next_ = F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.withColumn("b", next_).where("b is not null").select("conv_id", "turn", evaluation.drift("a", "b").alias("drift"))


@query(f"""WITH {_ANSWERS}, d AS (SELECT refused, len(ids) > 0 AS cited, len(ids) > 0 AND len(list_filter(ids, lambda i: length(i) < 13)) = 0 AS placed FROM a)
    SELECT round(avg(CASE WHEN NOT refused THEN cited::INT END), 6) AS coverage, round(avg(cited::INT), 6) AS coverage_with_refused, round(avg(CASE WHEN NOT refused THEN placed::INT END), 6) AS coverage_with_spans FROM d""")
def citation_coverage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered answers, refused ones in and out; long names stand for citations with a place."""
    cites = F.transform("citation_ids", lambda i: F.struct(i.alias("chunk_id"), (F.length(i) >= 13).alias("has_span")))
    rows = _answers(spark, sf_dir).withColumn("c", cites)
    of = lambda c, all_: F.round(F.avg(F.when(F.lit(all_) | ~F.col("refused"), c.cast("int"))), 6)
    any_, placed = evaluation.covered(F.col("c")), evaluation.covered(F.col("c"), span_required=True)
    return rows.agg(of(any_, False).alias("coverage"), of(any_, True).alias("coverage_with_refused"), of(placed, False).alias("coverage_with_spans"))


@query("""WITH j AS (SELECT source, CASE WHEN d.doc_id % 3 <> 0 THEN quality = 1 END AS correct FROM documents d LEFT JOIN labels USING (doc_id))
    SELECT source, count(correct) AS n_judged, count_if(correct) AS n_right, CASE WHEN count(correct) > 0 THEN round(count_if(correct) / count(correct), 6) END AS accuracy FROM j GROUP BY 1""")
def judged_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgements of every document; two thirds count as judged where they have one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    right = rows.withColumn("correct", F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1))
    return evaluation.accuracy(right, ["source"]).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH s AS (SELECT source AS criterion, substr(source, 4)::INT AS k, round(avg(quality), 6) AS v FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
    r AS (SELECT criterion, k, CASE WHEN k % 7 <> 3 THEN v END AS value, CASE WHEN k % 5 <> 4 THEN 0.3 + 0.02 * k END AS threshold, k % 2 = 0 AS up, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN v - 0.1 ELSE v + 0.1 END END AS bound FROM s)
    SELECT criterion, CASE WHEN value IS NULL OR threshold IS NULL THEN 'indeterminate' WHEN (up AND value < threshold) OR (NOT up AND value > threshold) THEN 'fail' WHEN (up AND bound < threshold) OR (NOT up AND bound > threshold) THEN 'underpowered' WHEN k % 4 = 1 THEN 'pass_provisional' ELSE 'pass' END AS verdict,
    CASE WHEN k % 6 = 5 THEN 'blocked' WHEN k % 6 IN (3, 4) THEN 'unknown' WHEN k % 6 = 2 THEN 'measured_provisional' ELSE 'measured' END AS status FROM r""")
def criterion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's share of good documents as a criterion with a threshold, a bound and a direction of its own; some lack one."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    r = rows.groupBy(F.col("source").alias("criterion")).agg(F.round(F.avg("quality"), 6).alias("v")).withColumn("k", F.substring("criterion", 4, 9).cast("int"))
    k, v = F.col("k"), F.col("v")
    up, bound = k % 2 == 0, F.when(k % 3 != 0, F.when(k % 2 == 0, v - 0.1).otherwise(v + 0.1))
    verdict = evaluation.judged(F.when(k % 7 != 3, v), F.when(k % 5 != 4, F.lit(0.3) + F.lit(0.02) * k), up, bound, k % 4 == 1)
    return r.select("criterion", verdict.alias("verdict"), evaluation.status(k % 6 != 5, k % 6 != 4, k % 6 != 3, k % 6 != 2).alias("status"))


_RULES = {"triple": "l_suppkey, l_returnflag, l_partkey", "entity_pair": "l_suppkey, l_partkey", "canonical_name": "l_suppkey % 7, l_returnflag, l_partkey % 11"}


@query("WITH " + ", ".join(f"g_{r} AS (SELECT DISTINCT {k} FROM lineitem WHERE l_linenumber <= 4), d_{r} AS (SELECT DISTINCT {k} FROM lineitem WHERE l_linenumber >= 3), n_{r} AS (SELECT '{r}' AS rule, (SELECT count(*) FROM g_{r}) AS n_gold, (SELECT count(*) FROM d_{r}) AS n_detected, (SELECT count(*) FROM (SELECT * FROM g_{r} INTERSECT SELECT * FROM d_{r})) AS n_hit)" for r, k in _RULES.items()) + " SELECT *, round(n_hit / n_gold, 6) AS recall, round((n_detected - n_hit) / n_detected, 6) AS false_positive_rate FROM (" + " UNION ALL ".join(f"SELECT * FROM n_{r}" for r in _RULES) + ")")
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of the order lines as relations, matched by each of the three rules."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", c("l_suppkey").alias("head"), c("l_returnflag").alias("kind"), c("l_partkey").alias("tail"), (c("l_suppkey") % 7).alias("head_name"), (c("l_partkey") % 11).alias("tail_name"))
    out = []
    for rule in _RULES:
        keyed = rows.select("l_linenumber", evaluation.match_key(rule).alias("key"))
        out.append(evaluation.recall_and_false_positives(keyed.where("l_linenumber <= 4"), keyed.where("l_linenumber >= 3"), "key").select(F.lit(rule).alias("rule"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT event_type, count(*) AS calls, sum(CASE WHEN user_id % 4 <> 0 THEN user_id ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN event_id % 5 <> 0 THEN event_id ELSE 0 END)::BIGINT AS total, sum((user_id % 4 = 0)::INT + (event_id % 5 = 0)::INT)::BIGINT AS missing FROM events GROUP BY 1""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls whose usage is partly missing."""
    calls = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("prompt"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("total"))
    return evaluation.usage_totals(calls, ["event_type"], ["prompt", "total"])


@query("""WITH e AS (SELECT 'v' || c_nationkey AS kg_version, CASE WHEN c_acctbal < 0 THEN 'ent_' ELSE 'CUST:' END || c_custkey AS id FROM customer WHERE c_nationkey < 20), c AS (SELECT 'v' || n AS kg_version, count(*) AS chunks FROM (SELECT doc_id % 22 AS n FROM documents) WHERE n > 2 GROUP BY 1), x AS (SELECT kg_version, count_if(id LIKE 'ent\\_%' ESCAPE '\\') AS extracted FROM e GROUP BY 1)
    SELECT kg_version, coalesce(extracted, 0) AS extracted, coalesce(chunks, 0) AS chunks, CASE WHEN extracted > 0 THEN 'L2' ELSE 'L1' END AS layer FROM x FULL JOIN c USING (kg_version) WHERE coalesce(extracted, 0) > 0 OR coalesce(chunks, 0) > 0""".replace("\\\\", "\\"))
def corpus_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as versions; customers in debt stand for extracted entities."""
    version = lambda c: F.concat(F.lit("v"), c.cast("string")).alias("kg_version")
    entities = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(version(F.col("c_nationkey")), F.concat(F.when(F.col("c_acctbal") < 0, "ent_").otherwise("CUST:"), "c_custkey").alias("id"))
    chunks = table(spark, sf_dir, "documents").where("doc_id % 22 > 2").select(version(F.col("doc_id") % 22))
    return evaluation.layer(entities, chunks)


@query("""SELECT n_nationkey AS kg_version, (SELECT count(*) FROM documents WHERE doc_id % 30 = n_nationkey) AS doc_count, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS entity_count, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS relation_count FROM nation""")
def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as versions with their documents, customers and suppliers."""
    of = lambda name, c: table(spark, sf_dir, name).select(c.cast("int").alias("kg_version"))
    c = F.col
    return evaluation.version_counts(of("nation", c("n_nationkey")), of("documents", c("doc_id") % 30), of("customer", c("c_nationkey")), of("supplier", c("s_nationkey")))


@query("""SELECT t.conv_id, t.turn, q.text AS question, t.text AS answer FROM conversations t JOIN conversations q ON q.conv_id = t.conv_id AND q.turn = t.turn - 1 WHERE t.role = 'assistant' AND t.turn > 0""")
def judging_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer beside the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    key = F.struct("conv_id", F.col("turn").alias("turn")).alias("index")
    answers = turns.where("role = 'assistant' and turn > 0").select(key, F.col("text").alias("answer"))
    questions = turns.select(F.struct("conv_id", (F.col("turn") + 1).alias("turn")).alias("index"), F.col("text").alias("question"))
    return evaluation.sheets(answers, questions).select("index.*", "question", "answer")


@query("""WITH r AS (SELECT user_id, ts, event_id, round(value * 10)::BIGINT AS tokens FROM events), d AS (SELECT user_id, arg_max(tokens, (ts, event_id)) AS l, arg_min(tokens, (ts, event_id)) AS f, sum(tokens)::BIGINT AS s FROM r GROUP BY 1)
    SELECT 'last' AS how, count(*) AS n_docs, sum(l)::BIGINT AS tokens, round(avg(l), 4) AS mean FROM d UNION ALL SELECT 'first', count(*), sum(f)::BIGINT, round(avg(f), 4) FROM d UNION ALL SELECT 'sum', count(*), sum(s)::BIGINT, round(avg(s), 4) FROM d""")
def cost_per_doc_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean tokens of a document by its last record, its first, and all of them; users stand for documents."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.round(F.col("value") * 10).cast("long").alias("tokens"))
    parts = [evaluation.cost_per_document(rows, "user_id", "tokens", F.col("at"), how).agg(F.lit(how).alias("how"), F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("mean")) for how in ("last", "first", "sum")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
