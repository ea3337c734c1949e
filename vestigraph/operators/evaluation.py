"""Measures of findings against gold, exact bounds, gates and cost."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding_key(kind: Column, members: Column) -> Column:
    """A finding is its kind and its sorted distinct members."""
    return F.struct(kind.alias("kind"), F.array_sort(F.array_distinct(members)).alias("members"))


def ratio(part: Column, whole: Column) -> Column:
    """Null, not zero, where there is nothing to measure."""
    return F.when(whole > 0, part / whole)


def recall_and_false_positives(gold: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """One row: distinct gold and detected keys, hits, recall, and share of detected that is not gold."""
    marked = gold.select(key, F.lit(1).alias("g"), F.lit(0).alias("d")).unionByName(detected.select(key, F.lit(0).alias("g"), F.lit(1).alias("d")))
    each = marked.groupBy(key).agg(F.max("g").alias("g"), F.max("d").alias("d"))  # one shuffle, and no join's sorts
    hit = (F.col("g") == 1) & (F.col("d") == 1) & F.col(key).isNotNull()
    n = each.agg(F.count_if(F.col("g") == 1).alias("n_gold"), F.count_if(F.col("d") == 1).alias("n_detected"), F.count_if(hit).alias("n_hit"))
    return n.select("*", F.round(ratio(F.col("n_hit"), F.col("n_gold")), 6).alias("recall"), F.round(ratio(F.col("n_detected") - F.col("n_hit"), F.col("n_detected")), 6).alias("false_positive_rate"))


def gain(system: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (system - baseline) / baseline)


def _bound(k: int, n: int, alpha: float, lower: bool) -> float | None:
    """One-sided exact binomial bound, by halving on the tail probability."""
    if n <= 0 or not 0 <= k <= n:
        return None
    if lower and k == 0 or not lower and k == n:
        return 0.0 if lower else 1.0
    log_pick = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(n + 1)]
    at = range(k, n + 1) if lower else range(k + 1)
    lo, hi = 0.0, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = math.fsum(math.exp(log_pick[i] + i * math.log(p) + (n - i) * math.log1p(-p)) for i in at)
        if (tail < alpha) == lower:
            lo = p
        else:
            hi = p
    return (lo + hi) / 2


def exact_bounds(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """struct(lower, upper): one-sided Clopper-Pearson bounds."""

    @F.pandas_udf("lower double, upper double")
    def bounds(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(_bound(int(a), int(b), alpha, True), _bound(int(a), int(b), alpha, False)) for a, b in zip(ks, ns, strict=True)], columns=["lower", "upper"])

    return bounds(k, n)


def gate(results: DataFrame, baseline: DataFrame, directions: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """results (criterion, value, gold_count, detected_count) against baseline (criterion, base): a verdict for each.

    directions (criterion, higher_is_better): only a change for the worse beyond the tolerance fails. Nothing unmeasured,
    without a baseline or without a direction passes.
    """
    joined = results.join(baseline, "criterion", "left").join(directions, "criterion", "left")
    delta = F.col("value") - F.col("base")
    worse = F.when(F.col("higher_is_better"), -delta).otherwise(delta)
    verdict = F.when((F.col("gold_count") > 0) & (F.col("detected_count") == 0), "empty_graph").when(F.col("value").isNull(), "not_measured").when(F.col("base").isNull(), "no_baseline").when(F.col("higher_is_better").isNull(), "no_direction").when(worse > tolerance, "regressed").otherwise("passed")
    return joined.select("criterion", "value", "base", verdict.alias("verdict"))


def judged(value: Column, threshold: Column, higher: Column, bound: Column, provisional: Column) -> Column:
    """indeterminate without a value or threshold; fail; underpowered where the value passes but its confidence bound doesn't; else pass, or pass (provisional)."""
    reaches = lambda x: F.when(higher, x >= threshold).otherwise(x <= threshold)
    passed = F.when(provisional, "pass_provisional").otherwise("pass")
    return F.when(value.isNull() | threshold.isNull(), "indeterminate").when(~reaches(value), "fail").when(bound.isNotNull() & ~reaches(bound), "underpowered").otherwise(passed)


def status(linked: Column, labelled: Column, rubric: Column, final: Column) -> Column:
    """How far a criterion can be measured at all."""
    return F.when(~linked, "blocked").when(~labelled | ~rubric, "unknown").when(~final, "measured_provisional").otherwise("measured")


def accuracy(answers: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Share of right answers among the judged ones; null where none was judged."""
    found = answers.groupBy(*by).agg(F.count(correct).alias("n_judged"), F.count_if(correct).alias("n_right"))
    return found.withColumn("accuracy", ratio(F.col("n_right"), F.col("n_judged")))


def match_key(rule: str) -> Column:
    """What makes two relations the same, by direction: `triple`, `entity_pair` or `canonical_name`."""
    columns = {"triple": ("head", "kind", "tail"), "entity_pair": ("head", "tail"), "canonical_name": ("head_name", "kind", "tail_name")}[rule]
    return F.struct(*columns)


def covered(citations: Column, span_required: bool = False, prefix: str = "chunk-") -> Column:
    """An answer is covered if it has citations and all are of chunks, and (span_required) have a place. citations: array of struct (chunk_id, has_span)."""
    good = F.forall(citations, lambda c: c["chunk_id"].startswith(prefix) & (c["has_span"] if span_required else F.lit(True)))
    return F.coalesce((F.size(citations) > 0) & good, F.lit(False))


def sheets(answers: DataFrame, questions: DataFrame, key: str = "index") -> DataFrame:
    """Answers beside their questions. An answer without a question raises when the rows are read: it must not drop out of a measure unseen."""
    rows = answers.join(questions.withColumn("__there", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("no question for answer "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.where(F.coalesce("__there", lost.cast("boolean"))).drop("__there")


def usage_totals(calls: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Sums of token fields, calls, and how many fields were missing; a missing one counts as 0."""
    sums = [F.sum(F.coalesce(F.col(f), F.lit(0))).alias(f) for f in fields]
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *sums, F.sum(sum((F.col(f).isNull().cast("long") for f in fields), F.lit(0))).alias("missing"))


def accumulated(days: DataFrame, by: list[str], docs: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """Day rows put together: tokens of each key, and the distinct documents counted for it as rows (key, doc). The ids stay rows, so that no day becomes one huge array."""
    return days.groupBy(*by).agg(F.sum(tokens).alias(tokens)), days.select(*by, docs).where(F.col(docs).isNotNull()).distinct()


def cost_records(totals: DataFrame, docs: DataFrame, by: list[str], doc: str, tokens: str) -> DataFrame:
    """A day's tokens dealt evenly over its documents (half to even), a row for each; days without documents have none."""
    n = docs.groupBy(*by).agg(F.count("*").alias("__n"))
    per = totals.join(n, by).select(*by, F.bround(F.col(tokens) / F.col("__n")).cast("long").alias("token_usage_total"))
    return docs.join(per, by).select(*by, doc, "token_usage_total", F.lit("completed").alias("outcome"), F.lit(0).alias("sequence"))


def layer(entities: DataFrame, chunks: DataFrame, by: str = "kg_version", prefix: str = "ent_") -> DataFrame:
    """Where a version's content comes from: L2 if it has extracted entities, else L1 if it has chunks at all; versions with neither have no row."""
    a = entities.groupBy(by).agg(F.count_if(F.col("id").startswith(prefix)).alias("extracted"))
    rows = a.join(chunks.groupBy(by).agg(F.count("*").alias("chunks")), by, "full").select(by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("extracted", "chunks")))
    return rows.where("extracted > 0 or chunks > 0").withColumn("layer", F.when(F.col("extracted") > 0, "L2").otherwise("L1"))


def version_counts(versions: DataFrame, documents: DataFrame, entities: DataFrame, relations: DataFrame, by: str = "kg_version") -> DataFrame:
    """Documents, entities and relations of each version; 0 where there are none."""
    rows = versions.select(by).distinct()
    for name, df in (("doc_count", documents), ("entity_count", entities), ("relation_count", relations)):
        rows = rows.join(df.groupBy(by).agg(F.count("*").alias(name)), by, "left")
    return rows.na.fill(0)


def extraction_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(measure, n): entities by type, ungrounded ones, and derived relations."""
    types = entities.groupBy(F.concat(F.lit("type "), F.col("type")).alias("measure")).agg(F.count("*").alias("n"))
    loose = entities.agg(F.lit("ungrounded").alias("measure"), F.count_if(~F.col("grounded")).alias("n"))
    return types.unionByName(loose).unionByName(relations.agg(F.lit("derived").alias("measure"), F.count_if("derived").alias("n")))


def cost_per_document(records: DataFrame, doc: str, tokens: str, order: Column, how: str = "last") -> DataFrame:
    """Tokens of each document: of its last or first record, or the sum of all."""
    pick = {"last": lambda: F.max_by(tokens, order), "first": lambda: F.min_by(tokens, order), "sum": lambda: F.sum(tokens)}[how]()
    return records.groupBy(doc).agg(pick.alias("tokens"))


def percentiles(values: DataFrame, group: str, value: str) -> DataFrame:
    """Linearly interpolated P50 and P90, and a ceiling: P90 and a fifth, to full hundreds."""
    p = values.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.9)).alias("p90"))
    return p.withColumn("ceiling", (F.floor(F.col("p90") * 1.2 / 100 + 0.5) * 100).cast("long"))


def drift(first: str, other: str) -> Column:
    """How two answers to a question differ: first and other are structs (refused, citation_ids, answer). Only white space is made even, so that other numbers are other answers."""
    even = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", " "))
    a, b = F.col(first), F.col(other)
    return F.when(~a["refused"].eqNullSafe(b["refused"]), "refusal_flip").when(~a["citation_ids"].eqNullSafe(b["citation_ids"]), "evidence_drift").when(even(a["answer"]) != even(b["answer"]), "wording_drift").otherwise("identical")


def dashboard(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """One row over daily rows (tokens, incremental, full) and their documents (doc, a row for each day that counts it): all tokens, distinct documents, tokens a document, and the cost ratio; ratios without a denominator are 0."""
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "incremental", "full")))
    n = docs.select("doc").distinct().agg(F.count("*").alias("n_docs"))
    per = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return sums.join(F.broadcast(n)).select("tokens", "n_docs", per("tokens", "n_docs").alias("per_doc"), per("incremental", "full").alias("cost_ratio"))


def stage_series(events: DataFrame, day: str, stage: str, tokens: str, doc: str, start: str, end: str) -> DataFrame:
    """Each day and stage of [start, end] in order of day: records, tokens, distinct documents."""
    inside = events.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    once = inside.groupBy(day, stage, doc).agg(F.count("*").alias("n"), F.sum(tokens).alias("t"))
    return once.groupBy(day, stage).agg(F.sum("n").alias("n"), F.sum("t").alias(tokens), F.count(doc).alias("n_docs")).orderBy(day, stage)
