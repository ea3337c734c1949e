"""What a reader is shown of a graph: node and edge rows, attributes, listings and their filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.session import shared_path

# Relation names that pass as they are, and the categories of entity types.
RELATIONS = ("HAS_CHUNK", "MENTIONS", "SUPPORTED_BY", "AFFILIATED_WITH", "SUPPLIES_TO", "PARTY_TO", "HAS_FINANCIAL_INDICATOR", "OPERATES_SEGMENT", "RELATED")
CATEGORIES = {"topic": "核心主题 次主题 主题", "norm": "法规 标准 规范 REGULATION CONTRACT_CLAUSE", "org": "组织 机构 公司 部门 ORG LEGAL_PERSON", "system": "系统 平台 工具"}
# Fields of the store itself, and those that a detail view shows elsewhere.
STORED = ("kg_version", "pii_flags")
SHOWN = ("id", "kg_version", "org_id", "canonical_name", "name", "type", "confidence", "pii_flags")
# Attendance states that need an explanation; levels of findings in order.
ANOMALIES, LEVELS = ("absent", "missing_check_in"), ("high", "medium", "low")
SUSPICION_ROWS = 200


def relation_type(semantic: Column, physical: Column) -> Column:
    """The meaning that the extraction gave, else the stored type, if known; else MENTIONS."""
    return F.when(semantic.isin(*RELATIONS), semantic).when(physical.isin(*RELATIONS), physical).otherwise("MENTIONS")


def within(kind: Column, known: Column, fallback: str = "RELATED") -> Column:
    """A type that the vocabulary knows, else the fallback. known: whether it does, as of a join."""
    return F.when(F.coalesce(known, F.lit(False)), kind).otherwise(fallback)


def typed(rows: DataFrame, vocabulary: DataFrame, kind: str = "kind", fallback: str = "RELATED") -> DataFrame:
    """rows whose kind stands in vocabulary (kind); others get the fallback."""
    known = vocabulary.select(F.col("kind").alias(kind)).distinct().withColumn("__known", F.lit(True))
    return rows.join(known, kind, "left").withColumn(kind, within(F.col(kind), F.col("__known"), fallback)).select(*rows.columns)


def category(kind: Column, own: Column) -> Column:
    """The tenant's own category of a type, else the built-in one, else topic; no type is topic whatever the tenant says."""
    built_in = F.when(F.lit(False), kind)
    for name, kinds in CATEGORIES.items():
        built_in = built_in.when(kind.isin(*kinds.split()), name)
    return F.when(F.coalesce(kind, F.lit("")) == "", "topic").otherwise(F.coalesce(own, built_in, F.lit("topic")))


def stripped(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, v: ~k.isin(*STORED))


def attributes(rows: DataFrame, key: str = "id", properties: str = "properties") -> DataFrame:
    """(key, label, value) of what a detail view doesn't show elsewhere; nulls go."""
    return rows.select(key, F.explode(F.map_filter(properties, lambda k, v: ~k.isin(*SHOWN) & v.isNotNull())).alias("label", "value"))


def weight(confidence: Column) -> Column:
    """Size of a node; no confidence, or none at all, counts as a half."""
    return F.round(0.3 + F.least(F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.5)), F.lit(1.0)) * 1.35, 2)


def seed(node_id: Column) -> Column:
    """Place of a node from the first two bytes of its id's digest; no id is the middle."""
    byte = lambda at: F.round(F.conv(F.substring(F.md5(node_id), at, 2), 16, 10).cast("int") / 255.0, 3)
    return F.when(node_id == "", F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))).otherwise(F.struct(byte(1).alias("x"), byte(3).alias("y")))


def overview_edges(edges: DataFrame, visible: DataFrame, chain: DataFrame) -> DataFrame:
    """One edge for each ordered pair of visible ids (id), the newest on the chain (kg_version, rank); no loops. Ends are compared as ids, so an edge that only an older version holds still joins corrected nodes."""
    rows = edges.where("src != dst").join(chain, "kg_version")
    for end in ("src", "dst"):
        rows = rows.join(visible.select(F.col("id").alias(end)), end, "left_semi")
    best = rows.groupBy("src", "dst").agg(F.min(F.struct("rank", "id", "kind")).alias("e"))
    return best.select("src", "dst", "e.id", "e.kind")


def neighbours(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """nodes (id) with their first out-neighbours by id, whether there are more, and all edges out and in. A node without neighbours keeps a row."""
    degree = lambda end, name: edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
    out = edges.where("src != dst").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.col("kind"))
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("neighbour", "kind"))).where(F.col("nth") <= limit + 1)
    more = out.groupBy("id").agg((F.max("nth") > limit).alias("has_more"))
    rows = nodes.select("id").join(degree("src", "out_degree"), "id", "left").join(degree("dst", "in_degree"), "id", "left").join(more, "id", "left")
    rows = rows.join(out.where(F.col("nth") <= limit).drop("nth"), "id", "left")
    return rows.select("id", "neighbour", "kind", F.coalesce("has_more", F.lit(False)).alias("has_more"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_degree", "in_degree")))


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows that agree with every value that is asked for; None asks for nothing."""
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), rows)


def hash_search(rows: DataFrame, query: str | None, column: str = "filename_hash") -> DataFrame:
    """Rows whose hash begins with the query, without case; an empty query asks for all."""
    said = (query or "").strip().lower()
    return rows.where(F.col(column).startswith(said)) if said else rows


def suspicions(rows: DataFrame, limit: int = SUSPICION_ROWS, **wanted: object) -> DataFrame:
    """The listing in order of severity's name - high, low, medium - then time and id, at most `limit`."""
    return filtered(rows, **wanted).orderBy("severity", "created_at", "id").limit(limit)


def level_rank(level: Column) -> Column:
    return F.coalesce(*(F.when(level == name, i) for i, name in enumerate(LEVELS)), F.lit(9))


def findings(rows: DataFrame, **wanted: object) -> DataFrame:
    """Findings of the compliance rules by level, person and rule."""
    return filtered(rows, **wanted).orderBy(level_rank(F.col("level")), "employee_id", "rule")


def numbered(ordered: DataFrame, name: str = "nth") -> DataFrame:
    """Rows of a sorted table with their place from 1. The sort's ranges are written as they stand and number their own rows; a range's count, one number each, tells where the next begins."""
    spark, path = ordered.sparkSession, shared_path(ordered.sparkSession, "ordered")
    ordered.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__range", F.shiftrightunsigned("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("__range", "__at", "__base")


def anomalies(days: DataFrame, employee: str | None = None, namespace: str = "EMPLOYEE:") -> DataFrame:
    """Days (employee_id, date, status) that need an explanation. Only people of the namespace count: extracted fragments bear other ids."""
    rows = days.where(F.col("status").isin(*ANOMALIES) & F.col("employee_id").startswith(namespace))
    rows = filtered(rows, employee_id=None if employee is None else namespace + employee)
    return rows.withColumn("employee_id", F.substr("employee_id", F.lit(len(namespace) + 1))).orderBy("employee_id", "date")


def latest_task(tasks: DataFrame, by: str = "org_id") -> DataFrame:
    """The task of each tenant that was completed last; tasks under way and failed ones don't count."""
    done = tasks.where("status = 'completed' and completed_at is not null")
    return done.groupBy(by).agg(F.max_by(F.struct(*(c for c in done.columns if c != by)), F.struct("completed_at", "id")).alias("t")).select(by, "t.*")


def with_counts(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with the entity count of their version (version_id, entity_count); null without a version."""
    return documents.join(versions.select("version_id", "entity_count"), "version_id", "left")


def tenants(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (t.select("org_id") for t in tables)).distinct()


def hits(rules: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Rule hits (kind, a, b, shared) and algorithm hits (kind, members, details) in one shape."""
    one = rules.select("kind", F.array("a", "b", "shared").alias("members"), F.lit(None).cast(algorithms.schema["details"].dataType).alias("details"))
    return one.unionByName(algorithms.select("kind", "members", "details"))


def ordered_union(*lists: Column) -> Column:
    """The lists one after another, each value at its first place."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array()) for x in lists)))


def hop_origin(hops: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """hops (path_id, hop, source_id, target_id, target_name) with origin and evidence: the first chunk (path_id, chunk_id, nth, text) of the path's evidence that names the target, else an edge of the subgraph, either way, else the search."""
    said = hops.join(chunks, "path_id").where((F.col("target_name") != "") & F.contains("text", "target_name"))
    told = said.groupBy("path_id", "hop").agg(F.concat(F.lit("chunk:"), F.min_by("chunk_id", "nth")).alias("evidence"))
    both = edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id")).unionByName(edges.select(F.col("dst").alias("source_id"), F.col("src").alias("target_id"))).distinct().withColumn("__edge", F.lit(True))
    rows = hops.join(told, ["path_id", "hop"], "left").join(both, ["source_id", "target_id"], "left")
    origin = F.when(F.col("evidence").isNotNull(), "document").when(F.col("__edge"), "graph").otherwise("cypher")
    return rows.select(*hops.columns, origin.alias("origin"), "evidence")
