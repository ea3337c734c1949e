"""Graph versions: which version of an entity is visible, and corrections that rewrite a version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: How a version's status may change.
MOVES = (("pending", "building"), ("building", "ready"), ("building", "failed"), ("pending", "failed"))


def chains(starts: DataFrame, actions: DataFrame, deepest: int = 16) -> DataFrame:
    """(org, start, version, rank): each start (org, version) and its ancestors, all tenants in one job.

    actions: org, result, parent, created_at, id. The last action that made a version names its parent; actions without a
    parent don't. A chain ends before a version that it holds already, and after `deepest` versions.
    """
    parents = actions.where("parent is not null").groupBy("org", "result").agg(F.max_by("parent", F.struct("created_at", "id")).alias("parent"))
    at = starts.select("org", F.col("version").alias("start"), "version", F.array("version").alias("seen"))
    out = [at.withColumn("rank", F.lit(0))]
    for rank in range(1, deepest):
        step = at.join(parents, (at["org"] == parents["org"]) & (at["version"] == parents["result"])).where(~F.array_contains("seen", F.col("parent")))
        at = step.select(at["org"], "start", F.col("parent").alias("version"), F.concat("seen", F.array("parent")).alias("seen"))
        out.append(at.withColumn("rank", F.lit(rank)))
    return reduce(DataFrame.unionByName, out).select("org", "start", "version", "rank")


def scopes(actions: DataFrame) -> DataFrame:
    """(org, version, id): what the actions (org, result, target_entities as JSON) that made a version said they would change. Several actions of a version add up; what is no JSON names nothing."""
    ids = F.from_json("target_entities", "entity_ids array<string>, new_entity_ids array<string>")
    rows = actions.where("result is not null").withColumn("t", ids)
    both = F.array_union(*(F.coalesce(F.col(f"t.{c}"), F.array().cast("array<string>")) for c in ("entity_ids", "new_entity_ids")))
    return rows.select("org", F.col("result").alias("version"), F.explode(both).alias("id")).where("id != ''").distinct()


def probed(wanted: DataFrame, entities: DataFrame, org: str) -> DataFrame:
    """wanted (id) with a verdict: `ok`, `leaked` where another tenant owns it - worse than `missing`, so told apart from it."""
    owner = entities.groupBy("id").agg(F.max(F.col("org_id") == org).alias("own"), F.count("org_id").alias("n"))
    rows = wanted.select("id").distinct().join(owner, "id", "left")
    return rows.select("id", F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("own"), "ok").otherwise("leaked").alias("verdict"))


def moved(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """versions (version, status) after changes (version, to, entity_count, relation_count, error_code): status, the fields that go with it, and `refused` where the move isn't allowed. Counts come with ready only, the error with failed only."""
    rows = versions.join(changes, "version", "left")
    good = reduce(lambda a, b: a | b, ((F.col("status") == x) & (F.col("to") == y) for x, y in MOVES))
    now = F.when(good, F.col("to")).otherwise(F.col("status"))
    of = lambda c, state: F.when(good & (F.col("to") == state), F.col(c)).alias(c)
    return rows.select("version", now.alias("status"), of("entity_count", "ready"), of("relation_count", "ready"), of("error_code", "failed"), (F.col("to").isNotNull() & ~good).alias("refused"))


def consistency(active: Column, in_graph: Column, manifest: Column) -> Column:
    """struct(code, ok, drift): is the active version in the graph (null: it could not be asked), and the one that the backup names? Without an active version there is nothing to compare, which proves nothing but isn't wrong."""
    code = F.when(F.coalesce(active, F.lit("")) == "", "no_active_version").when(in_graph.isNull(), "graph_unreachable").when(~in_graph, "ghost_version").otherwise("pg_graph_consistent")
    drift = F.coalesce((manifest != "") & (active != "") & (manifest != active), F.lit(False))
    return F.struct(code.alias("code"), code.isin("no_active_version", "pg_graph_consistent").alias("ok"), drift.alias("drift"))


def visible(present: DataFrame, scopes: DataFrame, key: str = "id") -> DataFrame:
    """key and rank of the version that shows it.

    present: (key, rank), the chain's versions (0 the newest) that hold the entity. scopes: (key, rank), versions whose
    correction names it. An entity named by a correction that no longer holds it was removed there; it is visible if it
    is present in a newer version than that.
    """
    here = present.groupBy(key).agg(F.min("rank").alias("shown"))
    gone = scopes.select(key, "rank").distinct().join(present.select(key, "rank").distinct(), [key, "rank"], "left_anti").groupBy(key).agg(F.min("rank").alias("removed"))
    return here.join(gone, key, "left").where("removed is null or shown < removed").select(key, F.col("shown").alias("rank"))


def newest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def merge_entities(nodes: DataFrame, edges: DataFrame, left: int, right: int) -> tuple[DataFrame, DataFrame]:
    """right becomes an alias of left: left's aliases, right's name and right's aliases in that order, each once; the larger confidence stays, edges move, and self loops and repeats go."""
    moved = lambda c: F.when(F.col(c) == right, left).otherwise(F.col(c)).alias(c)
    none = F.array().cast("array<string>")
    of = lambda key, c: F.max(F.when(F.col("id") == key, F.col(c)))
    both = nodes.where(F.col("id").isin(left, right)).agg(F.max("confidence").alias("c"), of(left, "aliases").alias("own"), of(right, "name").alias("name"), of(right, "aliases").alias("other"))
    every = F.concat(F.coalesce("own", none), F.array("name"), F.coalesce("other", none))
    both = both.select("c", F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))).alias("a"))
    kept = nodes.where(F.col("id") != right).join(F.broadcast(both))
    is_left = F.col("id") == left
    kept = kept.select("id", "name", F.when(is_left, F.col("a")).otherwise(F.col("aliases")).alias("aliases"), F.when(is_left, F.col("c")).otherwise(F.col("confidence")).alias("confidence"))
    return kept, edges.select(moved("src"), moved("dst"), "kind").where("src != dst").distinct()


def split_entity(nodes: DataFrame, edges: DataFrame, target: int, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """target is replaced by parts (new_id, new_name). An edge moves only to the part whose name its neighbour bears; its other edges go."""
    clones = nodes.where(F.col("id") == target).join(F.broadcast(parts)).select(F.col("new_id").alias("id"), F.col("new_name").alias("name"), "aliases", "confidence")
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("new_name"))
    touching = edges.where((F.col("src") == target) != (F.col("dst") == target))
    other = F.when(F.col("src") == target, F.col("dst")).otherwise(F.col("src"))
    moved = touching.withColumn("other", other).join(names, "other").join(F.broadcast(parts), "new_name")
    moved = moved.select(F.when(F.col("src") == target, F.col("new_id")).otherwise(F.col("src")).alias("src"), F.when(F.col("dst") == target, F.col("new_id")).otherwise(F.col("dst")).alias("dst"), "kind")
    rest = edges.where((F.col("src") != target) & (F.col("dst") != target))
    return nodes.where(F.col("id") != target).unionByName(clones), rest.unionByName(moved)


def renamed(nodes: DataFrame, target: int, name: str) -> DataFrame:
    """The old name becomes an alias."""
    is_it = (F.col("id") == target) & (F.col("name") != name)
    return nodes.select("id", F.when(is_it, F.lit(name)).otherwise(F.col("name")).alias("name"), F.when(is_it, F.array_distinct(F.concat("aliases", F.array("name")))).otherwise(F.col("aliases")).alias("aliases"), "confidence")


def affected(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds (id) and their neighbours."""
    s = seeds.select("id").distinct()
    out = edges.join(s, edges["src"] == s["id"], "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(s, edges["dst"] == s["id"], "left_semi").select(F.col("src").alias("id"))
    return s.unionByName(out).unionByName(back).distinct()


def inner_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def rewritten(nodes: DataFrame, edges: DataFrame, ids: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """An incremental version: copies of the affected nodes (id), and of the edges with both ends among them, under the new version. Edges to the rest stay in the old version alone."""
    copies = nodes.join(ids.select("id").distinct(), "id", "left_semi").withColumn("kg_version", F.lit(version))
    return copies, inner_edges(edges, ids).withColumn("kg_version", F.lit(version))


def activated(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """versions (org, version, status) after chosen (org, version) of each tenant becomes active: what was active there is superseded. Only ready versions can be chosen; other tenants stay."""
    ready = versions.where("status = 'ready'").select("org", F.col("version").alias("__new")).join(chosen.select("org", F.col("version").alias("__new")).distinct(), ["org", "__new"], "left_semi")
    rows = versions.join(ready, "org", "left")
    status = F.when(F.col("version") == F.col("__new"), "active").when(F.col("__new").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return rows.select("org", "version", status.alias("status"))
