"""Bounded path search over typed edges, and how a path is judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigraph.functions.scope import strict_tenant, valid_at


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, with its own id, so that a walk can tell edges apart."""
    e = edges.withColumn("edge", F.struct("src", "dst", "kind"))
    return e.select("src", "dst", "edge", "valid_from", "valid_to").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge", "valid_from", "valid_to"))


def scoped(edges: DataFrame, as_of: str | None, org: str | None, chain: DataFrame | None = None) -> DataFrame:
    """The edges that every hop of a search may take: of the tenant (a search without one is an error), of a version on the chain (kg_version), valid on the day, or open without one."""
    rows = edges.where(strict_tenant(F.col("org_id"), org) & valid_at(F.col("valid_from"), F.col("valid_to"), as_of))
    return rows if chain is None else rows.join(chain.select("kg_version"), "kg_version", "left_semi")


def _begun(starts: DataFrame, e: DataFrame) -> DataFrame:
    return starts.select(F.col("id").alias("start"), F.col("id").alias("terminal"), F.array("id").alias("ids"), F.array().cast(f"array<{e.schema['edge'].dataType.simpleString()}>").alias("used"), F.array().cast("array<date>").alias("froms"), F.array().cast("array<date>").alias("tos"))


def _stepped(walk: DataFrame, e: DataFrame, *more: str) -> DataFrame:
    """Walks with one more edge that none of them has yet; `more` columns of the edges go along."""
    step = walk.join(e, walk["terminal"] == e["src"]).where(~F.array_contains("used", F.col("edge")))
    return step.select("start", F.col("dst").alias("terminal"), F.concat("ids", F.array("dst")).alias("ids"), F.concat("used", F.array("edge")).alias("used"), F.concat("froms", F.array("valid_from")).alias("froms"), F.concat("tos", F.array("valid_to")).alias("tos"), *more)


def paths(starts: DataFrame, edges: DataFrame, nodes: DataFrame, longest: int = 3, hub: str | None = None) -> DataFrame:
    """Walks of 1 to `longest` edges from starts (id), no edge twice: start, ids, kinds, froms, tos, terminal, terminal_type, hops. Nodes of type `hub` may be ends only."""
    e = undirected(edges)
    typed = nodes.select(F.col("id").alias("terminal"), F.col("type").alias("terminal_type"))
    walk, out = _begun(starts, e), []
    for hops in range(1, longest + 1):
        step = _stepped(walk, e).join(typed, "terminal")
        out.append(step.withColumn("hops", F.lit(hops)))
        walk = step.where(F.lit(True) if hub is None else F.col("terminal_type") != hub).drop("terminal_type")
    return reduce(DataFrame.unionByName, out).withColumn("kinds", F.transform("used", lambda u: u["kind"])).drop("used")


def verdict(froms: Column, tos: Column) -> Column:
    """unknown if a start is missing; consistent if the last start is not after the first end; else inconsistent. An open end is no bound."""
    last_start, first_end = F.array_max(froms), F.array_min(F.filter(tos, lambda t: t.isNotNull()))
    return F.when(F.exists(froms, lambda f: f.isNull()), "unknown").when(first_end.isNull() | (last_start <= first_end), "consistent").otherwise("inconsistent")


def last_hop_holds(froms: Column, tos: Column, day: Column) -> Column:
    f, t = F.try_element_at(froms, F.lit(-1)), F.try_element_at(tos, F.lit(-1))
    return F.coalesce((f <= day) & (t.isNull() | (t > day)), F.lit(False))


def _judged(found: DataFrame, day: Column) -> tuple[DataFrame, Column]:
    """found with verdict and proven, and what ranks paths of one class and length."""
    judged = found.withColumn("verdict", verdict(F.col("froms"), F.col("tos"))).withColumn("proven", last_hop_holds(F.col("froms"), F.col("tos"), day))
    level = F.when(F.col("verdict") == "consistent", 0).when(F.col("verdict") == "unknown", 1).otherwise(2)
    return judged, F.struct("hops", level.alias("level"), F.when(F.col("proven"), 0).otherwise(1).alias("unproven"), "ids")


def best(found: DataFrame, priority: Column, rank: Column, day: Column) -> DataFrame:
    """One path for each start, by: terminal priority, terminal rank, hops, verdict, last hop proven at the day, ids."""
    judged, order = _judged(found, day)
    kept = judged.groupBy("start").agg(F.min_by(F.struct(*(c for c in judged.columns if c != "start")), F.struct(priority.alias("priority"), rank.alias("rank"), order.alias("order"))).alias("p"))
    return kept.select("start", "p.*")


def search_best(starts: DataFrame, edges: DataFrame, nodes: DataFrame, priority: Column, rank: Column, day: Column, longest: int = 3, hub: str | None = None) -> DataFrame:
    """`best` over `paths`, level by level, without the walks that cannot win: start, terminal, terminal_type, ids, froms, tos, hops, verdict, proven.

    priority and rank: of a terminal's type (terminal_type). As both count before length, a start that has met the best of
    all classes goes no further, a level's walk counts only if its terminal is of a better class than any before, and of a
    level one walk for each start stays. The last level, which has the most walks, meets only edges to better terminals.
    """
    e, kind = undirected(edges), F.struct(priority.alias("priority"), rank.alias("rank"))
    typed = nodes.select(F.col("id").alias("dst"), F.col("type").alias("terminal_type")).withColumn("class", kind)
    ends = e.join(typed, "dst")
    top = typed.agg(F.min("class").alias("top"))  # one row
    walk, won = _begun(starts, e), None
    for hops in range(1, longest + 1):
        if won is None:
            step = _stepped(walk, ends, "terminal_type", "class")
        else:
            walk = walk.join(won.groupBy("start").agg(F.min("class").alias("so_far")), "start", "left").join(F.broadcast(top)).where("so_far is null or so_far > top")
            step = _stepped(walk, ends, "terminal_type", "class", "so_far")
            step = step.where("so_far is null or class < so_far").drop("so_far") if hops == longest else step.drop("so_far")
        judged, order = _judged(step.drop("used").withColumn("hops", F.lit(hops)), day)
        level = judged.groupBy("start").agg(F.min_by(F.struct(*(c for c in judged.columns if c != "start")), F.struct("class", order.alias("order"))).alias("p")).select("start", "p.*")
        won = level if won is None else won.unionByName(level)
        walk = step.where(F.lit(True) if hub is None else F.col("terminal_type") != hub).drop("terminal_type", "class")
    one = won.groupBy("start").agg(F.min_by(F.struct(*(c for c in won.columns if c != "start")), F.struct("class", "hops")).alias("p"))
    return one.select("start", "p.*").drop("class")
