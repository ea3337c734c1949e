"""Relationship patterns over edge tables (src, dst, ...): shared attributes, ownership cycles, amounts that disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.functions.scope import valid_at
from vestigraph.session import shared_path


#: Members of one tile: a value that more sources share is cut into tiles, and each two tiles meet in a task of their own.
TILE = 1000
#: Pairs of full tiles, and rows of one side, that a task gets on the mean.
TASK_TILES, TASK_ROWS = 2, 1_000_000


def pairs_by_tiles(members: DataFrame, value: str = "dst", member: str = "src", tile: int = TILE) -> DataFrame:
    """left_id < right_id and shared, for distinct (member, value) rows: each two members of a value once.

    A value of up to `tile` members is one key of the join. A larger one is n / tile tiles by a hash of the member, and a
    key is an ordered pair of tiles, so no key has more than two tiles' rows, whatever share of all members a value has.
    Few members make many pairs, so the number of tasks goes by the pairs, not by the members' size.
    """
    sized = members.groupBy(F.col(value).alias("shared")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    rows = members.select(F.col(value).alias("shared"), F.col(member).alias("member")).join(sized.drop("n"), "shared")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("member"), F.col("tiles")).cast("int"))
    low = rows.select("shared", F.col("member").alias("a"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("tiles") - 1)).alias("j"))
    high = rows.select("shared", F.col("member").alias("b"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    work = sized.agg(F.coalesce(F.sum(F.pow("n", F.lit(2))), F.lit(0.0)) / (2 * tile * tile * TASK_TILES), F.coalesce(F.sum(F.col("n") * F.col("tiles")), F.lit(0)) / TASK_ROWS).first()
    n = max(1, min(int(max(work)) + 1, 20000))
    dealt = lambda rows: rows.repartition(n, "shared", "i", "j")
    met = dealt(low).hint("merge").join(dealt(high), ["shared", "i", "j"]).where("(i < j and a != b) or a < b")
    return met.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "shared")


def shared_pairs(edges: DataFrame, as_of: str | None = None, temporal: bool = True, tile: int = TILE) -> DataFrame:
    """left_id < right_id for sources that share a destination, each pair and destination once. Both edges must be valid."""
    live = edges.where(valid_at(F.col("valid_from"), F.col("valid_to"), as_of)) if temporal else edges
    return pairs_by_tiles(live.where("src is not null and dst is not null").select("src", "dst").distinct(), tile=tile)


def shared_groups(edges: DataFrame, as_of: str | None = None, temporal: bool = True) -> DataFrame:
    """The same relation in linear size: each member with its group's size and smallest member."""
    live = edges.where(valid_at(F.col("valid_from"), F.col("valid_to"), as_of)) if temporal else edges
    live = live.where("dst is not null").select("src", "dst").distinct()
    groups = live.groupBy("dst").agg(F.count("*").alias("group_size"), F.min("src").alias("class_id")).where("group_size > 1")
    return live.join(groups, "dst").select(F.col("src").alias("member_id"), F.col("dst").alias("shared"), "group_size", "class_id")


def cycles(edges: DataFrame, longest: int = 4, simple: bool = False) -> DataFrame:
    """Closed walks of 2 to `longest` edges from their smallest node, no edge twice (simple: no node twice): n1..n4 without the closing node, and hops.

    A cycle is a walk that leaves its smallest node and one that comes back to it, each half as long, which meet by that
    node and the one in the middle. So no walk is made that has more than half of the edges of the longest cycle, and all
    keep to nodes not smaller than the start, so each cycle is found from one node only, and once. The distinct edges
    are written once, as all halves begin with them.
    """
    kind, path = edges.schema["src"].dataType, shared_path(edges.sparkSession, "cycle-edges")
    edges.where("src != dst").select("src", "dst").distinct().write.parquet(path)
    e = edges.sparkSession.read.schema(edges.select("src", "dst").schema).parquet(path)
    leaving, coming, out = e.where("dst > src").toDF("n1", "n2"), {1: e.where("src > dst").toDF("m1", "n1")}, []
    for half in range(1, -(-longest // 2) + 1):
        if half > 1:
            leaving = _further(leaving.join(e.toDF(f"n{half}", f"n{half + 1}"), f"n{half}"), "n", half, simple)
        for back in (half - 1, half):
            if not back or half + back > longest:
                continue
            if back not in coming:
                coming[back] = _further(coming[back - 1].join(e.toDF(f"m{back}", f"m{back - 1}"), f"m{back - 1}"), "m", back, simple)
            # The k-th last node of a cycle of k = half + back edges: the first of the way back is where both meet.
            last = coming[back].select("n1", *(F.col(f"m{j}").alias(f"n{half + back + 1 - j}") for j in range(1, back + 1)))
            met = leaving.join(last, ["n1", f"n{half + 1}"])
            nodes = [f"n{j}" for j in range(1, half + back + 1)] + ["n1"]
            if back > 1:  # up to three edges can't repeat one
                pair = lambda j: (F.col(nodes[j]), F.col(nodes[j + 1]))
                for i in range(half):
                    for j in range(half, half + back):
                        met = met.where(~((pair(i)[0] == pair(j)[0]) & (pair(i)[1] == pair(j)[1])))
                if simple:
                    for i in range(1, half + 1):
                        for j in range(half + 1, half + back):
                            met = met.where(F.col(nodes[i]) != F.col(nodes[j]))
            out.append(met.select(*(F.col(f"n{j}") if j <= half + back else F.lit(None).cast(kind).alias(f"n{j}") for j in range(1, longest + 1)), F.lit(half + back).alias("hops")))
    return reduce(DataFrame.unionByName, out)


def _further(grown: DataFrame, name: str, edges: int, simple: bool) -> DataFrame:
    """Of walks that have just come to so many edges, those without a node below n1 and without an edge twice (simple: a node twice). n1 is an end of each; the other nodes are n2 and on, or m1 and on."""
    first = 2 if name == "n" else 1
    nodes = [F.col("n1"), *(F.col(f"{name}{j}") for j in range(first, first + edges))]
    grown = grown.where(nodes[-1] >= F.col("n1"))
    for a, b in zip(nodes[:-2], nodes[1:-1], strict=True):  # both sides in the order in which nodes were added
        grown = grown.where(~((a == nodes[-2]) & (b == nodes[-1])))
    for other in nodes[:-1] if simple else ():
        grown = grown.where(other != nodes[-1])
    return grown


def amounts_disagree(a: Column, b: Column, c: Column) -> Column:
    """All three are there and not all equal; a missing amount is no mismatch."""
    return F.coalesce(~((a == b) & (b == c)), F.lit(False))


def spread(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(a, b, c) - F.least(a, b, c)


def with_evidence(suspicions: DataFrame, evidence: DataFrame, key: str, order: list[Column], most: int = 6) -> DataFrame:
    """At most `most` evidence rows for each suspicion; a suspicion without evidence goes."""
    ranked = suspicions.join(evidence, key).withColumn("evidence_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("evidence_rank") <= most)


def summary(suspicions: DataFrame, kind: str) -> DataFrame:
    """Count by kind, and over all kinds."""
    by = suspicions.groupBy(kind).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.join(F.broadcast(total))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)
