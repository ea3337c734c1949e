"""Facts over time: snapshots, arbitration between facts, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.functions.scope import valid_at


def snapshot(edges: DataFrame, as_of: str | None) -> DataFrame:
    return edges.where(valid_at(F.col("valid_from"), F.col("valid_to"), as_of))


def arbitrated(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """The facts whose relation may have one current value only. policies (relation, policy): the relation's own, else that of `*`, else facts append."""
    rows = facts.join(policies.where("relation != '*'"), "relation", "left")
    rows = rows.join(policies.where("relation = '*'").agg(F.max("policy").alias("__any")))  # one row
    return rows.where(F.coalesce("policy", "__any", F.lit("append")) == "single_current").select(*facts.columns)


def nearest(entries: list[tuple]) -> list[tuple]:
    """Of (day, tail, source) in order of day the few that can be the first with another tail and another source, for any tail and source: four at most.

    An entry counts only for a tail and a source that between them rule out all entries kept before it, but not it.
    """
    kept: list[tuple] = []
    for day, tail, source in entries:
        free = not kept
        if kept:
            _, t, s = kept[0]
            others = {x[2] for x in kept if x[1] != t}
            free = len(others) <= 1 and tail != t and source not in others
            others = {x[1] for x in kept if x[2] != s}
            free = free or (len(others) <= 1 and source != s and tail not in others)
        if free:
            kept.append((day, tail, source))
    return kept


def superseded(facts: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """When a later fact of the same head and relation closes an earlier one: fact_id, expires_at.

    facts: fact_id, head, relation, tail, valid_from, source and, where known, valid_to. A fact that has not ended is
    closed by the earliest strictly later fact with another tail from another source; no source is no other's. Facts of a
    head and relation pass once, latest first, and four of those already seen are all that is kept, so a head with very
    many facts costs its rows, not their square.
    """
    live = facts if policies is None else arbitrated(facts, policies)
    open_ = F.col("valid_to").isNull() if "valid_to" in facts.columns else F.lit(True)
    rows = live.where("valid_from is not null").select("fact_id", "head", "relation", "tail", "valid_from", "source", open_.alias("open"))
    dealt = rows.repartition("head", "relation").sortWithinPartitions("head", "relation", F.desc("valid_from"))
    of = {f.name: f.dataType.simpleString() for f in rows.schema}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = day = None
        later: list[tuple] = []
        today: list[tuple] = []
        for b in batches:
            ids, days = [], []
            for nth, (head, relation, tail, at, source, may_close) in enumerate(zip(*(b.column(c).to_pylist() for c in ("head", "relation", "tail", "valid_from", "source", "open")), strict=True)):
                if (head, relation) != group:
                    group, day, later, today = (head, relation), at, [], []
                if at != day:
                    later, today, day = nearest(today + later), [], at
                hit = next((d for d, t, s in later if t != tail and (source is None or s != source)), None)
                if hit is not None and may_close:
                    ids.append(nth)
                    days.append(hit)
                today = nearest([*today, (at, tail, source)])
            yield pa.RecordBatch.from_arrays([b.column("fact_id").take(pa.array(ids, pa.int64())), pa.array(days, b.schema.field("valid_from").type)], names=["fact_id", "expires_at"])

    return dealt.mapInArrow(scan, f"fact_id {of['fact_id']}, expires_at {of['valid_from']}")


def same_anchor(facts: DataFrame, policies: DataFrame | None = None, position: str = "tail_position", ordinal: str = "ordinal") -> DataFrame:
    """Facts of one head and relation that begin on the same day: fact_id, expires_at for those that the last one in the text replaces.

    The last by position, then ordinal, stays, and so do facts with its tail. Where a position is unknown nothing is closed,
    nor without a day. Groups are combined by counts and positions alone, which take no sort; only the facts of a group at its
    last position are then compared by ordinal, and only where there are several.
    """
    live = (facts if policies is None else arbitrated(facts, policies)).where("valid_from is not null")
    anchor = ["head", "relation", "valid_from"]
    counted = live.groupBy(*anchor).agg(F.count("*").alias("n"), F.count(position).alias("known"), F.max(position).alias("last"))
    several = counted.where("n > 1 and n = known").select(*anchor, "last")
    met = live.select("fact_id", *anchor, "tail", position, ordinal).join(several, anchor)
    kept = met.where(F.col(position) == F.col("last")).groupBy(*anchor).agg(F.max(F.struct(ordinal, "tail"))["tail"].alias("kept"))
    return met.select("fact_id", *anchor, "tail").join(kept, anchor).where("tail != kept").select("fact_id", F.col("valid_from").alias("expires_at"))


def earliest_expiry(expiries: DataFrame, key: str = "fact_id") -> DataFrame:
    return expiries.groupBy(key).agg(F.min("expires_at").alias("expires_at"))


def sealed(edges: DataFrame, expiries: DataFrame) -> DataFrame:
    """Edges with valid_to set where they are still open and were superseded."""
    return edges.join(earliest_expiry(expiries), "fact_id", "left").withColumn("valid_to", F.coalesce("valid_to", "expires_at")).drop("expires_at")


def coverage(edges: DataFrame, kind: str) -> DataFrame:
    return edges.groupBy(kind).agg(F.count("*").alias("n"), F.count("valid_from").alias("with_from"), F.count("valid_to").alias("with_to"))


def single_window(edges: DataFrame, key: str) -> DataFrame:
    """key, found (none, one or many) and window (valid_from, valid_to): the one window that a key's edges name, else null. Edges with neither date name none."""
    named = F.when(F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull(), F.struct("valid_from", "valid_to"))
    ends = edges.groupBy(key).agg(F.min(named).alias("a"), F.max(named).alias("b"))
    one = F.col("a").eqNullSafe(F.col("b"))
    return ends.select(key, F.when(F.col("a").isNull(), "none").when(one, "one").otherwise("many").alias("found"), F.when(one, F.col("a")).alias("window"))


def inherited_window(keys: DataFrame, own: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """keys with the window of their own edges, else the one that documents agree on, else none; adds window and found."""
    rows = keys.join(own, key, "left").join(registered.select(key, F.col("window").alias("__doc")), key, "left")
    return rows.withColumn("window", F.coalesce("window", "__doc")).withColumn("found", F.coalesce("found", F.lit("none"))).drop("__doc")


def earliest_fact(facts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Facts found in several documents as one: the earliest start with its source, and the first known end.

    facts: keys, order (total within keys), source, valid_from, valid_to. Where the first fact has no start, it stays without.
    """
    known = lambda c: F.col(c).isNotNull()
    found = facts.groupBy(*keys).agg(
        F.min(F.struct(*order, "valid_from", "source")).alias("first"),
        F.min(F.when(known("valid_from"), F.struct("valid_from", *order, "source"))).alias("early"),
        F.min(F.when(known("valid_to"), F.struct(*order, "valid_to"))).alias("ended"),
    )
    of = lambda c: F.when(F.col("first.valid_from").isNull(), F.col(f"first.{c}")).otherwise(F.col(f"early.{c}")).alias(c)
    return found.select(*keys, of("valid_from"), F.col("ended.valid_to").alias("valid_to"), of("source"))
