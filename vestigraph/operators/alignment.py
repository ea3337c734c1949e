"""Aligning records with subjects by a cascade of keys, and resolving entities by name."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigraph.functions.text import jaccard, name_bigrams
from vestigraph.session import shared_path

# Fixed value: the share of rows that has to align before a load.
LEAST_RATE = 0.95
#: Parts of the rows that have no key.
SALTS = 1000
# Thresholds of the two tiers, bonus for each shared attribute and its cap, cap with contradicting tax ids.
AUTO, REVIEW, BONUS, BONUS_CAP, CONFLICT_CAP = 0.90, 0.70, 0.05, 0.10, 0.85
# Attributes that raise a name's similarity where both sides have the same.
SHARED = ("address", "phone", "legal_rep")


def cascade(records: DataFrame, subjects: DataFrame, levels: list[str], subject: str) -> DataFrame:
    """records with level, aligned_id and reason. levels: key columns of both sides, strongest first.

    The first level with any hit decides: one subject aligns, several are `multiple_candidates`, and weaker levels are not tried. No hit at all is `no_match`, no key at all `key_missing`.
    """
    out = records
    for k in levels:
        found = subjects.where(F.col(k).isNotNull()).groupBy(F.col(k)).agg(F.count_distinct(subject).alias(f"n_{k}"), F.min(subject).alias(f"id_{k}"))
        spread = F.when(F.col(k).isNull(), F.pmod(F.xxhash64(*records.columns), F.lit(SALTS))).otherwise(0)  # rows without a key meet nothing; they need not meet in one task
        out = out.withColumn("__salt", spread).join(found.withColumn("__salt", F.lit(0).cast("long")), [k, "__salt"], "left").drop("__salt")
    level = F.coalesce(*(F.when(F.col(f"n_{k}").isNotNull(), F.lit(k)) for k in levels))
    n, hit = F.coalesce(*(F.col(f"n_{k}") for k in levels)), F.coalesce(*(F.col(f"id_{k}") for k in levels))
    missing = F.coalesce(*(F.col(k).cast("string") for k in levels)).isNull()
    reason = F.when(n == 1, F.lit(None).cast("string")).when(n > 1, "multiple_candidates").when(missing, "key_missing").otherwise("no_match")
    return out.select(*records.columns, F.when(n == 1, level).alias("level"), F.when(n == 1, hit).alias("aligned_id"), reason.alias("reason"))


def statistics(aligned: DataFrame) -> DataFrame:
    """Rows by level and reason, and the share that aligned."""
    by = aligned.groupBy("level", "reason").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("level").isNotNull(), F.col("n")).otherwise(0)).alias("aligned"))
    return by.join(F.broadcast(total)).select("level", "reason", "n", F.round(F.col("aligned") / F.col("total"), 6).alias("alignment_rate"))


def rate(aligned: DataFrame, least: float = LEAST_RATE) -> DataFrame:
    """One row: aligned, total, alignment_rate (0 without rows) and whether it reaches `least`."""
    n = aligned.agg(F.count("level").alias("aligned"), F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, F.col("aligned") / F.col("total")).otherwise(0.0)
    return n.select("aligned", "total", F.round(share, 6).alias("alignment_rate"), (share >= least).alias("passed"))


def gated(aligned: DataFrame, least: float = LEAST_RATE) -> DataFrame:
    """The rows, if enough of them align; too few raise, and nothing is loaded."""
    found = rate(aligned, least).first()
    if not found["passed"]:
        raise ValueError(f"{found['aligned']} of {found['total']} rows align, a rate of {found['alignment_rate']}; {least} is asked for")
    return aligned


def sequence_ratio(a: Column, b: Column) -> Column:
    """Longest-matching-blocks ratio; no built-in has it."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(left, right, strict=True)])

    return ratio(a, b)


def name_similarity(a: Column, b: Column, with_ratio: bool = True, grams: tuple[Column, Column] | None = None) -> Column:
    """grams: the two names' distinct bigrams, where a caller has them for each name already."""
    near = jaccard(*(grams or (name_bigrams(a), name_bigrams(b))))
    near = F.greatest(near, sequence_ratio(a, b)) if with_ratio else near
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.round(near, 6))


def bag(text: Column) -> Column:
    """Characters, each with its number among its like, so that a set of them counts repeats."""
    chars = F.split(text, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def prefix_pairs(left: DataFrame, right: DataFrame | None, need: float, dice: bool) -> DataFrame:
    """(block, left_key, right_key): all pairs in one block whose sets can reach a similarity of `need`, and few others.

    left, right: block, key, tokens (distinct). Without right, left meets itself, key before key. Tokens are put in one
    order, the rarest of a block first. Sets that are similar enough share one of their first few tokens, as the rest alone
    would not do; what could still follow the shared token's places must suffice as well, and the sizes must. So rows come
    from rare tokens that two sets share, not from the block. dice: overlap 2 o / (a + b), else Jaccard o / (a + b - o).
    """
    both = left if right is None else left.unionByName(right)
    rarity = both.select("block", F.explode("tokens").alias("token")).groupBy("block", "token").agg(F.count("*").alias("n"))
    least = need / (2 - need) if dice else need  # of the other set's size, and of what must be shared of one's own

    def firsts(rows: DataFrame, side: str) -> DataFrame:
        each = rows.select("block", "key", F.explode("tokens").alias("token")).join(rarity, ["block", "token"])
        ranked = each.groupBy("block", "key").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")).withColumn("size", F.size("t"))
        few = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
        return ranked.select("block", "key", "size", F.posexplode(F.slice("t", 1, few)).alias("at", "e")).select("block", F.col("e.token").alias("token"), *(F.col(c).alias(f"{side}_{c}") for c in ("key", "size", "at")))

    met = firsts(left, "left").join(firsts(left if right is None else right, "right"), ["block", "token"])
    if right is None:
        met = met.where("left_key < right_key")
    smaller, larger = F.least("left_size", "right_size"), F.greatest("left_size", "right_size")
    total = F.col("left_size") + F.col("right_size")
    wanted = total * (need / 2) if dice else total * (need / (1 + need))
    left_over = F.least(F.col("left_size") - F.col("left_at"), F.col("right_size") - F.col("right_at"))
    return met.where((smaller >= larger * least - 1e-9) & (left_over >= wanted - 1e-9)).select("block", "left_key", "right_key").distinct()


def near_names(left: DataFrame, right: DataFrame | None, need: float, with_ratio: bool) -> DataFrame:
    """(left_key, right_key) of names (block, key, grams, name) whose bigrams may have a Jaccard similarity of `need` or, with_ratio, whose characters may allow such a ratio: matching blocks are common characters, with repeats."""
    sets = lambda df, tokens: df.select("block", "key", tokens.alias("tokens"))
    of = lambda tokens, dice: prefix_pairs(sets(left, tokens), None if right is None else sets(right, tokens), need, dice)
    found = of(F.col("grams"), False)
    if with_ratio:
        found = found.unionByName(of(bag(F.col("name")), True)).distinct()
    return found.select("left_key", "right_key")


def scored(similarity: Column, shared: Column, tax_conflict: Column) -> Column:
    """Name similarity and bonus for shared attributes; contradicting tax ids cap it below the automatic tier."""
    total = F.least(F.lit(1.0), similarity + F.least(shared * BONUS, F.lit(BONUS_CAP)))
    return F.round(F.when(tax_conflict, F.least(total, F.lit(CONFLICT_CAP))).otherwise(total), 6)


def tier(similarity: Column) -> Column:
    return F.when(similarity >= AUTO, "auto_merged").when(similarity >= REVIEW, "human_review")


def candidates(names: DataFrame, key: str = "id", name: str = "name", prefix: int = 2, with_ratio: bool = True) -> DataFrame:
    """left_name < right_name of distinct names that share a prefix and are similar: similarity and tier. `members` rows bear a name, so equal names are never paired one by one."""
    by_name = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("members"), F.min(key).alias("id"))
    block = by_name.withColumn("block", F.substring("name", 1, prefix)).withColumn("grams", name_bigrams(F.col("name"))).withColumn("key", F.col("name"))
    side = lambda s: block.select(F.col("key").alias(f"{s}_key"), *(F.col(c).alias(f"{s}_{c}") for c in ("name", "members", "id", "grams")))
    met = near_names(block, None, REVIEW, with_ratio).join(side("left"), "left_key").join(side("right"), "right_key")
    met = met.withColumn("similarity", name_similarity(F.col("left_name"), F.col("right_name"), with_ratio, (F.col("left_grams"), F.col("right_grams"))))
    return met.withColumn("tier", tier(F.col("similarity"))).where("tier is not null").select("left_name", "right_name", "left_id", "right_id", "left_members", "right_members", "similarity", "tier")


#: Rows of a name that lie in one tile, pairs of rows that a task makes on the mean, and rows in tiles that it gets.
TILE, TASK_PAIRS, TASK_ROWS = 4096, 5_000_000, 1_000_000
#: What a tile belongs to: a name, or a name and one attribute's value, of rows with a tax id or of those without.
GROUP = ("key", "nr", "value", "open")


def raw_candidates(raw: DataFrame, canonical: DataFrame, prefix: int = 2, with_ratio: bool = True, tile: int = TILE) -> DataFrame:
    """(raw_id, canonical_id, similarity, tier): unaligned rows against subjects whose names share a prefix.

    Both sides: id, name, tax_id, address, phone, legal_rep. Rows that share a tax id are no candidates, they align;
    a raw row with several automatic hits has them all sent to review. Pairs of rows grow with the square of a name's rows,
    so they are made last, each two tiles of rows in one task, and are never shuffled: how many automatic hits a raw row
    has is counted before, over the pairs of which one has no tax id, as others contradict each other.
    """
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    distinct = lambda df: df.where(has("name")).select("name").distinct().select(F.substring("name", 1, prefix).alias("block"), F.col("name").alias("key"), name_bigrams(F.col("name")).alias("grams"), "name")
    # The bonus for shared attributes lowers what the name must give by itself. Two names are compared once, whatever number of rows bear them.
    pairs = near_names(distinct(raw), distinct(canonical), REVIEW - BONUS_CAP, with_ratio)
    for df, s in ((raw, "left"), (canonical, "right")):
        pairs = pairs.join(distinct(df).select(F.col("key").alias(f"{s}_key"), F.col("name").alias(f"{s}_name"), F.col("grams").alias(f"{s}_grams")), f"{s}_key")
    near = name_similarity(F.col("left_name"), F.col("right_name"), with_ratio, (F.col("left_grams"), F.col("right_grams")))
    alike = pairs.select(F.col("left_key").alias("raw_key"), F.col("right_key").alias("canonical_key"), near.alias("near")).where(F.col("near") >= REVIEW - BONUS_CAP - 1e-6)
    # Names that are alike enough link all their rows; of others only rows meet that share an attribute, each two at the first.
    all_rows = F.struct(F.lit(-1).alias("nr"), F.lit("").alias("value"))
    shared = [F.when(has(c), F.struct(F.lit(i).alias("nr"), F.col(c).cast("string").alias("value"))) for i, c in enumerate(SHARED)]
    grouped = lambda df: df.where(has("name")).select(F.col("name").alias("key"), "id", "tax_id", *SHARED, (~has("tax_id")).alias("open"), F.explode(F.array_compact(F.array(all_rows, *shared))).alias("at")).select("*", "at.*")
    sized = lambda df: grouped(df).groupBy(*GROUP).agg(F.count("*").alias("n"), F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    of = lambda df, s: df.withColumnsRenamed({c: f"{s}_{c}" for c in df.columns if c not in ("nr", "value")})
    linked = alike.join(of(sized(raw), "raw"), "raw_key").where((F.col("near") >= REVIEW - 1e-6) == (F.col("nr") < 0)).join(of(sized(canonical), "canonical"), ["canonical_key", "nr", "value"])
    scores = F.array(*(scored(F.col("near"), F.lit(n), F.lit(bool(conflict))) for n in range(len(SHARED) + 1) for conflict in (0, 1)))
    linked, path = linked.select("*", scores.alias("scores"), F.monotonically_increasing_id().alias("link")), shared_path(raw.sparkSession, "alike-names")
    linked.write.parquet(path)  # all that follows begins with them, and their numbers must stay
    links = raw.sparkSession.read.schema(linked.schema).parquet(path)
    open_ = F.col("raw_open") | F.col("canonical_open")
    some = links.where(open_ & (F.col("near") + BONUS_CAP >= AUTO - 1e-6))
    if not some.isEmpty():
        autos = _rows_met(some, grouped(raw).withColumn("autos", F.lit(0).cast("long")), grouped(canonical), tile).where("tier = 'auto_merged'")
        several = autos.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("autos")).where("autos > 1")
        return _rows_met(links, grouped(raw).join(several, "id", "left"), grouped(canonical), tile)
    return _rows_met(links, grouped(raw).withColumn("autos", F.lit(None).cast("long")), grouped(canonical), tile)


def _tiles(rows: DataFrame, tile: int, held: tuple[str, ...]) -> DataFrame:
    """(group, own, rows): each group's rows in lists of about `tile`."""
    n = rows.groupBy(*GROUP).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = rows.join(n, list(GROUP)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    return dealt.groupBy(*GROUP, "own").agg(F.collect_list(F.struct(*held)).alias("rows"))


def _rows_met(links: DataFrame, raw: DataFrame, canonical: DataFrame, tile: int) -> DataFrame:
    """(raw_id, canonical_id, similarity, tier) of all rows of linked groups. A key of the join is two tiles, which are shuffled as lists; their pairs come one by one from the join and go into no shuffle."""
    pairs, members = F.col("raw_n").cast("double") * F.col("canonical_n"), F.col("raw_n").cast("double") * F.col("canonical_tiles") + F.col("canonical_n").cast("double") * F.col("raw_tiles")
    work = links.agg(F.coalesce(F.sum(pairs), F.lit(0.0)) / TASK_PAIRS, F.coalesce(F.sum(members), F.lit(0.0)) / TASK_ROWS).first()
    n = max(1, min(int(max(work)) + 1, 20000))
    two = ["link", "raw_own", "canonical_own"]
    upto = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"{s}_tiles") - 1)).alias(f"{s}_own")
    units = links.select("*", upto("raw")).select("*", upto("canonical"))

    def side(rows: DataFrame, s: str, more: tuple[str, ...] = (), carried: tuple[str, ...] = ()) -> DataFrame:
        held = ("id", "tax_id", *SHARED, *more)
        lists = _tiles(rows, tile, held).withColumnsRenamed({"key": f"{s}_key", "open": f"{s}_open", "own": f"{s}_own"})
        dealt = units.join(lists, [f"{s}_key", "nr", "value", f"{s}_open", f"{s}_own"]).select(*two, *carried, "rows").repartition(n, *two)
        return dealt.select(*two, *carried, F.explode("rows").alias("r")).select(*two, *carried, *(F.col(f"r.{c}").alias(f"{s}_{c}") for c in held))

    met = side(raw, "raw", ("autos",), ("nr", "scores")).hint("merge").join(side(canonical, "canonical"), two)
    same = [F.coalesce((F.col(f"raw_{c}") == F.col(f"canonical_{c}")) & (F.col(f"raw_{c}") != ""), F.lit(False)) for c in SHARED]
    met = met.where(~F.coalesce(F.col("raw_tax_id") == F.col("canonical_tax_id"), F.lit(False)) & ((F.col("nr") < 0) | (F.col("nr") == F.coalesce(*(F.when(c, i) for i, c in enumerate(same))))))
    conflict = F.coalesce((F.col("raw_tax_id") != "") & (F.col("canonical_tax_id") != ""), F.lit(False))
    similarity = F.get("scores", sum((c.cast("int") for c in same), F.lit(0)) * 2 + conflict.cast("int"))
    found = met.select("raw_id", "canonical_id", similarity.alias("similarity"), F.col("raw_autos").alias("autos"))
    # A raw row with several automatic hits has all its candidates sent to review.
    named = tier(F.col("similarity"))
    return found.where(named.isNotNull()).select("raw_id", "canonical_id", "similarity", F.when(F.col("autos") > 1, "human_review").otherwise(named).alias("tier"))
