"""A Merkle manifest of a table: a tree of digests for each group, and one over the groups' roots.

Ranks within a group come from histograms of the id's digits, level by level: what stands before a row is the sum, over
the levels, of the rows that share its longer digits and have a smaller next one. Every window is one parent's children,
at most 16,384 rows, so neither a hot group nor the table is ever sorted as a whole. Rank digits in the base of the
fan-out are then the keys of a trie; the nodes with the longest keys are reduced first, two digits in one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.llm.common import remainder, written

FANOUT = 16
#: Bits of the id's digits from the highest on; together the 64 bits of a long.
ID_DIGITS = (14, 14, 14, 12, 10)
#: Hex characters of the row's digest that follow as a last digit: rows that share an id are ranked by digest.
DIGEST_DIGIT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_COPIES = 1024


def field(value: Column) -> Column:
    """A value as it goes into a leaf: `-` for null, else its UTF-8 bytes' number, a colon and the value; so no two rows read alike."""
    as_text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _upper_to_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "source", id: str = "doc_id", value: str = "text") -> DataFrame:
    """grp, doc_id, leaf, told. `told` is the leaf as someone else would report it: with `changed` in place of `value` where `tampered` holds, else the leaf itself."""
    of = {c: field(F.col(c)) for c in columns}
    leaf = digest(*of.values())
    told = leaf if tampered is None else F.when(tampered, digest(*(of | {value: field(changed)}).values())).otherwise(leaf)
    grp = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))  # null first, then by bytes
    return docs.select(grp.alias("grp"), F.col(id).cast("long").alias("doc_id"), leaf.alias("leaf"), told.alias("told"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank` within grp, from 0 by doc_id (null first) and then leaf, and `m`, the rows of grp.

    Equal rows are counted before the shuffle and take neighbouring ranks.
    """
    keys = ["grp", "doc_id", "leaf", "told"]
    flipped, left, digits = F.col("doc_id").bitwiseXOR(F.lit(-(2**63))), 64, []
    for bits in ID_DIGITS:
        left -= bits
        digits.append(F.coalesce(F.shiftrightunsigned(flipped, left).bitwiseAND(F.lit(2**bits - 1)), F.lit(-1)).cast("int"))
    digits.append(F.conv(F.substring("leaf", 1, DIGEST_DIGIT), 16, 10).cast("int"))
    names = [f"d{i}" for i in range(len(digits))]
    once = written(rows.groupBy(*keys).agg(F.count("*").alias("copies")).withColumns(dict(zip(names, digits, strict=True))), "leaves")

    counts = [once.groupBy("grp", *names).agg(F.sum("copies").alias("n"))]  # of each digit string, the longest first
    for depth in range(len(names) - 1, 0, -1):
        counts.append(counts[-1].groupBy("grp", *names[:depth]).agg(F.sum("n").alias("n")))
    before = None
    for depth, count in enumerate(reversed(counts), start=1):
        parent, digit = ["grp", *names[: depth - 1]], names[depth - 1]
        smaller = Window.partitionBy(*parent).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        here = count.withColumn("lead", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
        if before is None:
            before = here.withColumn("m", F.sum("n").over(Window.partitionBy("grp"))).select(*parent, digit, F.col("lead").alias("base"), "m")
        else:
            before = here.join(before, parent).select(*parent, digit, (F.col("base") + F.col("lead")).alias("base"), "m")

    bucket = Window.partitionBy("grp", *names).orderBy("doc_id", "leaf", "told").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("copies").over(bucket), F.lit(0))
    placed = once.join(before, ["grp", *names]).select(*keys, "copies", "m", first.alias("first"))
    lots = placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_COPIES}"))))
    within = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(_COPIES - 1).cast("long"), F.col("copies") - F.col("lot") * _COPIES - 1)))
    return lots.withColumn("nth", within).select(*keys, (F.col("first") + F.col("lot") * _COPIES + F.col("nth")).alias("rank"), "m")


def in_order(names: DataFrame, by: str) -> DataFrame:
    """Distinct rows with `rank` by one column, null first and bytewise: ranges are sorted apart and offset by their counts."""
    sorted_rows = written(names.orderBy(F.col(by).asc_nulls_first()).withColumn("at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftrightunsigned("at", 33)
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # as many rows as ranges
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", base.alias("base"))
    return sorted_rows.withColumn("part", part).join(counts, "part").withColumn("rank", F.col("base") + F.col("at").bitwiseAND(F.lit(2**33 - 1))).drop("part", "base", "at")


def _run(hashes: Column, i: Column, fanout: int) -> Column:
    return F.slice(hashes, (F.floor(i / fanout) * fanout + 1).cast("int"), fanout)


def _parents(hashes: Column, fanout: int) -> Column:
    each = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / fanout).cast("int"))
    return F.transform(each, lambda i: digest(F.array_join(F.slice(hashes, i * fanout + 1, fanout), "")))


def _split(hashes: Column, i: Column, fanout: int) -> Column:
    """What stands left and right of node i in its run."""
    run, at = _run(hashes, i, fanout), (i % fanout).cast("int")
    return F.struct(F.array_join(F.slice(run, 1, at), "").alias("left"), F.array_join(F.slice(run, at + 2, fanout), "").alias("right"))


@dataclass(frozen=True)
class Trie:
    """blocks: for each lot of fan-out squared neighbouring nodes their rows and hashes, the hashes one level up (null if there is no such level) and the one above. tops: grp and the hash that remains."""

    blocks: list[DataFrame]
    tops: DataFrame
    fanout: int


def reduce_by_prefix(nodes: DataFrame, fanout: int = FANOUT) -> Trie:
    """nodes: grp, rank, m (nodes of grp), hash, and what else is to be kept at the leaves. A step drops the two last digits of the rank; a grp that has one node left waits."""
    lot, blocks, most = fanout * fanout, [], None
    while True:
        kept = [c for c in nodes.columns if c not in ("grp", "m")]
        grouped = nodes.groupBy("grp", "m", F.expr(f"rank div {lot}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in kept if c != "rank")))).alias("nodes"))
        grouped = grouped.withColumn("hashes", F.col("nodes.hash"))
        grouped = grouped.withColumn("mids", F.when(F.col("m") > 1, _parents(F.col("hashes"), fanout)))
        top = F.when(F.col("m") == 1, F.col("hashes")[0]).when(F.col("m") <= fanout, F.col("mids")[0]).otherwise(_parents(F.col("mids"), fanout)[0])
        blocks.append(written(grouped.withColumn("top", top), "trie"))
        most = most or blocks[0].agg(F.max("m")).first()[0] or 1  # one number tells how many steps there are
        nodes = blocks[-1].select("grp", F.col("block").alias("rank"), F.ceil(F.col("m") / lot).alias("m"), F.col("top").alias("hash"))
        most = -(-most // lot)
        if most == 1:
            return Trie(blocks, nodes.select("grp", "hash"), fanout)


def paths(trie: Trie, above: DataFrame) -> DataFrame:
    """The lowest nodes' rows with `path`: what stands left and right of them at each level, up to the last. above: grp, the path from its top on, and what is to be handed down."""
    down = [c for c in above.columns if c not in ("grp", "path")]
    upper = above.select("grp", F.lit(0).cast("long").alias("block"), F.col("path").alias("rest"), *down)
    none, i = F.array().cast("array<struct<left:string,right:string>>"), F.col("i")
    for blocks in reversed(trie.blocks):
        near = F.when(F.col("m") > 1, F.array(_split(F.col("hashes"), i, trie.fanout))).otherwise(none)
        far = F.when(F.col("m") > trie.fanout, F.array(_split(F.col("mids"), F.floor(i / trie.fanout), trie.fanout))).otherwise(none)
        spread = blocks.join(upper, ["grp", "block"]).select("*", F.posexplode("nodes").alias("i", "node"))
        spread = spread.select("grp", "node.*", F.concat(near, far, "rest").alias("path"), *down)
        upper = spread.select("grp", F.col("rank").alias("block"), F.col("path").alias("rest"), *down)
    return spread


def proof(path: Column) -> Column:
    """The siblings in one string: level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda acc, p: digest(p["left"], acc, p["right"]))


@dataclass(frozen=True)
class Manifest:
    """groups: a tree for each grp; subroots: grp, hash, rank; roots: the tree over them; root: null for an empty table."""

    groups: Trie
    subroots: DataFrame
    roots: Trie
    root: str | None

    def proofs(self) -> DataFrame:
        """doc_id, leaf, told, subroot and path (left and right of it, level by level) of each row."""
        across = paths(self.roots, self.roots.tops.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path")))
        lower = paths(self.groups, across.select(F.col("of").alias("grp"), "path", F.col("hash").alias("subroot")))
        return lower.select("doc_id", F.col("hash").alias("leaf"), "told", "subroot", "path")


def manifest(rows: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The trees over rows as `leaves` gives them."""
    groups = reduce_by_prefix(ranked(rows).withColumnRenamed("leaf", "hash"), fanout)
    subroots = in_order(groups.tops, "grp")
    roots = reduce_by_prefix(subroots.select(F.lit("").alias("grp"), "rank", F.lit(subroots.count()).alias("m"), "hash", F.col("grp").alias("of")), fanout)
    top = roots.tops.first()
    return Manifest(groups, subroots, roots, top and top["hash"])


def audit(docs: DataFrame) -> DataFrame:
    """The manifest's answer for each document, where the texts of a fifth of the ids come back with A to Z in lower case.

    doc_id, leaf, subroot, root, proof_sha256 as made; folded_root is what the leaf that came back and the siblings give, and
    `verified` says whether that is the root. Nulls: `-` in the leaf; a null source is a group of its own, the first; null ids
    come first in their group, and count as the empty string where ids are drawn. Rows that share an id stand by digest, so
    repeated rows have neighbouring places and a proof each. Empty texts are fields of length 0. An empty table gives no rows.
    Columns but the leaf's five are not read.
    """
    made = manifest(leaves(docs, remainder("doc_id", 5) == 0, _upper_to_lower(F.col("text"))))
    root = F.lit(made.root).cast("string")
    proved = made.proofs().withColumn("folded_root", folded(F.col("told"), F.col("path")))
    return proved.select("doc_id", "leaf", "subroot", root.alias("root"), digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
