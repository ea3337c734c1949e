"""Near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

64-bit fingerprints of two such sets differ in ten bits on average and seldom in more than eighteen; compared are those
within RADIUS = 26 bits, on vertical bit planes as in `simhash`, and what is left is confirmed by exact comparison of the
sets. For so wide a radius pigeonhole leaves blocks of two bits, which would put all documents together, so documents meet
for that comparison over BANDS keys, each made of ROWS minima of the shingles under different hashes: two texts of
similarity 0.8 share none with a chance of (1 - 0.8**6)**30 = 0.0001. Documents are linked to the first one of a key only,
so keys cost no pairs. What is linked meets in one task; in a large group, first a few of its members and then, by tiles,
what these have not brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vestigraph.llm.common import free, small_batches, small_or_shuffled, text_of, written
from vestigraph.llm.simhash import _LOWER, _planes, components, near_at_lag

SHINGLE, SEED, BANDS, ROWS, RADIUS = 5, 42, 30, 6, 26
#: Similarity that makes a copy, as a fraction.
NUM, DEN = 4, 5
#: Documents of one linked group that are compared at once; larger groups are cut into tiles, and each two tiles meet.
TILE = 128
#: Members of a larger group that all others meet first, members that meet them in one task, and how often that is done.
REPRESENTATIVES, PART, ROUNDS = 16, 1024, 2
#: Rows, and bytes of their sets, from which groups are compared together.
GROUPED, _GROUPED_BYTES = 1024, 32 << 20
_CHUNK = 1 << 12
_random = np.random.default_rng(SEED)
_PLACE = _random.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
_FLIP = _random.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _random.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_MIX = _random.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 2**64, BANDS, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """The set of the text's five-word shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n, width = max(1, len(h) - SHINGLE + 1), min(SHINGLE, len(h))
    if not width:
        return h
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles; none of the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    low, least = (found >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(low), _CHUNK):
        part = ((low[at : at + _CHUNK] ^ _FLIP) * _TIMES).min(1)
        least = part if least is None else np.minimum(least, part)
    return _mixed((_mixed(least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _MIX).sum(1, dtype=np.uint64) ^ _BAND).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def fingerprint(found: np.ndarray) -> int:
    """A bit is set if it is set in over half of the set's hashes; 0 for the empty set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), _CHUNK):
        counts += np.unpackbits(found[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<i8")[0])


def forest(group: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], tile: list[int], across: list[bool]) -> list[tuple[int, int]]:
    """A spanning forest of the links inside each group, whose rows stand together; across: between sets of different tiles only.

    Pairs within the radius are found lag by lag on bit planes, all groups at once, and confirmed by their sets.
    """
    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")  # large groups first, so that a lag needs a leading part only
    rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in order])
    planes, own, reach = _planes(fps[rows]), group[rows], np.cumsum(sizes[order])
    part, cross = np.array(tile)[rows], np.array(across)[rows]
    component, left, out = np.arange(n), n - len(sizes), []
    for lag in range(1, int(sizes.max())):
        if not left:  # every group hangs together
            break
        m = int(reach[int(np.searchsorted(-sizes[order], -lag, "left")) - 1])
        a, b = slice(0, m - lag), slice(lag, m)
        # Pairs that hang together already need no comparison, so a group of copies is soon done.
        open_ = (own[a] == own[b]) & (component[a] != component[b]) & ~(cross[a] & (part[a] == part[b]))
        if not open_.any():
            continue
        valid = np.zeros(-(-m // 64) * 64, np.uint8)
        valid[: m - lag] = open_
        for k in near_at_lag(planes, lag, np.packbits(valid, bitorder="little").view("<u8"), RADIUS).tolist():
            x, y = component[k], component[k + lag]
            if x == y:
                continue
            i, j = int(rows[k]), int(rows[k + lag])
            less, more = sorted((len(sets[i]), len(sets[j])))
            if DEN * less >= NUM * more and alike(sets[i], sets[j]):
                component[component == y] = x
                left -= 1
                out.append((i, j))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, same (digest of the set of shingles) and keys. Null text has no words."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found = [shingles(t) for t in b.column(1).to_pylist()]
            same = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array([keys(s) for s in found], pa.list_(pa.int64()))], names=["doc_id", "same", "keys"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(scan, "doc_id long, same binary, keys array<long>")


def with_sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (id and other columns) with each document's set of shingles as bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(small_or_shuffled(placed), "id").select(*placed.columns, "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield b.drop_columns(["text"]).append_column("hashes", sets)

    return texts.mapInArrow(scan, T.StructType([*placed.schema.fields, T.StructField("hashes", T.BinaryType())]))


def _met_representatives(docs: DataFrame, members: DataFrame, nr: int) -> DataFrame:
    """Edges (a, b) between some members of each group and all others that are their copies.

    members: id, root, rest, n and r (the group's members, and how many of them are rest). About REPRESENTATIVES of the
    rest, drawn by a hash, go to each part of their group and all members stream by, so a set is sent once and these few
    once for each PART of members.
    """
    drawn = F.col("rest") & (F.pmod(F.xxhash64("id", F.lit(nr)), F.ceil(F.col("r") / REPRESENTATIVES)) == 0)
    parts = F.ceil(F.col("n") / PART).cast("int")
    rows = with_sets(docs, members.select("id", "root", drawn.alias("drawn"), parts.alias("parts")))
    own = F.struct(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("order"))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("part"), F.lit(0).alias("order")))
    sent = rows.select("root", "id", "hashes", F.explode(F.when(F.col("drawn"), F.concat(every, F.array(own))).otherwise(F.array(own))).alias("to")).select("root", "to.part", "to.order", "id", "hashes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, drawn = None, []
        for b in batches:
            out = []
            for root, part, order, doc, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, part) != at:
                    at, drawn = (root, part), []
                found = np.frombuffer(hashes, np.uint64)
                mark = fingerprint(found) & (2**64 - 1)
                if not order:
                    drawn.append((doc, mark, found))
                    continue
                for other, its, theirs in drawn:
                    less, more = sorted((len(found), len(theirs)))
                    if other != doc and (mark ^ its).bit_count() <= RADIUS and DEN * less >= NUM * more and alike(found, theirs):
                        out.append((other, doc))
            cols = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return sent.repartition("root", "part").sortWithinPartitions("root", "part", "order").mapInArrow(meet, "a long, b long")


def _counted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """id, root, rest, n, r: rest are the members outside the group's largest component, all of them while none is known. Groups that hang together are left out."""
    if roots is None:
        sizes = members.groupBy("root").agg(F.count("*").alias("n"))
        return members.select("id", "root").join(small_or_shuffled(sizes, 32), "root").select("id", "root", F.lit(True).alias("rest"), "n", F.col("n").alias("r"))
    of = members.select("id", "root").join(roots.withColumnRenamed("root", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    parts = of.groupBy("root", "c").agg(F.count("*").alias("k"))
    groups = parts.groupBy("root").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("n"))
    return of.join(small_or_shuffled(groups.where("most < n"), 64), "root").select("id", "root", (F.col("c") != F.col("main")).alias("rest"), "n", (F.col("n") - F.col("most")).alias("r"))


def confirmed(docs: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) inside groups (id, root) of candidates whose components are those of the pairs that are copies indeed.

    Members of a large group first meet a few of them, which mostly leaves one large component. Then only pairs with at
    least one end outside it can tell more: tiles of the rest meet one another and the tiles of that component. Groups of
    up to `tile` members are a tile of their own.
    """
    counted = written(_counted(groups, None), "candidates")
    small, large, edges = counted.where(F.col("n") <= tile), counted.where(F.col("n") > tile), None
    for nr in range(ROUNDS):
        if large.where(F.col("r") > tile).isEmpty():
            break
        found = written(_met_representatives(docs, large, nr).distinct(), "met")
        edges = found if edges is None else edges.unionByName(found)
        large = written(_counted(large, components(edges)), "candidates")
    left = small.unionByName(large)
    tiles, others = F.ceil(F.col("r") / tile).cast("int"), F.ceil((F.col("n") - F.col("r")) / tile).cast("int")
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), tiles)).otherwise(-1 - F.pmod(F.xxhash64("id"), others)).cast("int")
    rows = with_sets(docs, left.select("id", "root", own.alias("own"), tiles.alias("tiles"), others.alias("others")))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    across = F.when(F.col("others") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("others"), F.lit(1))), lambda k: -k)).otherwise(F.array().cast("array<int>"))
    met = F.when(F.col("own") >= 0, F.concat(every, across)).otherwise(every)
    rows = rows.select("root", "id", "own", "hashes", F.explode(met).alias("other"))
    rows = rows.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "own", "hashes")
    rows = rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place, nr = None, 0

        def flush() -> pa.RecordBatch:
            groups, ids, tiles, across, sets = zip(*held, strict=True)
            fps = np.array([fingerprint(s) for s in sets], np.int64)
            pairs = forest(np.array(groups), fps, list(sets), list(tiles), list(across))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], names=["a", "b"])

        size = 0
        for b in batches:
            for root, x, y, doc, own, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, x, y) != place:
                    if len(held) >= GROUPED or size >= _GROUPED_BYTES:  # whole groups only
                        yield flush()
                        size = 0
                    place, nr = (root, x, y), nr + 1
                held.append((nr, doc, own, x != y, np.frombuffer(hashes, np.uint64)))
                size += len(hashes)
        if held:
            yield flush()

    last = rows.mapInArrow(compare, "a long, b long")
    return last if edges is None else last.unionByName(edges)


def one_of_each(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The document with the smallest doc_id of each component of copies, with all columns; rows that repeat that doc_id stay too.

    Texts with equal sets are copies, also those without words and null ones. A row without doc_id stays; an empty table
    stays empty; columns may have any names.
    """
    marked = written(signed(docs), "shingles")
    distinct = written(marked.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")).where("id is not null"), "distinct_sets")
    keyed = distinct.select("id", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("b"))
    linked = components(keyed.join(first, "key").select(F.col("id").alias("a"), "b").where("a != b"))
    groups = written(linked.unionByName(linked.select(F.col("root").alias("id"), "root").distinct()), "groups")
    roots = components(confirmed(docs, groups, tile))
    of = distinct.join(roots, "id", "left").select("same", F.coalesce("root", "id").alias("component_id"))
    (name,) = free(docs, "__gone")
    gone = marked.join(of, "same").where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = small_or_shuffled(written(gone, "near_copies"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
