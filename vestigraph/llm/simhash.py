"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared on vertical bit planes.

Fingerprints that differ in at most RADIUS = 2 bits agree in at least two of four 16-bit blocks, so equal fingerprints are
first made one, then dealt to six buckets of 32 agreeing bits. In a bucket the XOR of many pairs is counted at once with
carry-save adders over bit planes, and a block of pairs is left as soon as all of them exceed the radius. A bucket sends
on a spanning forest of its links, never all pairs; components follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import mark, small_batches, small_or_shuffled, sweep, text_of, written

SHINGLE, RADIUS, SEED, BLOCKS = 3, 2, 42, 4
#: Fingerprints of one bucket that are compared at once; larger buckets are cut into tiles, and each two tiles meet.
TILE = 1024
#: Documents of one fingerprint from which it is sent to them, and not they to it.
HOT = 1000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        a, b = starts[at : min(at + _CHUNK, n)].tolist(), ends[at + last : min(at + _CHUNK, n) + last].tolist()
        h = np.array([digest(joined[x:y], seed) for x, y in zip(a, b, strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long. Null text has no words."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(scan, "doc_id long, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of a block of fingerprints, packed into words of 64 lanes, with one spare word."""
    bits = np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    lanes = -(-bits.shape[1] // 64) * 64 + 64
    padded = np.zeros((64, lanes), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def close_at_lag(planes: np.ndarray, lag: int, valid: np.ndarray) -> np.ndarray:
    """Lanes i in which fingerprints i and i + lag differ in at most two bits. valid: packed lanes that count.

    ones and twos hold a two-bit count for each lane; `over` stays set once three bits differ. Planes go in threes through a full adder. A block of 64 lanes is left as soon as all of them are over.
    """
    q, r = divmod(lag, 64)
    alive = np.flatnonzero(valid)
    over, last = ~valid[alive], planes.shape[1] - 1
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for p in range(0, 64, 3):
        if not len(alive):
            break
        low, high, x = np.minimum(alive + q, last), np.minimum(alive + q + 1, last), []
        for plane in planes[p : p + 3]:
            far = (plane[low] >> np.uint64(r)) | (plane[high] << np.uint64(64 - r)) if r else plane[low]
            x.append(plane[alive] ^ far)
        if len(x) == 3:
            half = x[0] ^ x[1]
            total, carry = half ^ x[2], (x[0] & x[1]) | (half & x[2])
        else:
            total, carry = x[0], np.zeros_like(over)
        up = ones & total
        ones ^= total
        over |= (twos & up) | (twos & carry) | (up & carry)  # two or more twos: four differ
        twos ^= up ^ carry
        over |= ones & twos
        if p % 6 == 3:
            keep = over != _ALL
            alive, over, ones, twos = alive[keep], over[keep], ones[keep], twos[keep]
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(lanes)
    return alive[block] * 64 + lane


def near_at_lag(planes: np.ndarray, lag: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """close_at_lag for any radius: a counter of as many planes as the radius needs, fed by full adders; what overflows it or exceeds the radius is over, and blocks of 64 lanes that are over are left."""
    q, r = divmod(lag, 64)
    alive = np.flatnonzero(valid)
    over, last = ~valid[alive], planes.shape[1] - 1
    count = [np.zeros_like(over) for _ in range(radius.bit_length() + 1)]

    def add(level: int, x: np.ndarray) -> np.ndarray:
        for i in range(level, len(count)):
            count[i], x = count[i] ^ x, count[i] & x
        return x

    def exceeds() -> np.ndarray:
        more, equal = np.zeros_like(over), np.full_like(over, _ALL)
        for i in range(len(count) - 1, -1, -1):
            if radius >> i & 1:
                equal &= count[i]
            else:
                more |= equal & count[i]
                equal &= ~count[i]
        return more

    for p in range(0, 64, 3):
        if not len(alive):
            break
        low, high, x = np.minimum(alive + q, last), np.minimum(alive + q + 1, last), []
        for plane in planes[p : p + 3]:
            far = (plane[low] >> np.uint64(r)) | (plane[high] << np.uint64(64 - r)) if r else plane[low]
            x.append(plane[alive] ^ far)
        half = x[0] ^ x[1] if len(x) == 3 else x[0]
        over |= add(0, half ^ x[2] if len(x) == 3 else half)
        if len(x) == 3:
            over |= add(1, (x[0] & x[1]) | (half & x[2]))
        if p % 12 == 9 or p == 63:
            over |= exceeds()
            keep = over != _ALL
            alive, over = alive[keep], over[keep]
            count = [c[keep] for c in count]
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(lanes)
    return alive[block] * 64 + lane


def forest(group: np.ndarray, values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group; rows of a group stand together."""
    n = len(values)
    if n < 2:
        return ids[:0], ids[:0]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out_a, out_b = [], []
    order = np.argsort(-sizes, kind="stable")  # large groups first, so that a lag needs a leading part only
    rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in order])
    g2, v2 = group[rows], values[rows]
    planes = _planes(v2)
    reach = np.cumsum(sizes[order])
    for lag in range(1, int(sizes.max())):
        k = int(np.searchsorted(-sizes[order], -lag, "left"))  # groups of more than lag rows
        if not k:
            break
        m = int(reach[k - 1])
        same = np.zeros(-(-m // 64) * 64, np.uint8)
        same[: m - lag] = g2[: m - lag] == g2[lag:m]
        valid = np.packbits(same, bitorder="little").view("<u8")
        hit = close_at_lag(planes, lag, valid)
        if len(hit):
            a, b = rows[hit], rows[hit + lag]
            differ = root[a] != root[b]
            for x, y in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    out_a.append(x)
                    out_b.append(y)
            while (flat := root[root]).tobytes() != root.tobytes():
                root[:] = flat
    return ids[out_a], ids[out_b]


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between ids of distinct fingerprints (id, fp): for each bucket a spanning forest, so the components are those of all links."""
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1) for k in range(BLOCKS)]
    keys = [F.struct(F.lit(t).alias("t"), (F.shiftleft(block[i], width) + block[j]).alias("bits")) for t, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    dealt = distinct.select("id", "fp", F.explode(F.array(*keys)).alias("k")).select("id", "fp", "k.*")
    full = dealt.groupBy("t", "bits").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    rows = dealt.join(full, ["t", "bits"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.select("t", "bits", "id", "fp", "own", other.alias("other"))
    rows = rows.select("t", "bits", "id", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    place = ["t", "bits", "x", "y"]
    rows = rows.repartition(*place).sortWithinPartitions(*place, "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            key = np.stack([table.column(c).to_numpy() for c in place])
            group = np.cumsum(np.concatenate(([0], (key[:, 1:] != key[:, :-1]).any(0))))
            a, b = forest(group, table.column("fp").to_numpy(), table.column("id").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < 8 * tile:
                continue
            table = pa.Table.from_batches(held)
            key = np.stack([table.column(c).to_numpy() for c in place])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            if not len(edge):
                continue
            cut = int(edge[-1]) + 1
            yield flush(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
        if held:
            yield flush(pa.Table.from_batches(held))

    return rows.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches, by alternating star contraction in about log2 rounds, each a written table."""
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    last = mark()
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        now = mark()
        both = edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.*").where("u != v").distinct()
        edges = written(small, "stars")
        sweep(last, until=now)  # the round before
        last = now
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Null text has no words, and all documents without words are one component with what is within two bits of zero. Repeated rows link to each other. A null doc_id is no id: such a row gets the component of its fingerprint. Empty table: no rows. Columns but doc_id and text are not read.
    """
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).where("id is not null"), "distinct")
    roots = components(links(distinct.select("id", "fp"), tile))
    of = written(distinct.join(roots, "id", "left").select("fp", "n", F.coalesce("root", "id").alias("component_id")), "roots")
    # Fingerprints of very many documents are few, so they go to the documents; the rest meet them by shuffle, none of which is large.
    many = small_or_shuffled(of.where(F.col("n") > HOT).select("fp", "component_id"), 32)
    found = marked.join(many, "fp", "left")
    rest = found.where("component_id is null").drop("component_id").join(of.where(F.col("n") <= HOT).drop("n"), "fp", "left")
    rows = found.where("component_id is not null").unionByName(rest)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
