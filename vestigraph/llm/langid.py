"""Language identification by nearest centroids of TF-IDF character n-grams.

Letters-only text gives hashed 1-, 2- and 3-grams; vectors are damped counts times inverse document frequency, of length
one. Each language has a few centroids by spherical k-means; the nearest by cosine wins. A text further away than nearly
all training texts of that language and about its size is marked as rejected; its nearest language is still reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import mark, remainder, sampled, small_batches, sweep, text_of, written

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 8
#: The classifier is fitted on so many labelled rows at most, spread by a hash of the whole row; repeated rows count once.
SAMPLE_ROWS = 4000
#: A text is rejected if it is further from its nearest centroid than all but this share of the language's training texts of its size, and a margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.01, 0.85
#: Sizes of texts by their number of distinct n-grams; short texts are further from any centroid.
SIZES = (24, 64, 160, 400)
_CHUNK = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text, None without a letter."""
    out, letters = np.zeros(DIMENSIONS), _letters()
    found = False
    for at in range(0, len(text), _CHUNK):
        code = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters[code]
        if not is_letter.any():
            continue
        found = True
        code = np.where(is_letter, code, 32)
        code = np.concatenate(([32], code[is_letter | np.concatenate(([True], is_letter[:-1]))], [32])).astype(np.uint32)
        a = code * np.uint32(2654435761)
        b = (a[:-1] >> np.uint32(3)) ^ (code[1:] * np.uint32(2246822519))
        c = (b[:-1] >> np.uint32(5)) ^ (code[2:] * np.uint32(3266489917))
        for n, h in enumerate((a, b, c)):
            h = h * np.uint32(0x9E3779B1 + 2 * n)
            out += np.bincount(h >> np.uint32(20), minlength=DIMENSIONS)
    return out if found else None


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def sizes_of(damped: np.ndarray) -> np.ndarray:
    return np.searchsorted(SIZES, (damped > 0).sum(1), "right")


class Centroids:
    """least: for each language and size the cosine below which a text is rejected."""

    def __init__(self, idf: np.ndarray, langs: list[str], rows: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.rows, self.owner, self.least = idf, langs, rows, owner, least

    def predict(self, damped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, the cosine, and whether it is too far, for rows of log(1 + count). Of equal cosines the language that comes first by name wins, as its centroids stand first."""
        near = _unit(damped * self.idf) @ self.rows.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(near)), best], 0.0, 1.0)
        which = self.owner[best]
        return which, score, score < self.least[which, sizes_of(damped)]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Centroids | None:
    """Fits on at most sample_rows distinct rows of (doc_id, text, lang) with lang and a letter; None if there are none. Vectors of the sample, of 8 KB each, are all that reaches the driver."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang").where(F.rlike("text", F.lit(r"\p{L}")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(lang, np.log1p(v).astype(np.float16).tobytes()) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (v := counts(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())], names=["lang", "v"])

    begun = mark()
    chosen = written(sampled(rows.select(F.xxhash64("doc_id", "text", "lang").alias("h")), sample_rows, "h"), "sampled_rows")
    few = rows.withColumn("h", F.xxhash64("doc_id", "text", "lang")).join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # sample_rows numbers
    sample = few.select("text", "lang").repartition(8).mapInArrow(vectors, "lang string, v binary").collect()
    sweep(begun)
    if not sample:
        return None
    sample.sort(key=lambda r: (r[0], bytes(r[1])))
    damped = np.stack([np.frombuffer(r[1], np.float16) for r in sample]).astype(np.float32)
    names = sorted({r[0] for r in sample})
    label = np.array([names.index(r[0]) for r in sample])
    idf = (np.log((1 + len(damped)) / (1 + (damped > 0).sum(0))) + 1).astype(np.float32)
    unit, size = _unit(damped * idf), sizes_of(damped)
    rng, rows_, owner, least = np.random.default_rng(5), [], [], []
    for k in range(len(names)):
        own = unit[label == k]
        centers = own[rng.permutation(len(own))[: min(CENTROIDS, len(own))]]
        for _ in range(ROUNDS):
            at = (own @ centers.T).argmax(1)
            centers = np.stack([_unit(own[at == j].sum(0)) if (at == j).any() else centers[j] for j in range(len(centers))])
        rows_.append(centers)
        owner += [k] * len(centers)
        least.append(_limits((own @ centers.T).max(1), size[label == k]))
    return Centroids(idf, names, np.concatenate(rows_), np.array(owner), np.array(least))


def _limits(near: np.ndarray, size: np.ndarray, enough: int = 30) -> list[float]:
    """The limit for each size; a size of too few training texts borrows the one of the next larger with enough, or has none."""
    out, last = [], -1.0
    for s in range(len(SIZES), -1, -1):
        own = near[size == s]
        if len(own) >= enough:
            last = float(np.quantile(own, REJECT_QUANTILE)) * REJECT_MARGIN
            out.append(last)
        else:
            # Shorter texts are further away, so a larger size's limit would reject too many of them.
            out.append(last * (0.5 if last > 0 else 1))
    return out[::-1]


def predict(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, held_out by the caller's column if present, lang_pred, score, rejected. `und` and 0 for null texts and texts without a letter, or where nothing could be learned."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found = [counts(t) if m else None for t in b.column(2).to_pylist()]
            has = [i for i, v in enumerate(found) if v is not None]
            langs, scores, far = ["und"] * b.num_rows, [0.0] * b.num_rows, [True] * b.num_rows
            if has:
                which, near, rejected = m.predict(np.log1p(np.stack([found[i] for i in has])).astype(np.float16).astype(np.float32))
                for i, k, s, r in zip(has, which.tolist(), near.tolist(), rejected.tolist(), strict=True):
                    langs[i], scores[i], far[i] = m.langs[k], s, r
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", text_of().alias("text")).mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learns from the folds that aren't held out and predicts every row. lang, source and doc_id are never inputs of a prediction.

    Null texts and those without a letter are `und` with score 0, null languages are not learned from, repeated rows count once
    for learning and are each predicted, equal scores go to the first language by name, an empty table gives no rows. Columns
    but doc_id, text and lang are not read.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).withColumn("held_out", remainder("doc_id", folds) == held_out)
    return predict(rows, fit(rows.where("not held_out"), sample_rows))
