"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities of a lexicon learned from the training labels (whole words and word beginnings), how near its hits
stand to second-person words, shares of capitals and punctuation, and rates of obfuscated words. Labels enter only through
training rows; lang, source and doc_id are never features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import free, mark, remainder, share, small_batches, sweep, text_of, written

#: Lexicon and trees are fitted on about so many labelled rows at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 12_000
LEXICON_WORDS, THRESHOLD = 600, 0.3
TREES, DEPTH = 12, 3
#: A lexicon entry stands in at least so many toxic rows, and this much more often in toxic rows than in others.
LEAST_ROWS, LEAST_RATIO = 4, 8.0
#: Calibration is learned from rows scored by a model that has not seen them, over so many folds of the sample, whatever its size.
FOLDS = 3
# Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os".split())
#: Letters around signs, or four times one character. Letters are read from the first of them only, so a long run is read once.
_ODD = re.compile(r"(?<![^\W\d_])[^\W\d_]++[@$*!#0-9]++[^\W\d_]+|(\w)\1{3,}")
#: A 1 stands for an l or an i.
_PLAIN = (str.maketrans("013457@$!", "oleastasi"), str.maketrans("013457@$!", "oieastasi"))
_SPACED = re.compile(r"\b(?:\w ){3,}\w\b")
_STEMS = (4, 5, 6)
#: What a character is: [^\W\d_], \w, one of _SIGNS, upper case.
_LETTER, _WORDLY, _SIGN, _UPPER, _SIGNS = 1, 2, 4, 8, "@$*!#0123456789"
NAMES = ("words_hit", "stems_hit", "word_density", "stem_density", "hidden_density", "near_you", "you_density", "capitals", "all_caps", "marks", "exclaim", "odd_words", "mean_word", "log_words")


@dataclass
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]

    def holds(self, word: str) -> bool:
        return word in self.words or self.begins(word)

    def begins(self, word: str) -> bool:
        four, five, six = _STEMS
        return len(word) >= four and (word[:four] in self.stems or word[:five] in self.stems or word[:six] in self.stems)


class Kinds:
    """What each word is to a lexicon: 1 in it, 2 begins like one of it, 4 second person. Nothing is remembered of words that come, as most are rare."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.listed = {w: (w in lexicon.words) + 4 * (w in SECOND_PERSON) for w in lexicon.words | SECOND_PERSON}
        self.heads = {stem[: _STEMS[0]] for stem in lexicon.stems}

    def of(self, words: list[str]) -> bytes:
        listed, heads, head, begins = self.listed.get, self.heads, _STEMS[0], self.lexicon.begins
        return bytes([listed(w, 0) + 2 * begins(w) if w[:head] in heads else listed(w, 0) for w in words])


@cache
def characters() -> np.ndarray:
    """What each code point is, made once in a worker."""
    every = "".join(map(chr, range(0x110000)))
    of = lambda test: np.fromiter(map(test, every), bool, len(every))
    wordly, decimal = of(str.isalnum), of(str.isdecimal)
    kinds = (wordly & ~decimal).astype(np.uint8) * _LETTER + wordly.astype(np.uint8) * _WORDLY + of(str.isupper).astype(np.uint8) * _UPPER
    kinds[[ord(c) for c in _SIGNS]] += _SIGN
    kinds[ord("_")] += _WORDLY
    return kinds


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and end."""
    turns = np.flatnonzero(np.concatenate([[False], flags]) != np.concatenate([flags, [False]]))
    return turns[::2], turns[1::2]


def _odd(low: str, points: np.ndarray, letter: np.ndarray, wordly: np.ndarray, sign: np.ndarray) -> list[str]:
    """All matches of _ODD. One lies within a run of word characters and signs, and has signs between letters or four characters alike; only such runs are matched."""
    begin, end = _edges(sign)
    between = begin[(begin > 0) & (end < len(low)) & letter[begin - 1] & letter[end % len(low)]] if len(begin) else begin
    same = points[1:] == points[:-1]
    alike = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & wordly[:-3])
    if not len(between) and not len(alike):
        return []
    begin, end = _edges(wordly | sign)
    runs = np.unique(np.searchsorted(begin, np.concatenate([between, alike]), "right") - 1)
    return [m.group() for a, b in zip(begin[runs].tolist(), end[runs].tolist(), strict=True) for m in _ODD.finditer(low[a:b])]


def _spaced(low: str, points: np.ndarray, wordly: np.ndarray) -> list[str]:
    """All matches of _SPACED, which are looked for where four words of one character follow each other."""
    around = np.concatenate([[False], wordly, [False]])
    lone = wordly & ~around[:-2] & ~around[2:]
    pair = lone[:-2] & lone[2:] & (points[1:-1] == ord(" "))
    return [m.group() for m in _SPACED.finditer(low)] if (pair[:-4] & pair[2:-2] & pair[4:]).any() else []


def dense(text: str, kinds: Kinds) -> list[float]:
    """The features of a whole text. Characters are classed by arrays; patterns see only the places that can match."""
    low, lexicon = text.lower(), kinds.lexicon
    points = _points(low)
    what = characters()[points]
    letter, wordly, sign = (what & k != 0 for k in (_LETTER, _WORDLY, _SIGN))
    words = np.where(letter, points, np.uint32(ord(" "))).tobytes().decode("utf-32-le").split()
    n = max(1, len(words))
    kind = kinds.of(words)
    count = [kind.count(k) for k in range(8)]
    whole, stems, you = sum(count[1::2]), count[2] + count[3] + count[6] + count[7], sum(count[4:])
    near = 0
    if you and (whole or stems):
        each = np.frombuffer(kind, np.uint8)
        hits, at = np.flatnonzero(each & 3), np.flatnonzero(each & 4)
        near = int(np.count_nonzero(np.searchsorted(hits, at + 5) > np.searchsorted(hits, at - 4)))
    odd = _odd(low, points, letter, wordly, sign)
    read = [{w.translate(t).strip("*#") for t in _PLAIN} for w in odd] + [{w.replace(" ", "")} for w in _spaced(low, points, wordly)]
    hidden = sum(any(map(lexicon.holds, ways)) for ways in read)
    chars = max(1, len(text))
    letters = max(1, int(np.count_nonzero(letter)))
    upper = int(np.count_nonzero(characters()[_points(text)] & _UPPER)) if text != low else 0
    loud = sum(len(w) > 2 for w in filter(str.isupper, text.split())) if upper else 0
    marks = chars - letters - text.count(" ")
    return [math.log1p(whole), math.log1p(stems), whole / n, stems / n, hidden / n, near / n, you / n, upper / chars, loud / n, marks / chars, text.count("!") / chars, len(odd) / n, letters / n, math.log1p(len(words))]


def feature_column(spark, lexicon: Lexicon, text: Column) -> Column:
    small_batches(spark)

    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kinds = Kinds(lexicon)
        for batch in texts:
            yield pd.Series([dense(t, kinds) for t in batch])

    return of(text)


def learn_lexicon(labelled: DataFrame, most: int = LEXICON_WORDS) -> Lexicon:
    """Words and word beginnings that toxic rows hold far more often than others; at most `most` of each, from (text, toxic)."""
    rows = labelled.select(F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(r"(\p{L}+)"))).alias("w"), "toxic")
    long = F.filter("w", lambda x: F.length(x) >= 4)
    stems = F.array_distinct(F.flatten(F.array(*(F.transform(long, lambda x, k=k: F.substring(x, 1, k)) for k in _STEMS))))
    kinds = F.array(F.transform("w", lambda x: F.struct(F.lit(True).alias("whole"), x.alias("unit"))), F.transform(stems, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))
    units = rows.select("toxic", F.explode(F.flatten(kinds)).alias("u")).groupBy("u.whole", "u.unit").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    sizes = labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, other = (float(x or 0) for x in sizes)
    if not toxic or not other:
        return Lexicon(frozenset(), frozenset())
    ratio = ((F.col("a") + 0.1) / (toxic + 1)) / ((F.col("b") + 0.5) / (other + 1))
    best = units.where((F.col("a") >= LEAST_ROWS) & (ratio >= LEAST_RATIO)).withColumn("score", F.col("a") * F.log(ratio))
    top = lambda whole: frozenset(r["unit"] for r in best.where(F.col("whole") == whole).orderBy(F.desc("score"), "unit").limit(most).collect())
    return Lexicon(top(True), top(False))


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    isotonic: IsotonicRegressionModel | None
    prior: float


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Scorer:
    """Learns from labelled rows; the caller leaves out what is held out.

    Lexicon and trees come from the whole sample. Calibration is cross-fitted: each fold is scored by a lexicon and trees
    of the other folds, and the isotonic curve is fitted to all those scores, alike for samples of any size.
    """
    begun = mark()
    try:
        return _fit(docs, labels, sample_rows, folds)
    finally:
        sweep(begun)  # what was written for fitting


def _fit(docs: DataFrame, labels: DataFrame, sample_rows: int, folds: int) -> Scorer:
    # One label per id: a contradiction counts as toxic.
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    n = known.count()
    few = F.broadcast(written(known.where(share(min(1.0, sample_rows / max(n, 1)), "doc_id")), "sampled_labels"))  # about sample_rows rows of distinct ids
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(few, "doc_id").dropDuplicates(["doc_id", "text"]), "labelled_sample")
    counted = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    prior = counted.get(1.0, 0) / total if total else 0.0
    lexicon = learn_lexicon(sample)
    trees = _trees(sample, lexicon)
    if trees is None:
        return Scorer(lexicon, None, None, prior)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds))
    unseen = []
    for k in range(folds):
        rest = sample.where(fold != k)
        own = learn_lexicon(rest)
        model = _trees(rest, own)
        if model is not None:
            scored = model.transform(_features(sample.where(fold == k), own)).select("toxic", _margin().alias("margin"))
            unseen.append(written(scored, "unseen_scores"))
    if not unseen:  # no two folds hold both labels
        unseen = [trees.transform(_features(sample, lexicon)).select("toxic", _margin().alias("margin"))]
    raw = reduce(DataFrame.unionByName, unseen)
    return Scorer(lexicon, trees, IsotonicRegression(labelCol="toxic", featuresCol="margin").fit(raw.coalesce(4)), prior)


def _features(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    return sample.select("doc_id", "toxic", array_to_vector(feature_column(sample.sparkSession, lexicon, F.col("text"))).alias("features"))


def _trees(sample: DataFrame, lexicon: Lexicon) -> GBTClassificationModel | None:
    """Trees on the sample's features; None unless both labels are there."""
    rows = written(sample.select("doc_id", "toxic", feature_column(sample.sparkSession, lexicon, F.col("text")).alias("f")), "labelled_features")
    if rows.select("toxic").distinct().count() < 2:
        return None
    learn = rows.select("toxic", array_to_vector("f").alias("features")).coalesce(4)
    return GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, maxBins=32).fit(learn)


def _margin() -> Column:
    return F.element_at(vector_to_array("probability"), 2)


def score(docs: DataFrame, scorer: Scorer, name: str = "__score") -> DataFrame:
    """docs with all its columns and one more, `name`, which it must not have: 0 to 1. Without trained trees every row gets the share of toxic labels."""
    if scorer.trees is None:
        return docs.withColumn(name, F.lit(scorer.prior))
    made = free(docs, "__features", "__raw", "__p", "__y", "__margin")
    rows = docs.withColumn(made[0], array_to_vector(feature_column(docs.sparkSession, scorer.lexicon, text_of())))
    trees = scorer.trees.copy().setFeaturesCol(made[0]).setRawPredictionCol(made[1]).setProbabilityCol(made[2]).setPredictionCol(made[3])
    scored = trees.transform(rows).withColumn(made[4], F.element_at(vector_to_array(made[2]), 2))
    # The curve is applied by the model itself: a second Python function would give each task a second Python worker.
    return scorer.isotonic.copy().setFeaturesCol(made[4]).setPredictionCol(name).transform(scored).drop(*made)


def assess(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Null text is empty and scored like any other; ids without labels are scored too; repeated rows are each scored; without labels every score is 0; an empty table gives no rows; columns but doc_id and text are not read."""
    scorer = fit(docs, labels.where(remainder("doc_id", folds) != held_out), sample_rows)
    rows = score(docs.select(F.col("doc_id").cast("long"), "text"), scorer)
    return rows.select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The documents below the threshold, with all their columns, whatever their names. Null texts are scored as empty, repeated rows alike; an empty table stays empty, and without labels nothing goes."""
    scorer = fit(docs, labels.where(remainder("doc_id", folds) != held_out))
    (name,) = free(docs, "__score")
    return score(docs, scorer, name).where(F.col(name) < threshold).select(*docs.columns)
