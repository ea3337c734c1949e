"""Token counts of whole texts, where huge texts are encoded as overlapping chunks in many tasks.

Two chunks that overlap are spliced at a boundary that both of them show and that is proven to stand in the whole text's
encoding as well:

- between parts. Words are cut by one pattern that is matched from left to right and looks at nothing behind it, so once
  both chunks begin a part at a place, all that follows is the same. What is near a chunk's end doesn't count, as the
  pattern and special strings look a few characters ahead.
- inside a part that is longer than the overlap. A sequence of tokens is what byte pair merges give if and only if each two
  neighbours are what their own text gives. So if both chunks have the same two neighbouring tokens at one place, the left
  one's tokens up to there and the right one's from there on are neighbours that have all been seen together. This needs
  a vocabulary whose tokens, encoded alone, are themselves (`packing.ranks_of` proves that).

Where no such boundary is found, the document is cut again with chunks and overlaps that are eight times as wide, in the
end as one chunk.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import small_batches, small_or_shuffled, text_of, written
from vestigraph.llm.packing import encoder_of, ranks_of, tokenizer_path

LIMIT = 2048
#: Characters of a chunk, and how far it reaches back into the one before.
CHUNK, OVERLAP, WIDER = 32_768, 512, 8
#: No boundary counts so near the end of a chunk; longer than any special string or what the cutting pattern looks ahead.
MARGIN = 32
_EDGE = "array<struct<at:long,n:long,part:boolean,one:int,two:int,from:long,upto:long>>"


@cache
def _joins_back() -> frozenset[str]:
    """Characters that normalisation may join to one before them: the second parts of compositions, and Hangul vowels and finals."""
    seconds = {chr(int(d[1], 16)) for c in range(0x110000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and not d[0].startswith("<")}
    return frozenset(seconds | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))))


def begins_anew(c: str) -> bool:
    """True if normalisation keeps what stands before c apart from c and what follows."""
    return c < "\x80" or not (unicodedata.combining(c) or c in _joins_back() or unicodedata.category(c) in ("Cn", "Cs"))


def cuts(text: str, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of chunks that together are the text. Starts are places where normalisation begins anew."""

    def anew(at: int, least: int) -> int:
        while at > least and not begins_anew(text[at]):
            at -= 1
        return at

    found, at = [], 0
    while at < len(text):
        end = len(text) if len(text) - at <= chunk + overlap else anew(at + chunk, at)
        if end == at:  # nothing begins anew in a whole chunk
            end = next((i for i in range(at + chunk, len(text)) if begins_anew(text[i])), len(text))
        found.append((anew(max(0, at - overlap), 0) if at else 0, at, end))
        at = end
    return found


def edge(encoding, base: int, low: int, high: int) -> list[tuple]:
    """The boundaries of an encoding whose place in the text lies in [low, high]: place, tokens before it, whether a part begins there, the tokens on both sides and where these begin and end."""
    offsets, ids, words = encoding.offsets, encoding.ids, encoding.word_ids
    found = []
    for i in range(1, len(ids)):
        at = offsets[i][0] + base
        if low <= at <= high and offsets[i - 1][1] <= offsets[i][0]:
            part = words[i] is None or words[i] != words[i - 1]
            found.append((at, i, part, ids[i - 1], ids[i], offsets[i - 1][0] + base, offsets[i][1] + base))
    return found


def one_class(text: str) -> bool:
    """True for letters alone, or for neither letters nor digits nor white space: what the cutting pattern takes in one run."""
    return text.isalpha() or not any(c.isalnum() or c.isspace() or unicodedata.category(c)[0] == "N" for c in text)


def splice(left: list[dict], right: list[dict]) -> tuple[int, int] | None:
    """Tokens of the left chunk before the splice, and of the right one. Boundaries of parts come first, then pairs of equal tokens; the last one is taken, as far as can be from where the right chunk began."""
    of = {x["at"]: x for x in left}
    both = [(of[x["at"]], x) for x in right if x["at"] in of]
    parts = [(a["n"], b["n"]) for a, b in both if a["part"] and b["part"]]
    inside = [(a["n"], b["n"]) for a, b in both if not (a["part"] or b["part"]) and all(a[k] == b[k] for k in ("one", "two", "from", "upto"))]
    return (parts or inside or [None])[-1]


@cache
def tokenizer_at(path: str):
    """One for each worker, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def counter(path: str, ranks: dict[bytes, int] | None) -> Callable[[str], int]:
    """Counts the tokens of a text in one piece."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    if ranks is None:
        return lambda text: len(tokenizer_at(path).encode(text, add_special_tokens=False).ids)
    return lambda text: sum(map(len, encoder_of(path, ranks).encode(text))) // 4


def _plain_counts(rows: DataFrame, path: str, ranks) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, ranks and ranks.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(count, b.column(2).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "n_bytes", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """digest, k, last, base (the first character's place), start (where the overlap ends), text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                places = cuts(text, chunk, overlap)
                for i in range(0, len(places), 64):
                    rows = [(name, k, k == len(places) - 1, base, start, text[base:end]) for k, (base, start, end) in enumerate(places[i : i + 64], start=i)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["digest", "k", "last", "base", "start", "text"])

    return texts.select("digest", "text").mapInArrow(cut, "digest string, k long, last boolean, base long, start long, text string")


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """digest, k, last, total, head, tail: all tokens of a chunk, and its boundaries where it overlaps the one before and the one after."""
    shape = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("part", pa.bool_()), ("one", pa.int32()), ("two", pa.int32()), ("from", pa.int64()), ("upto", pa.int64())]))
    keys = ("at", "n", "part", "one", "two", "from", "upto")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                found = tokenizer.encode(r["text"], add_special_tokens=False)
                end = r["base"] + len(r["text"])
                inner = lambda x, r=r: x[2] or one_class(r["text"][x[5] - r["base"] : x[6] - r["base"]])
                head = [] if not r["k"] else [x for x in edge(found, r["base"], r["base"] + 1, r["start"]) if inner(x)]
                tail = [] if r["last"] else [x for x in edge(found, r["base"], max(r["start"], end - 2 * overlap), end) if x[6] <= end - MARGIN and x[0] <= end - MARGIN and inner(x)]
                out.append((r["digest"], r["k"], r["last"], len(found.ids), *([dict(zip(keys, x, strict=True)) for x in side] for side in (head, tail))))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), shape, shape), strict=True)], names=["digest", "k", "last", "total", "head", "tail"])

    return chunks.dropDuplicates(["digest", "k"]).mapInArrow(encoded, f"digest string, k long, last boolean, total long, head {_EDGE}, tail {_EDGE}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """digest, n_tokens: null where some two chunks have no boundary in common."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            places = [None if r["missing"] else splice(r["tail"], r["head"]) for r in rows]
            twice = [None if p is None else r["total"] - p[0] + p[1] for p, r in zip(places, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(twice, pa.int64())], names=["digest", "twice"])

    left = encoded.where(~F.col("last")).select("digest", (F.col("k") + 1).alias("k"), "total", "tail")
    right = encoded.select("digest", "k", "head")
    met_rows = left.join(right, ["digest", "k"], "left").select("digest", "total", "tail", F.coalesce("head", F.array().cast(_EDGE)).alias("head"), F.col("head").isNull().alias("missing"))
    twice = met_rows.mapInArrow(met, "digest string, twice long").groupBy("digest").agg(F.sum("twice").alias("twice"), F.count(F.when(F.col("twice").isNull(), 1)).alias("failed"))
    totals = encoded.groupBy("digest").agg(F.sum("total").alias("total"))
    return totals.join(twice, "digest", "left").select("digest", F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("total") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of each row, as the library counts the whole text: without special tokens added, strings of special tokens in it as such.

    A text of more than `chunk` bytes is cut into chunks, copies of it only once. Vocabularies for which no boundary is proven
    (`packing.ranks_of` gives None; `.model` files) are counted text by text. A null or empty text has no tokens; rows are
    independent, so repeats give equal rows; an empty table gives none. Columns but doc_id and text are not read.
    """
    path, spark = path or tokenizer_path(), docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    known = ranks_of(path) if path.endswith(".json") else None
    if known is None:
        return _plain_counts(rows, path, None)
    small, huge = rows.where(F.col("n_bytes") <= chunk), rows.where(F.col("n_bytes") > chunk).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    texts, found = huge.select("digest", "text"), None
    while True:
        step = written(_spliced(written(_encoded(_chunks(texts, chunk, overlap), path, overlap), "chunks")), "spliced")
        done = step.where(F.col("n_tokens").isNotNull())
        found = done if found is None else found.unionByName(done)
        failed = step.where(F.col("n_tokens").isNull()).select("digest")
        if failed.isEmpty():
            break
        texts = huge.select("digest", "text").join(small_or_shuffled(failed), "digest", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    whole = _plain_counts(small, path, spark.sparkContext.broadcast(known))  # as large as the vocabulary
    return whole.unionByName(huge.select("doc_id", "n_bytes", "digest").join(small_or_shuffled(found), "digest").select("doc_id", "n_bytes", "n_tokens"))


def report(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`counts` with over_limit. Nulls, repeats, empty tables and further columns: as there."""
    return counts(docs).withColumn("over_limit", F.col("n_tokens") > limit)
