"""Best-fit packing of token sequences, planned on a histogram of lengths.

The plan depends on the counts of the (at most `capacity`) distinct lengths alone, so its size is bounded by the
capacity and not by the corpus. Documents then take planned slots by their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.llm.common import small_batches, text_of, written

CAPACITY, END_ID = 4096, 1
#: Ranks are counted in so many independent parts of each length, so no length lands in one task.
RANK_PARTS = 256
_CACHE_WORDS, _SEGMENT = 100_000, 1 << 20
#: str.split() also cuts at these, the tokenizer's white space doesn't hold them.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"\s")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The rules that `ranks_of` knows: how the tokenizer rewrites text, and where it cuts words into parts.
_KNOWN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
}
#: Words of printable ASCII and Latin-1 letters: NFC leaves them alone, and lower case and letters are the same by any Unicode version.
_PLAIN_WORD = re.compile(r"[!-~À-ÖØ-öø-ÿ]{1,100}")
_PLAIN_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")


def _bytes_by_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _is_own_encoding(symbols: list[str], rank: dict[tuple[str, str], int]) -> bool:
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), len(rank)))
        if (symbols[best], symbols[best + 1]) not in rank:
            return False
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return True


def ranks_of(path: str) -> dict[bytes, int] | None:
    """The tokenizer's vocabulary as ranks by bytes, a space for the end of a word; None unless ranks give the very same ids.

    They do if ids follow the order of merges and each token, encoded alone, is itself. For let the first merge in which
    ranks and merges differ join x and y to a token T: nothing crossed the ends of T before, so T alone would also have
    come to x and y, and its last merge is then the one for T.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, cuts = rules["model"], rules.get("pre_tokenizer") or {}
    known = rules.get("normalizer") == _KNOWN_RULES["normalizer"] and (cuts.get("pretokenizers") or [None])[0] == _KNOWN_RULES["split"]
    bytewise = [c.get("type") for c in cuts.get("pretokenizers", [])[1:]] == ["ByteLevel"] and not cuts["pretokenizers"][1].get("add_prefix_space") and not cuts["pretokenizers"][1].get("use_regex")
    if not (known and bytewise and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and not model.get("dropout")):
        return None
    vocab, end, of = model["vocab"], "</w>", _bytes_by_symbol()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {m: i for i, m in enumerate(merges)}
    first = len(vocab) - len(merges)
    single = {s + e for s in of for e in ("", end)}
    if len(rank) != len(merges) or first != len(single) or {vocab.get(s, first) for s in single} != set(range(first)):
        return None
    if any(vocab[c + end] < 256 for c in of) or any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return None
    ranks: dict[bytes, int] = {}
    for token, i in vocab.items():
        whole = token.endswith(end) and token != end
        body = token.removesuffix(end) if whole else token
        symbols = list(body)
        if whole:
            symbols[-1] += end
        if not _is_own_encoding(symbols, rank):
            return None
        ranks[bytes(of[c] for c in body) + (b" " if whole else b"")] = i
    return ranks if len(ranks) == len(vocab) else None


class WordEncoder:
    """Little-endian unsigned 32-bit ids of a text. The tokenizer drops white space and no token crosses it, so words are encoded once and remembered (a bounded number of them).

    With ranks (see `ranks_of`), plain words are merged by ranks, many in one call; all others go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.merger = Tokenizer.from_file(path), {}, None
        if ranks:
            import tiktoken

            self.merger, self.line_end = tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _merged(self, words: list[str]) -> list[bytes]:
        parts = _PLAIN_PART.sub(r"\g<0> ", "\n".join(words).lower())
        ids = np.asarray(self.merger.encode_ordinary(parts), dtype="<u4")
        ends = np.flatnonzero(ids == self.line_end)
        data, starts = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
        return [data[a:b] for a, b in zip(starts, [*(4 * ends).tolist(), len(data)], strict=True)]

    def _learn(self, new: list[str]) -> None:
        if self.merger:
            plain = [w for w in new if _PLAIN_WORD.fullmatch(w) and "<|" not in w]
            if plain:
                self.known.update(zip(plain, self._merged(plain), strict=True))
            if len(plain) == len(new):
                return
            new = [w for w in new if w not in self.known]
        self.known.update(zip(new, (self._bytes(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))

    def segment(self, text: str) -> bytes:
        words = text.split()
        known = self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > _CACHE_WORDS:
                known.clear()
                new = list(set(words))
            self._learn(new)
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> Iterator[bytes]:
        if _SEPARATORS.search(text):
            yield self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return
        at = 0
        while len(text) - at > _SEGMENT:
            cut = _SPACE.search(text, at + _SEGMENT)
            if cut is None:
                break
            yield self.segment(text[at : cut.start()])
            at = cut.start()
        yield self.segment(text[at:] if at else text)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str, ranks: dict[bytes, int] | None) -> WordEncoder:
    """The one encoder of a worker and a tokenizer: tasks that follow one another find their words encoded, and no task's tables lie beside the last one's."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, ranks)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ids of the whole text and end_id; only what is longer than capacity is cut. A null text is empty."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(ranks_of(path))  # as large as the vocabulary

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size, end = encoder_of(path, ranks.value), 4 * capacity, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, piece = b"", 0
                for more in encoder.encode(text):
                    held += more
                    done = 0
                    while len(held) - done > size:  # a full piece, and something follows it
                        out.append((doc_id, piece, piece * capacity, capacity, zlib.crc32(held[done : done + size])))
                        piece, done = piece + 1, done + size
                    held = held[done:]
                if len(held) == size:
                    out.append((doc_id, piece, piece * capacity, capacity, zlib.crc32(held)))
                    piece, held = piece + 1, b""
                held += end
                out.append((doc_id, piece, piece * capacity, len(held) // 4, zlib.crc32(held)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(pieces, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts. Returns runs (length, first rank, ranks, first sequence, slots in each sequence, offset of the first slot).

    Sequences with the same free room are handled as one group, whatever their number: the smallest room that fits takes as many of the length as it can hold, since after one the same sequence is the best fit for the next.
    """
    runs, rooms, groups, made = [], [], {}, 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            each = room // length
            take = min(n, left // each)
            parts = [(first, take, each)] if take else []
            if take < n and (rest := left - take * each):
                if not take:
                    parts = [(first, 1, rest)]
                elif rest < each:
                    parts.append((first + take, 1, rest))
            used = 0
            for seq, count, per in parts:
                runs.append((length, rank, count * per, seq, per, capacity - room))
                rank, left, used = rank + count * per, left - count * per, used + count
                if after := room - per * length:
                    if after not in groups:
                        insort(rooms, after)
                    groups.setdefault(after, []).append((seq, count))
            if used < n:
                if room not in groups:
                    insort(rooms, room)
                groups.setdefault(room, []).append((first + used, n - used))
    return runs


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset, gapless from 0 in each sequence.

    Null text: empty, so end_id alone. Repeated rows: each gets its own slot. Empty table: no rows. Other columns are not read.
    """
    pieces = written(token_pieces(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    table = np.array(runs, dtype=np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 48
        starts = table[:, 0] * span + table[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = table[np.searchsorted(starts, length * span + rank, "right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    parts = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)))
    bases = parts.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = parts.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))).join(bases, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
