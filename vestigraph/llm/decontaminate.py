"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Training words stream through the automaton, which tracks the longest match that ends at each word. Once built, it lies in
flat arrays of some fifty bytes a word. An automaton holds at most AUTOMATON_WORDS words (or one item); a larger benchmark
is taken in groups of that size, one pass over the documents for each, and only one automaton is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import free, small_batches, small_or_shuffled, text_of, written

WINDOW, AUTOMATON_WORDS = 10, 500_000
#: Documents of which a larger share of words is hit go as a whole.
MOST_COVERAGE = 0.5
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: For offsets in the text itself: A-Z count as a-z do.
_RAW_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z; words are runs of digits, letters and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min((min(window, len(ids)) for _, ids in coded), default=0)
        n = len(self.link)
        top = [-1] * n  # the state of the last `window` words
        behind: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}  # items that end here as a whole
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            up = self.link[v]
            top[v] = top[up] if self.length[up] >= window else v if self.length[v] >= window else -1
        whole: dict[int, list[tuple[int, str]]] = {}
        self.names = [name for name, _ in coded]
        for item, (name, ids) in enumerate(coded):
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if len(ids) >= window and i + 1 >= window:
                    behind.setdefault(top[v], set()).add(item)
            if len(ids) < window:
                whole.setdefault(v, []).append((len(ids), name))
        for v in order:
            if found := [*whole.get(v, []), *self.short.get(self.link[v], [])]:
                self.short[v] = found
        self._flatten(top, behind)

    def _flatten(self, top: list[int], behind: dict[int, set[int]]) -> None:
        """Transitions of state v are words[first[v] : first[v + 1]], in order, with their targets; items behind window state v likewise."""
        self.link, self.length, self.top = (array("i", x) for x in (self.link, self.length, top))
        self.first, self.words, self.target = array("i", [0]), array("i"), array("i")
        self.item_first, self.item = array("i", [0]), array("i")
        for v, moves in enumerate(self.next):
            for c in sorted(moves):
                self.words.append(c)
                self.target.append(moves[c])
            self.first.append(len(self.words))
            self.item.extend(sorted(behind.get(v, ())))
            self.item_first.append(len(self.item))
        del self.next

    def move(self, v: int, c: int) -> int:
        """The state after word c, -1 if there is none."""
        end = self.first[v + 1]
        at = bisect_left(self.words, c, self.first[v], end)
        return self.target[at] if at < end and self.words[at] == c else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches (first word, one past the last), overlapping ones not yet joined, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.shortest or not words:
            return spans, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).view(np.int8)))
        runs = edge.reshape(-1, 2)
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():  # a shorter stretch of known words holds no window
            v = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                to = self.move(v, c)
                while v and to < 0:
                    v = self.link[v]
                    matched = self.length[v]
                    to = self.move(v, c)
                if to >= 0:
                    v = to
                    matched += 1
                if matched >= self.window:
                    spans.append((i + 1 - self.window, i + 1))
                    w = self.top[v]
                    items.update(self.names[k] for k in self.item[self.item_first[w] : self.item_first[w + 1]])
                if self.short and (ends := self.short.get(v)):
                    for size, name in ends:
                        if size <= matched:
                            spans.append((i + 1 - size, i + 1))
                            items.add(name)
        return spans, items


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def groups(benchmark: DataFrame, most: int = AUTOMATON_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items with their words, in groups of about `most` words at the most (or one item), one group at a time on the driver. Null texts and texts without words have no window."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        words = words_of(row[1])
        if held and n + len(words) > most:
            yield held
            held, n = [], 0
        if words:
            held.append((row[0] or "", words))
            n += len(words)
    yield held


FOUND = "doc_id long, digest binary, spans array<int>, items array<string>"


def _matcher(docs: DataFrame, benchmark: DataFrame, window: int, most: int):
    """How to find a document's hits: an automaton, or, for a benchmark of several groups, a table of the hits of all (doc_id, digest of the text, spans, items)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = groups(benchmark, most)
    group, following = next(parts), next(parts, None)
    if following is None:
        return spark.sparkContext.broadcast(Automaton(group, window)), None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = []
    while group is not None:
        machine = spark.sparkContext.broadcast(Automaton(group, window))

        def scan(batches: Iterator[pa.RecordBatch], machine=machine) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    spans, items = machine.value.match(words_of(text))
                    if spans:
                        out.append((doc, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), [x for s in joined(spans) for x in s], sorted(items)))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)], names=["doc_id", "digest", "spans", "items"])

        found.append(written(rows.mapInArrow(scan, FOUND), "benchmark-hits"))
        machine.destroy()
        group, following = following, next(parts, None)
    # Rows that share id and text have the same hits, so each group gives them once.
    every = reduce(DataFrame.unionByName, found).dropDuplicates()
    merged = every.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return None, written(merged, "benchmark-hits-merged")


def _with_hits(docs: DataFrame, hits: DataFrame | None, spans: str = "__spans", items: str = "__items") -> DataFrame:
    """docs with two more columns, spans and items, null where the automaton is asked in the task."""
    if hits is None:
        return docs.withColumns({spans: F.lit(None).cast("array<int>"), items: F.lit(None).cast("array<string>")})
    doc, digest = free(docs, "__doc", "__digest")
    side = small_or_shuffled(hits.select(F.col("doc_id").alias(doc), F.col("digest").alias(digest), F.col("spans").alias(spans), F.col("items").alias(items)), 2000)
    met = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.unhex(F.sha2(text_of(), 256)) == F.col(digest))
    return docs.join(side, met, "left").drop(doc, digest)


def _found(machine, words: list[bytes], spans: list[int] | None, items: list[str] | None) -> tuple[list[list[int]], set[str]]:
    if machine is not None:
        pairs, names = machine.value.match(words)
        return joined(pairs), names
    flat = [int(x) for x in (spans if spans is not None else ())]
    return joined(list(zip(flat[::2], flat[1::2], strict=True))), set(items if items is not None else ())


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null text has no words; repeated rows are each reported; items with the same id count once; an empty benchmark hits nothing; an empty table gives no rows; columns but doc_id and text are not read."""
    machine, hits = _matcher(docs, benchmark, window, most)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans, items in zip(*(b.column(c).to_pylist() for c in ("text", "__spans", "__items")), strict=True):
                words = words_of(text)
                spans, items = _found(machine, words, spans, items)
                hit = sum(y - x for x, y in spans)
                rows.append((len(words), hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = _with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), hits)
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = MOST_COVERAGE, most: int = AUTOMATON_WORDS) -> DataFrame:
    """docs, all columns, whatever their names, without the hit spans; a document goes if more than most_coverage of its words are hit. n_chars, where there is one, follows the text. Clean documents are untouched, null texts too; rows that repeat are each treated; an empty table or benchmark changes nothing."""
    machine, hits = _matcher(docs, benchmark, window, most)

    def cut(texts, spans_of, items_of):
        import pandas as pd

        out = []
        for text, spans, items in zip(texts, spans_of, items_of, strict=True):
            words = words_of(text or "")
            spans, _ = _found(machine, words, spans, items)
            if not spans:
                out.append((False, None))
                continue
            gone = sum(y - x for x, y in spans) > most_coverage * len(words)
            places = [m.span() for m in _RAW_WORD.finditer(text)]
            kept, at = [], 0
            for x, y in spans:
                kept.append(text[at : places[x][0]])
                at = places[y - 1][1]
            out.append((gone, "\n".join([*kept, text[at:]])))
        return pd.DataFrame(out, columns=["gone", "text"])

    # Spark may copy a deterministic function into filter and projection; this one is to run once for each text.
    once = F.pandas_udf(cut, "struct<gone: boolean, text: string>").asNondeterministic()
    spans, items, made = free(docs, "__spans", "__items", "__cut")
    rows = _with_hits(docs, hits, spans, items).withColumn(made, once("text", spans, items)).where(~F.col(f"{made}.gone"))
    new = F.coalesce(F.col(f"{made}.text"), F.col("text"))
    changed = {"text": new} | ({"n_chars": F.when(F.col(f"{made}.text").isNotNull(), F.length(f"{made}.text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.withColumns(changed).select(*docs.columns)
