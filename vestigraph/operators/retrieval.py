"""Retrieval: BM25, n-gram overlap, dense vectors, quotas and anchors. Questions are rows, so a question set is one job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.functions.text import bigram_codes, terms
from vestigraph.operators import lexical_index, substrings
from vestigraph.session import shared_path

K1, B = 1.5, 0.75
#: Questions that go to all tasks at once; a larger set makes more passes.
QUESTIONS = 2000


#: Characters of the questions that go to all tasks at once, and rows that are ranked at once.
QUESTION_CHARS, COVERAGE_LOT = 2_000_000, 4096
#: Cells of a matrix of bigrams and names, questions or texts; of one that a few texts take, which come and go.
CELLS, STEP_CELLS = 1 << 23, 1 << 20


def slices(questions: DataFrame, key: str, most: int = QUESTIONS, text: str | None = None) -> list[DataFrame]:
    """The question set cut by a hash of its key into parts of about `most` rows and, where a text column is named, QUESTION_CHARS characters, each small enough to be sent to every task."""
    size = questions.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0)) if text else F.lit(0)).first()
    n = max(1, -(-size[0] // most), -(-size[1] // QUESTION_CHARS))
    return [questions.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def indexed(docs: DataFrame, doc: str = "doc_id") -> lexical_index.Index:
    return lexical_index.build(docs, shared_path(docs.sparkSession, "lexical-index"), doc)


def bm25_top(docs: DataFrame | lexical_index.Index, queries: DataFrame, k: int, doc: str = "doc_id", query: str = "item_id", k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """(query, doc, score, rank): for each query the k best documents that share a token with it, by score rounded to `digits`, then doc.

    docs: texts, or an index of them. Query tokens are a set; documents without tokens count in the number and the mean length. Texts are read once, into an
    index in the shared folder (`lexical_index`), which can also be kept and searched again.
    """
    index = docs if isinstance(docs, lexical_index.Index) else indexed(docs, doc)
    return top(lexical_index.search(index, queries, k, doc, query, k1, b, digits), query, F.round("score", digits), doc, k)


class _Coverage:
    """Shares of the questions' bigrams that texts have, for a slice of questions that every task holds."""

    def __init__(self, asked: list[tuple]):
        grams = [bigram_codes(text or "") for _, text in asked]
        sizes = np.array([len(g) for g in grams], np.int64)
        self.names, self.size = [q for q, _ in asked], np.maximum(sizes, 1).astype(np.float64)
        self.grams = np.unique(np.concatenate(grams)) if asked else np.zeros(0, np.uint64)
        self.of = np.concatenate([np.searchsorted(self.grams, g) for g in grams]).astype(np.int32) if asked else np.zeros(0, np.int32)
        self.some = np.flatnonzero(sizes)  # questions with bigrams, and where theirs begin in `of`
        self.begin = (np.cumsum(sizes) - sizes)[self.some]

    def table(self) -> np.ndarray | None:
        """Bigrams by questions, where that is a matrix of bounded size."""
        if len(self.grams) * len(self.names) > CELLS:
            return None
        held = np.zeros((len(self.grams), len(self.names)), np.float32)
        held[self.of, np.repeat(self.some, np.diff(np.append(self.begin, len(self.of))))] = 1
        return held

    def shares(self, texts: Iterable[pa.Scalar], table: np.ndarray | None) -> Iterator[np.ndarray]:
        """Of a few texts at a time a row for each, rounded to 6 digits; 0 for a question without bigrams. Without a table, questions are counted by lists of their bigrams."""
        width = max(len(self.grams), len(self.names), 1)
        for part in batched(texts, max(1, STEP_CELLS // width)):
            has = np.zeros((len(part), len(self.grams)), np.float32 if table is not None else np.int8)
            for i, text in enumerate(part):
                codes = bigram_codes(text.as_py())
                place = np.searchsorted(self.grams, codes)
                place[place == len(self.grams)] = 0
                has[i, place[self.grams[place] == codes] if len(self.grams) else []] = 1
            if table is not None:
                counts = (has @ table).astype(np.float64)
            else:
                counts = np.zeros((len(part), len(self.names)))
                for i in range(len(part)):
                    counts[i, self.some] = np.add.reduceat(has[i][self.of], self.begin, dtype=np.int32)
            yield np.round(counts / self.size, 6)


def _coverages(questions: DataFrame, question: str) -> list[tuple[DataFrame, _Coverage]]:
    return [(part, _Coverage([(r[0], r[1]) for r in part.select(question, "text").collect()])) for part in slices(questions, question, text="text")]


def best_coverage(docs: DataFrame, questions: DataFrame, doc: str = "doc_id", question: str = "item_id") -> DataFrame:
    """(doc, best_overlap) for all documents: the largest share of a question's bigrams of letters and digits that the text has, 0 where there is none.

    The maximum is taken where the text is read, so a document is one row for each slice of questions.
    """
    kind, parts = docs.schema[doc].dataType.simpleString(), []
    texts = docs.select(doc, F.coalesce("text", F.lit("")).alias("text"))
    for _, model in _coverages(questions, question):
        held = docs.sparkSession.sparkContext.broadcast(model)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = held.value.table()
            for b in batches:
                best = [got.max(1, initial=0.0) for got in held.value.shares(b.column(1), table)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *best]))], names=[doc, "best_overlap"])

        parts.append(texts.mapInArrow(scan, f"{doc} {kind}, best_overlap double"))
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy(doc).agg(F.max("best_overlap").alias("best_overlap"))


def covering(rows: DataFrame, questions: DataFrame, limit: int, group: str, key: str = "doc_id", question: str = "item_id", lot: int = COVERAGE_LOT) -> DataFrame:
    """(question, group, key, score, mentions, spans, char_start): of all pairs of a question and a row those that `evidence.selected` with the same limit can take, and no fewer.

    rows: group, key, text, mentions, spans, char_start. A question's best rows of a task are kept while it reads: of each
    group as many as can have sure places, of those the best `limit`; and the best 2 x limit to fill up, times the most
    that a key repeats in what was read at once. What was kept is cut again after each lot, so a task sends on a bounded
    number of rows for each question, whatever it reads, and no window ever sees a whole group.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, key)}
    groups = rows.agg(F.count_distinct(group)).first()[0]
    sure = max(limit // max(groups, 1), 1)
    texts = rows.select(group, key, F.coalesce("text", F.lit("")).alias("text"), F.col("mentions").cast("double"), F.col("spans").cast("double"), F.col("char_start").cast("double"), F.xxhash64(group).alias("g"))
    asked_kind, parts = questions.schema[question].dataType.simpleString(), []
    for _, model in _coverages(questions, question):
        held = rows.sparkSession.sparkContext.broadcast(model)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, table = held.value, held.value.table()
            kept: list[pa.Table | None] = [None] * len(model.names)
            for read in _lots(batches, max(1, min(lot, CELLS // max(len(model.names), 1)))):
                shares = np.concatenate(list(model.shares(read.column("text"), table)))
                facts = read.drop_columns(["text"])
                for j in range(len(model.names)):
                    one = facts.append_column("score", pa.array(shares[:, j]))
                    one = one.take(pa.array(_takeable(one, limit, sure, group, key)))
                    if kept[j] is not None:
                        one = pa.concat_tables([kept[j], one])
                        one = one.take(pa.array(_takeable(one, limit, sure, group, key)))
                    kept[j] = one
            for name, one in zip(model.names, kept, strict=True):
                if one is not None:
                    yield from one.drop_columns(["g"]).append_column(question, pa.array([name] * len(one), _ARROW.get(asked_kind, pa.string()))).select([question, group, key, "score", "mentions", "spans", "char_start"]).combine_chunks().to_batches()

        parts.append(texts.mapInArrow(scan, f"{question} {asked_kind}, {group} {kinds[group]}, {key} {kinds[key]}, score double, mentions double, spans double, char_start double"))
    return reduce(DataFrame.unionByName, parts)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _lots(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _takeable(rows: pa.Table, limit: int, sure: int, group: str, key: str) -> np.ndarray:
    """Places of the rows of one question that can be taken: see `covering`. Nulls stand as Spark sorts them, last descending and first ascending."""
    number = lambda c, null: np.where(np.isnan(x := rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64)), null, x)
    score, mentions, spans, start = rows.column("score").to_numpy(), number("mentions", -np.inf), number("spans", -np.inf), number("char_start", -np.inf)
    keys = rows.column(key).combine_chunks()
    tie = pa.compute.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    own = np.lexsort((tie, start, -mentions, -score))
    of = rows.column("g").to_numpy()[own]
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
    nth = np.empty(len(of), np.int64)
    nth[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
    grouped = rows.column(group).combine_chunks().is_valid().to_numpy(zero_copy_only=False)[own]
    places = own[(nth < sure) & grouped][:limit]
    fills = np.lexsort((tie, start, -mentions, ~(spans > 0), -score))
    return np.union1d(places, fills[: 2 * limit * int(np.bincount(tie).max(initial=1))])


def top(scores: DataFrame, group: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k best of each group, score descending, then tie ascending: adds `rank`."""
    w = Window.partitionBy(group).orderBy(score.desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 for a zero vector."""
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    dot = lambda f: F.aggregate(both, F.lit(0.0), lambda s, p: s + F.coalesce(f(p), F.lit(0.0)))
    size = F.sqrt(dot(lambda p: p["x"] * p["x"])) * F.sqrt(dot(lambda p: p["y"] * p["y"]))
    return F.when(size > 0, dot(lambda p: p["x"] * p["y"]) / size).otherwise(0.0)


def fingerprints(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n, fingerprint): SHA-256 of each group's keys, sorted as text and joined by line ends. Keys stream through the digest in order, so a group of any size takes no memory."""
    dealt = rows.select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("k")).repartition("g").sortWithinPartitions("g", "k")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, digest, out = None, 0, None, []
        for b in batches:
            for g, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is None or g != of:
                    if digest is not None:
                        out.append((of, n, digest.hexdigest()))
                    of, n, digest = g, 0, hashlib.sha256()
                digest.update((("\n" if n else "") + k).encode())
                n += 1
        if digest is not None:
            out.append((of, n, digest.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=[group, "n", "fingerprint"])

    return dealt.where("k is not null").mapInArrow(scan, f"{group} string, n long, fingerprint string")


def quota_nodes(nodes: DataFrame, limit: int, kind: str = "kind", degree: str = "degree", key: str = "id") -> DataFrame:
    """At most `limit` nodes: each kind has max(limit // kinds, 1) sure places by degree, what is left fills up by degree over all. Kinds beyond the limit are cut in order of their name.

    Each kind's best `limit` rows are enough, so later steps see kinds x limit rows at most.
    """
    kinds = nodes.select(F.coalesce(kind, F.lit("UNKNOWN")).alias("k")).distinct().agg(F.count("*").alias("kinds"))
    by_kind = Window.partitionBy("k").orderBy(F.desc(degree), key)
    best = nodes.withColumn("k", F.coalesce(kind, F.lit("UNKNOWN"))).withColumn("nth", F.row_number().over(by_kind)).where(F.col("nth") <= limit)
    sure = F.greatest(F.floor(F.lit(limit) / F.col("kinds")), F.lit(1))
    best = best.join(F.broadcast(kinds)).withColumn("sure", F.col("nth") <= sure)
    first = best.orderBy(F.desc("sure"), F.when(F.col("sure"), F.col("k")).asc_nulls_last(), F.when(F.col("sure"), F.col("nth")).asc_nulls_last(), F.desc(degree), key).limit(limit)
    return first.select(key, F.col("k").alias(kind), degree, "sure")


LEAST_NAME = 2


def anchors(questions: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, id, name, rank): nodes (id, name) whose trimmed name occurs in a question (question_id, question), longest first, then by id; none that a kept one's name contains, and of equal names the first.

    Names of fewer than two characters don't count. Automata find the names while questions are read, so only hits become
    rows; those of one question, as many as its text has parts at most, meet in one row. A name contained in another hit is
    always contained in a kept one, so kept names are the maximal ones.
    """
    named = names.select("id", F.trim("name").alias("name")).where(F.length("name") >= LEAST_NAME).groupBy("name").agg(F.min("id").alias("id"))
    found = substrings.occurring(questions, named, "question_id", "question")
    # A file's size says nothing of its hits, which must not be sent to the driver as the join's smaller side.
    hits = found.hint("merge").join(named, "name").select("question_id", F.struct((-F.length("name")).alias("order"), "id", "name").alias("hit"))
    own = hits.groupBy("question_id").agg(F.collect_list("hit").alias("hits"))
    maximal = F.filter("hits", lambda a: ~F.exists("hits", lambda b: (b["order"] < a["order"]) & F.contains(b["name"], a["name"])))
    best = own.select("question_id", F.posexplode(F.slice(F.array_sort(maximal), 1, most)).alias("nth", "hit"))
    return best.select("question_id", "hit.id", "hit.name", (F.col("nth") + 1).alias("rank"))


def derived_only(nodes: DataFrame) -> DataFrame:
    """Nodes whose id has a namespace. Extracted fragments have none and are no place to start from."""
    return nodes.where(F.contains("id", F.lit(":")))


#: Names that are scored together.
NAME_LOT = 8192


class _Asked:
    """A slice of queries that every task holds: the automaton of all that names may contain, the queries' characters, and their terms."""

    def __init__(self, rows: list[tuple]):
        rows = [(key, query.strip(" "), terms_) for key, query, terms_ in rows if (query or "").strip(" ")]
        self.keys, self.wholes = [r[0] for r in rows], [r[1] for r in rows]
        self.by_whole: dict[str, list[int]] = {}
        self.by_term: dict[str, list[int]] = {}
        for j, (_, whole, terms_) in enumerate(rows):
            self.by_whole.setdefault(whole, []).append(j)
            for t in terms_:
                if t != whole:
                    self.by_term.setdefault(t, []).append(j)

    def automaton(self):
        return substrings._automaton([*self.by_whole.keys() | self.by_term.keys()])

    def tiers(self, names: list[str], automaton) -> np.ndarray:
        """How well each name (row) answers each query (column), as `match_score`, 0 for not at all."""
        found = self._by_characters(names)
        place: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            place.setdefault(name, []).append(i)
        inside = substrings._automaton(list(place))

        def raise_to(i: int | list[int], queries: list[int], tier: int) -> None:
            at = np.ix_(np.atleast_1d(i), queries)
            found[at] = np.maximum(found[at], tier)

        for text, queries in self.by_term.items():  # terms that contain a name
            if len(text) >= 2:
                for name in {n for _, n in inside.iter(text)}:
                    raise_to(place[name], queries, 65)
        for text, queries in self.by_whole.items():
            for name in {n for _, n in inside.iter(text)}:
                raise_to(place[name], queries, 100 if name == text else 90)
        if len(automaton):
            for name, rows in place.items():
                for text in {t for _, t in automaton.iter(name)}:
                    raise_to(rows, self.by_term.get(text, []), 85 if text == name else 70)
                    raise_to(rows, self.by_whole.get(text, []), 100 if text == name else 95)
        return found

    def _by_characters(self, names: list[str]) -> np.ndarray:
        """40 where at least two characters are shared, and half as many as the name is long."""
        number = {c: i for i, c in enumerate(sorted(set("".join(names))))}
        asked, size = np.zeros((len(number), len(self.wholes)), np.float32), np.array([len(n) for n in names])[:, None]
        for j, whole in enumerate(self.wholes):
            asked[[number[c] for c in set(whole) if c in number], j] = 1
        out, step = np.zeros((len(names), len(self.wholes)), np.int8), max(1, CELLS // max(len(number), 1))
        for at in range(0, len(names), step):
            has = np.zeros((len(names[at : at + step]), len(number)), np.float32)
            for i, name in enumerate(names[at : at + step]):
                has[i, [number[c] for c in set(name)]] = 1
            shared = has @ asked
            out[at : at + step] = np.where((shared >= 2) & (2 * shared >= size[at : at + step]), 40, 0)
        return out


def matches(names: DataFrame, queries: DataFrame, limit: int = 8, key: str = "query_id") -> DataFrame:
    """(query_id, id, name, score, rank): the names (id, name) that answer a query (query_id, query) best, then by id.

    Each name and each query is looked at once, whatever number of rows bear it: of a name's rows the first `limit` by id
    can be among a query's best, and those only if the name is, by its first row. A slice of queries goes to all names.
    Queries' terms are found in names, and names in queries' terms, by automata, and shared characters by one product; no
    pair of a name and a query becomes a row unless it is among the best of its lot.
    """
    kind, parts = names.schema["id"].dataType.simpleString(), []
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    firsts = names.where("name != '' and id is not null").select("id", "name", nth.alias("nth")).where(F.col("nth") <= limit)
    texts = queries.where("query != ''").select("query").distinct()
    for part in slices(texts, "query", text="query"):
        asked = _Asked([tuple(r) for r in part.select(F.col("query").alias("text"), "query", terms(F.col("query"))).collect()])  # one slice, of bounded size
        held = names.sparkSession.sparkContext.broadcast(asked)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asked, automaton = held.value, held.value.automaton()
            for lot in _lots(batches, NAME_LOT):
                lot = lot.sort_by("id")  # noqa: PLW2901
                tier = asked.tiers(lot.column("name").to_pylist(), automaton).astype(np.int32)
                order = np.argsort(-(tier * len(lot) - np.arange(len(lot))[:, None]), axis=0, kind="stable")[:limit]
                best = np.take_along_axis(tier, order, 0)
                nth, q = np.nonzero(best)
                at = pa.array(order[nth, q])
                yield from pa.table({"query": pa.array([asked.keys[j] for j in q], pa.string()), "id": lot.column("id").take(at), "name": lot.column("name").take(at), "score": pa.array(best[nth, q], pa.int32())}).combine_chunks().to_batches()

        parts.append(firsts.where("nth = 1").select("id", "name").mapInArrow(scan, f"query string, id {kind}, name string, score int"))
    best = top(reduce(DataFrame.unionByName, parts), "query", F.col("score"), "id", limit).select("query", "name", "score")
    rows = top(best.join(firsts.select("id", "name"), "name"), "query", F.col("score"), "id", limit)
    # A file's size says little of the queries' number, so they are not to be sent to the driver as the join's smaller side.
    return queries.select(key, "query").hint("merge").join(rows, "query").select(key, "id", "name", "score", "rank")
