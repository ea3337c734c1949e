"""Steps that must not grow faster than their input: results against plain loops, and plans without what grew."""

import datetime
import gc
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vestigraph.functions import text
from vestigraph.operators import alignment, evaluation, lexical_index, patterns, retrieval, temporal
from vestigraph.plans.catalog import ORACLES, QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchors_send_no_hits_to_the_driver(spark, tmp_path):
    rng = random.Random(5)
    names = [(f"n:{i}", " " * (i % 2) + "".join(rng.choice("abc ") for _ in range(rng.randint(1, 6)))) for i in range(60)] + [("n:x", None)]
    asked = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(40, None)]
    known = {}
    for key, name in names:
        if name and len(name.strip(" ")) >= 2:
            known[name.strip(" ")] = min(key, known.get(name.strip(" "), key))
    want = []
    for q, question in asked:
        hits = [n for n in known if n in (question or "")]
        best = sorted((n for n in hits if not any(len(m) > len(n) and n in m for m in hits)), key=lambda n: (-len(n), known[n]))
        want += [(q, known[n], n, rank) for rank, n in enumerate(best[:3], 1)]
    # Read from files, as only their size is known to the planner.
    spark.createDataFrame(names, "id string, name string").write.parquet(str(tmp_path / "names"))
    spark.createDataFrame(asked, "question_id long, question string").write.parquet(str(tmp_path / "asked"))
    got = retrieval.anchors(spark.read.parquet(str(tmp_path / "asked")), spark.read.parquet(str(tmp_path / "names")))
    assert "Broadcast" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("tax", [("a", "b", "", None), ("a", "b", "c", "d")])
def test_raw_candidates_compare_names_once(spark, tax):
    rng = random.Random(7)
    words = ["north", "norths", "northa", "nortwest", "south", "southern", "no"]
    rows = lambda n, low: [(low + i, " ".join(rng.choices(words, k=2)) if i else None, rng.choice(tax), rng.choice(["x", "y", "", None]), rng.choice(["1", "2", None]), rng.choice(["p", ""])) for i in range(n)]
    raw, canonical = rows(50, 0), rows(60, 1000)
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    found = []
    for a in raw:
        for b in canonical:
            if not a[1] or not b[1] or a[1][:2] != b[1][:2] or (a[2] is not None and a[2] == b[2]):
                continue
            x, y = grams(a[1]), grams(b[1])
            near = 1.0 if a[1] == b[1] else round(len(x & y) / len(x | y), 6)
            total = min(1.0, near + min(0.05 * sum(bool(u) and u == v for u, v in zip(a[3:], b[3:], strict=True)), 0.1))
            total = round(min(total, 0.85) if a[2] and b[2] else total, 6)
            if total >= 0.7:
                found.append((a[0], b[0], total))
    autos = {a for a, _, _ in found if sum(f[0] == a and f[2] >= 0.9 for f in found) > 1}
    want = [(a, b, total, "auto_merged" if total >= 0.9 and a not in autos else "human_review") for a, b, total in found]
    schema = "id long, name string, tax_id string, address string, phone string, legal_rep string"
    got = alignment.raw_candidates(spark.createDataFrame(raw, schema), spark.createDataFrame(canonical, schema), with_ratio=False)
    assert "raw_grams" not in _plan(got)  # no pair of rows bears what only names are compared by
    assert sorted((*r[:2], round(r[2], 6), r[3]) for r in got.collect()) == sorted(want)
    assert want and (len(tax) == len([t for t in tax if t]) or autos)


@pytest.mark.parametrize("tile", [1, 7, 4096])
def test_pairs_of_rows_are_not_shuffled(spark, tile):
    rng = random.Random(9)
    rows = lambda n, low: [(low + i, rng.choice(["north a", "north b", "nortwest"]), rng.choice(["a", "b", "", None]), rng.choice(["x", "y", "", None]), rng.choice(["1", None]), rng.choice(["p", ""])) for i in range(n)]
    schema = "id long, name string, tax_id string, address string, phone string, legal_rep string"
    raw, canonical = (spark.createDataFrame([*rows(40, low), (low + 99, "single", None, "x", None, "p")], schema) for low in (0, 1000))
    want = sorted(map(tuple, alignment.raw_candidates(raw, canonical, with_ratio=False).collect()))
    got = alignment.raw_candidates(raw, canonical, with_ratio=False, **({"tile": tile} if tile < 4096 else {}))
    above = re.split(r"SortMergeJoin \[link|Exchange", _plan(got))[0]
    assert "Join" not in above and "similarity" in above  # pairs come from the last join, and no shuffle or join follows
    assert sorted(map(tuple, got.collect())) == want and {t for *_, t in want} == {"auto_merged", "human_review"}


def test_matches_look_at_each_name_and_query_once(spark, monkeypatch):
    rows = [("red bolt", 40), ("red", 30), ("bolt", 20), ("blue ring", 25)]
    names = [(i, name) for name, n in rows for i in random.Random(n).sample(range(1000 * n, 1000 * n + 500), n)]
    asked = [(i, ["red bolt", "which blue ring is it", "no", " red"][i % 4]) for i in range(60)]
    sizes, made = [], retrieval._Asked.__init__
    monkeypatch.setattr(retrieval._Asked, "__init__", lambda self, given: sizes.append(len(given)) or made(self, given))
    n, q = spark.createDataFrame(names, "id long, name string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")
    score = text.match_score(F.col("name"), F.col("query"), text.terms(F.col("query")))
    want = retrieval.top(n.crossJoin(q).withColumn("score", score).where("score is not null"), "query_id", F.col("score"), "id", 8)
    got = retrieval.matches(n, q)
    assert sizes == [4]  # all queries, 60 before
    columns = ("query_id", "id", "name", "score", "rank")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[c] for c in columns) for r in want.collect())


def test_pages_as_their_sql_decodes_them(spark, tmp_path):
    pages = [
        "a &amp<style>p{}</style>", "&ampp &ampp; &ampé &amp_ &amp", "&copyx &copy x &notit; &not; &bogus; &nbspx &eacute x &eacute;", "&#146; &#x41 &#x41;g &#65z &#8217;",
        "&amp;lt; &AMP; &Amp; &&amp;&", None, "<p>&lt;b&gt;</p>&quot;&middot5",
    ]
    spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "page_id string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES["html_clean"]).fetchall()
    assert sorted(map(tuple, QUERIES["html_clean"](spark, str(tmp_path)).collect())) == sorted(want)


def test_last_of_an_anchor_is_found_without_sorting_all_facts(spark):
    rng = random.Random(3)
    facts = [(i, rng.choice("ab"), rng.choice("rs"), rng.choice("xyz"), rng.choice([datetime.date(2020, 1, d) for d in (1, 2, 3, 4)] + [None]), rng.choice([1, 2, 3]) if i % 20 else None, [rng.randrange(3), i]) for i in range(60)]
    groups = {}
    for f in facts:
        groups.setdefault((f[1], f[2], f[4]), []).append(f)
    want = set()
    for (_, _, day), fs in groups.items():
        if day and len(fs) > 1 and all(f[5] is not None for f in fs):
            last = max(fs, key=lambda f: (f[5], f[6]))
            want |= {(f[0], day) for f in fs if f[3] != last[3]}
    df = spark.createDataFrame(facts, "fact_id long, head string, relation string, tail string, valid_from date, tail_position int, ordinal array<long>")
    got = temporal.same_anchor(df)
    assert want and set(map(tuple, got.collect())) == want
    assert any("HashAggregate" in line and "max(tail_position" in line for line in _plan(got).splitlines())


def test_hits_of_two_findings_take_one_shuffle(spark):
    gold = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    found = spark.createDataFrame([("b",), ("c",), ("d",), (None,), ("d",)], "key string")
    got = evaluation.recall_and_false_positives(gold, found, "key")
    assert "Join" not in _plan(got)
    assert tuple(got.first()) == (3, 4, 1, round(1 / 3, 6), 0.75)
    assert tuple(evaluation.recall_and_false_positives(gold.limit(0), found.limit(0), "key").first()) == (0, 0, 0, None, None)


def test_lines_are_counted_before_they_meet_their_places(spark, tiny):
    plan = _plan(QUERIES["fixed_pattern_counts"](spark, tiny))
    assert not any("keys=[r_name" in line and "l_partkey" in line and "s_suppkey" in line for line in plan.splitlines())


def test_few_members_with_many_pairs_get_many_tasks(spark, tmp_path):
    spark.range(300).selectExpr("id AS src", "'x' AS dst").write.parquet(str(tmp_path / "members"))
    got = patterns.pairs_by_tiles(spark.read.parquet(str(tmp_path / "members")), tile=20)  # 15 tiles, 120 pairs of them
    assert "SortMergeJoin [shared" in _plan(got)
    assert got.rdd.getNumPartitions() > 50
    assert patterns.pairs_by_tiles(spark.range(5000).selectExpr("id AS src", "id AS dst")).rdd.getNumPartitions() <= 4  # many values without a pair: no more than the session has
    assert got.distinct().count() == got.where("left_id < right_id").count() == 300 * 299 // 2


@pytest.mark.parametrize(("longest", "simple"), [(2, False), (3, False), (4, False), (4, True), (5, False), (5, True)])
def test_cycles_meet_in_the_middle(spark, longest, simple):
    rng = random.Random(longest)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(34)}
    want, walks = set(), [(a, b) for a, b in edges if b > a]
    for hops in range(2, longest + 1):
        walks = [(*w, b) for w in walks for a, b in edges if a == w[-1] and a != b and b >= w[0] and (a, b) not in zip(w, w[1:])]
        walks = [w for w in walks if not simple or w[-1] not in w[1:-1]]
        want |= {(*w[:-1], *[None] * (longest - hops), hops) for w in walks if w[-1] == w[0]}
    rows = [*edges, *list(edges)[:5], (None, 1), (1, None)]
    found = patterns.cycles(spark.createDataFrame(rows, "src long, dst long"), longest, simple)
    assert found.columns == [f"n{j}" for j in range(1, longest + 1)] + ["hops"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    # No walk of over half the edges is made: nothing is joined on the node at which one would end.
    assert longest < 4 or not re.search(rf"Join(\(skew=true\))? \[[^]]*\bn{longest}#", _plan(found))


@pytest.mark.parametrize("cells", [1 << 23, 1])
def test_coverage_takes_a_few_texts_at_a_time(spark, monkeypatch, cells):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé1 ,") for _ in range(n))
    texts, asked = [word(rng.randrange(40)) for _ in range(300)], [(i, word(rng.randrange(12))) for i in range(50)] + [(50, ""), (51, None)]
    grams = lambda t: {a + b for s in ["".join(c for c in (t or "").lower() if c.isalnum())] for a, b in zip(s, s[1:])}
    want = [[round(len(grams(q) & grams(t)) / max(len(grams(q)), 1), 6) for _, q in asked] for t in texts]
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "STEP_CELLS", 4 * len(asked))
    model = retrieval._Coverage(asked)
    table = model.table()
    assert (table is None) == (cells == 1)
    got = list(model.shares(pa.array(texts), table))
    assert max(map(len, got)) <= 4 and [row for part in got for row in part.tolist()] == want
    assert list(retrieval._Coverage([]).shares(pa.array(["ab"]), None))[0].shape == (1, 0)
    docs, questions = spark.createDataFrame([*enumerate(texts), (300, None)], "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    best = dict(map(tuple, retrieval.best_coverage(docs, questions).collect()))
    assert best == {i: max(row) for i, row in enumerate(want)} | {300: 0.0}


def test_postings_of_a_segment_are_numbers():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(1000)]
    tracemalloc.start()
    held = lexical_index._Postings()
    for t in texts:
        held.add(t)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held.n > 250_000 and size < 20 * held.n  # a counter for each text takes over 60 bytes of each posting
    row = lexical_index._segment(list(range(1000)), held, pa.int64(), 64).to_pylist()[0]
    assert row["terms"] == sorted(set(" ".join(texts).split())) and row["n_words"] == 300_000
    assert row["df"] == [sum(w in t for t in map(set, map(str.split, texts))) for w in row["terms"]]


def test_postings_go_when_their_segment_is_written():
    gc.collect()
    gc.disable()
    try:
        held = lexical_index._Postings()
        held.add("red bolt and red ring")
        assert lexical_index._segment([1], held, pa.int64(), 64).num_rows == 1
        del held
        assert gc.collect() == 0  # nothing that only the collector frees, as it hardly ever runs among numbers and strings
    finally:
        gc.enable()


def test_readers_take_a_few_segments_at_a_time(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcdefghij", k=6)) for _ in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", "zz", "j a"])], "item_id long, text string")
    rows = lambda df: sorted((q, d, round(score, 6)) for q, d, score in df.collect())
    want = rows(lexical_index.search(lexical_index.build(docs, str(tmp_path / "whole")), asked, 70))
    monkeypatch.setattr(lexical_index, "SEGMENT_DOCS", 10)
    monkeypatch.setattr(lexical_index, "QUESTIONS", 1)
    monkeypatch.setattr(lexical_index, "PASS", 2)
    index = lexical_index.build(docs, str(tmp_path / "parts"))
    groups = [g.num_rows for f in (tmp_path / "parts/segments").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(groups) == 7 and max(groups) <= 2  # all seven in one before
    found = lexical_index.search(index, asked, 70)
    assert "Generate" not in _plan(found)  # a segment is a row once in a pass, not once for each block of questions
    assert rows(found) == want and want


def test_documents_with_a_key_come_from_the_index(spark, tiny, tmp_path, monkeypatch):
    plan = _plan(QUERIES["recall_at_k_probe"](spark, tiny))
    assert "lexical-index" in plan and "documents.parquet" not in plan  # texts are cut into tokens once, not again as rows of a join
    rng = random.Random(13)
    texts = [" ".join(rng.choices("abcdefghij", k=4)) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lexical_index, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(lexical_index, "QUESTION_CHARS", 1)
    monkeypatch.setattr(lexical_index, "PASS", 4)
    index = lexical_index.build(docs, str(tmp_path / "index"))
    for keys in (["a", "c", "d", "e", "f", "zz"], ["zz"], []):
        want = sorted((w, i) for i, t in enumerate(texts) for w in set((t or "").split()) if w in keys)
        assert sorted(map(tuple, lexical_index.holding(index, spark.createDataFrame([(w,) for w in keys], "term string")).collect())) == want


def test_weights_are_made_for_the_terms_at_hand():
    rows = [(7, "b", 0.5), (3, "a", 2.0), (3, "b", 0.5), (9, "c", 1.5), (7, "a", 2.0)]
    asked = lexical_index._Questions(*(pa.array(c) for c in zip(*rows, strict=True)))
    of = {t: i for i, t in enumerate(asked.terms.to_pylist())}
    assert asked.names == [3, 7, 9]
    assert asked.weights(np.array([of["b"], of["c"]])).tolist() == [[0.5, 0.5, 0.0], [0.0, 0.0, 1.5]]
    assert asked.weights(np.array([of["a"]])).tolist() == [[2.0, 2.0, 0.0]]
