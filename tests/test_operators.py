"""Small cases that the tables don't hold: malformed layouts, citations of what isn't there, nulls and empty inputs."""

import datetime
import json
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vestigraph.functions import scope, text
from vestigraph.operators import alignment, citations, documents, evaluation, evidence, layout, lexical_index, paths, patterns, projection, retrieval, rules, substrings, temporal, vectors, versions
from vestigraph.plans import relations
from vestigraph.session import shared_path


def test_layout_blocks_in_both_forms(spark):
    leaf = lambda t: {"type": "text", "content": t}
    nested = [[{"type": "title", "content": {"title_content": [leaf("One "), leaf("two")]}}], "junk", [{"content": {"html": "<table>"}}, {"content": [leaf("three"), {"content": "not it", "type": "image"}]}]]
    flat = [{"text": " a ", "page_idx": 0}, {"text": "b"}, {"text": "c", "page_idx": True}, {"text": "d", "page_idx": "2"}, {"text": None, "page_idx": -1}, {"text": "e", "page_idx": 1.5}, 7]
    cases = [json.dumps(nested), json.dumps(flat), None, "{not json", '{"a": 1}', "[]", "[[]]"]
    rows = layout.with_blocks(spark.createDataFrame(list(enumerate(cases)), "n int, layout string")).orderBy("n").collect()
    got = [[tuple(b) for b in r.blocks] for r in rows]
    assert got[0] == [("One two", 1), ("", 3), ("three", 3)]
    assert got[1] == [("a", 1), ("b", None), ("c", None), ("d", 3), ("", None), ("e", None)]
    assert got[2:] == [[]] * 5


def test_page_spans(spark):
    flat = json.dumps([{"text": "aa", "page_idx": 0}, {"text": "lost", "page_idx": 0}, {"text": "aa", "page_idx": 1}, {"text": "begins and is rewritten", "page_idx": 2}])
    docs = spark.createDataFrame([(1, "aa aa begins otherwise", flat), (2, None, flat), (3, "aa", None), (4, "aa", "oops")], "doc_id long, text string, layout string")
    got = [tuple(r) for r in layout.page_spans(docs, probe=6).orderBy("doc_id", "char_start").collect()]
    assert got == [(1, 0, 2, 1), (1, 3, 5, 2), (1, 6, 12, 3)]


def _cited(spark, evidence, answer="no evidence in it"):
    chunks = spark.createDataFrame([("chunk-1", 10, 100, "Alpha pays Beta 7 天"), ("chunk-2", None, 0, "Alpha"), ("chunk-3", 11, 0, "Gamma")], "chunk_id string, doc_id long, char_start long, text string")
    spans = spark.createDataFrame([("chunk-1", "Beta", 111, 115), ("chunk-1", "Far", 500, 503), ("chunk-1", "Edge", 110, 400)], "chunk_id string, mention string, char_start long, char_end long")
    answers = spark.createDataFrame([(1, answer, evidence)], "answer_id long, answer string, evidence array<string>")
    injected = spark.createDataFrame([(1, "chunk-1"), (1, "chunk-3")], "answer_id long, chunk_id string")
    found = citations.located(answers, chunks, spans, injected)
    kept = citations.grounded(found, answers, injected, chunks, spans)
    return [[(r.chunk_id, r.nth, r.char_offset, r.char_end) for r in x.orderBy("nth").collect()] for x in (found, kept)]


def test_citations(spark):
    size = len("Alpha pays Beta 7 天")
    found, kept = _cited(spark, ["chunk-3", "chunk-1", "chunk-1# BETA ", "chunk-2", "chunk-9", "none"])
    assert found == kept == [("chunk-3", 0, 0, 5), ("chunk-1", 1, 11, 15)]
    assert _cited(spark, ["chunk-1#Far"])[0] == [("chunk-1", 0, 0, size)]
    assert _cited(spark, ["chunk-1#edge"])[0] == [("chunk-1", 0, 10, size)]
    assert _cited(spark, ["chunk-1", "chunk-3"], "it took 7 天 [source: chunk-3]")[1] == [("chunk-1", 0, 0, size)]
    assert _cited(spark, ["chunk-1", "chunk-3"], "Beta was paid")[1] == [("chunk-1", 0, 0, size)]
    assert _cited(spark, ["chunk-1"], "code SO-2026-0912")[1] == []
    assert _cited(spark, None) == [[], []]


def test_windows(spark):
    edges = spark.createDataFrame([("a", "2020", None), ("a", "2020", None), ("a", None, None), ("b", "2020", None), ("b", "2020", "2021"), ("c", None, None)], "k string, valid_from string, valid_to string")
    own = temporal.single_window(edges, "k")
    assert {r.k: (r.found, r.window and tuple(r.window)) for r in own.collect()} == {"a": ("one", ("2020", None)), "b": ("many", None), "c": ("none", None)}
    keys = spark.createDataFrame([("a",), ("c",), ("z",)], "k string")
    claims = temporal.single_window(spark.createDataFrame([("a", "1999", None), ("c", "1999", None)], "k string, valid_from string, valid_to string"), "k")
    assert {r.k: (r.found, r.window and r.window.valid_from) for r in temporal.inherited_window(keys, own, claims, "k").collect()} == {"a": ("one", "2020"), "c": ("none", "1999"), "z": ("none", None)}


def test_earliest_fact(spark):
    rows = [("x", 1, "2022", None, "d1"), ("x", 2, "2020", "2025", "d2"), ("x", 3, "2021", "2024", "d3"), ("y", 1, None, None, "d1"), ("y", 2, "2020", None, "d2")]
    got = temporal.earliest_fact(spark.createDataFrame(rows, "k string, n int, valid_from string, valid_to string, source string"), ["k"], ["n"])
    assert {tuple(r) for r in got.select("k", "valid_from", "valid_to", "source").collect()} == {("x", "2020", "2025", "d2"), ("y", None, None, "d1")}


def test_activation_and_dashboard(spark):
    rows = spark.createDataFrame([("o", "1", "active"), ("o", "2", "ready"), ("o", "3", "building"), ("p", "1", "active")], "org string, version string, status string")
    after = lambda v: sorted(tuple(r) for r in versions.activated(rows, spark.createDataFrame([("o", v)], "org string, version string")).collect())
    assert after("2") == [("o", "1", "superseded"), ("o", "2", "active"), ("o", "3", "building"), ("p", "1", "active")]
    assert after("3") == sorted(tuple(r) for r in rows.collect())
    empty = spark.createDataFrame([], "tokens long, incremental long, full long")
    assert tuple(evaluation.dashboard(empty, spark.createDataFrame([], "doc long")).first()) == (0, 0, 0.0, 0.0)


def test_arbitration_against_all_pairs(spark):
    rng = random.Random(4)
    for relation_days in (3, 12):
        rows = [(i, rng.randrange(3), rng.choice("ab"), rng.choice("xyz"), rng.choice([None, *range(relation_days)]), rng.choice([None, "s", "t", "u"]), rng.choice([None, None, 9])) for i in range(400)]
        policies = [("a", "single_current"), ("*", "append")]
        want = {}
        for i, h, r, t, d, s, end in rows:
            later = [d2 for _, h2, r2, t2, d2, s2, _ in rows if (h2, r2) == (h, r) and t2 != t and None not in (d, d2) and d2 > d and not (s is not None and s == s2)]
            if r == "a" and end is None and later:
                want[i] = min(later)
        facts = spark.createDataFrame(rows, "fact_id int, head int, relation string, tail string, valid_from int, source string, valid_to int")
        got = temporal.superseded(facts, spark.createDataFrame(policies, "relation string, policy string"))
        assert {r.fact_id: r.expires_at for r in got.collect()} == want


def test_nearest_keeps_few():
    rng = random.Random(1)
    for _ in range(300):
        entries = [(d, rng.randrange(4), rng.randrange(4)) for d in range(30)]
        kept = temporal.nearest(entries)
        assert len(kept) <= 4
        for t in range(4):
            for s in range(4):
                first = lambda es, t=t, s=s: next((d for d, x, y in es if x != t and y != s), None)
                assert first(kept) == first(entries)


def test_same_anchor(spark):
    rows = [(1, "h", "r", "x", "d", 1, 1), (2, "h", "r", "y", "d", 5, 2), (3, "h", "r", "x", "d", 5, 3), (4, "g", "r", "x", "d", 1, 1), (5, "g", "r", "y", "d", None, 2), (6, "k", "r", "x", None, 1, 1), (7, "k", "r", "y", None, 2, 2), (8, "l", "other", "x", "d", 1, 1), (9, "l", "other", "y", "d", 2, 2), (10, "m", "r", "x", "d", 1, 1)]
    facts = spark.createDataFrame(rows, "fact_id int, head string, relation string, tail string, valid_from string, tail_position int, ordinal int")
    got = temporal.same_anchor(facts, spark.createDataFrame([("r", "single_current")], "relation string, policy string"))
    assert [tuple(r) for r in got.collect()] == [(2, "d")]  # of equal positions the later ordinal stays, and with it all of its tail


def test_streak_counts_repeats_as_breaks(spark):
    def brute(days):
        best = (1, days[0], days[0])
        run, start = 1, days[0]
        for a, b in zip(days, days[1:]):
            run, start = (run + 1, start) if b - a == 1 else (1, b)
            best = max(best, (run, start, b), key=lambda x: x[0])
        return best

    rng = random.Random(2)
    data = {w: sorted(rng.choices(range(14), k=rng.randint(1, 16))) for w in range(60)}
    rows = [(w, datetime.date(2024, 1, 1) + datetime.timedelta(d)) for w, ds in data.items() for d in ds]
    got = rules.longest_streak(spark.createDataFrame(rows, "who int, day date"), "who", "day", 1)
    first = datetime.date(2024, 1, 1)
    assert {r.who: (r.days, (r.first_day - first).days, (r.last_day - first).days) for r in got.collect()} == {w: brute(ds) for w, ds in data.items()}


def test_plain_and_column_forms_agree(spark):
    texts = ["SO-2026.09/x_1 and ab 中文分词 一 二三 d.e.", "", "Ünïcode ß İ 汉", "A1b2" * 50, "...--"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", text.tokens(F.col("t")).alias("w"), F.size(text.bigrams(F.col("t"))).alias("g")).orderBy("n").collect()
    assert [r.w for r in rows] == [text.token_list(t) for t in texts]
    assert [r.g for r in rows if r.n != 2] == [len(text.bigram_codes(t)) for i, t in enumerate(texts) if i != 2]


def test_hash_embedding(spark):
    rows = spark.createDataFrame([("ab",), ("",), ("xyxy",), (None,)], "t string").select(text.hash_embedding(F.col("t"), 16).alias("v")).collect()
    assert all(len(r.v) == 16 and abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in rows)
    assert sum(x != 0 for x in rows[0].v) == 1


def test_fail_closed():
    for bad in ("2024-1-1", "20240101", "x"):
        with pytest.raises(ValueError):
            scope.as_of_day(bad)
    with pytest.raises(ValueError):
        scope.strict_tenant(F.lit("a"), None)


def test_missing_things_raise(spark):
    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, text string")
    assert evidence.chunk(chunks, "c1").count() == 1
    with pytest.raises(LookupError):
        evidence.chunk(chunks, "c2")
    answers = spark.createDataFrame([(1, "a"), (9, "b")], "index int, answer string")
    with pytest.raises(Exception, match="no question for answer 9"):
        evaluation.sheets(answers, spark.createDataFrame([(1, "q")], "index int, question string")).collect()
    with pytest.raises(Exception, match="no dated fact"):
        rules.observation_day(spark.createDataFrame([], "date date")).collect()
    with pytest.raises(KeyError):
        text.masked(F.lit("x"), "unknown", "s")


def test_evidence_quota_against_a_loop(spark):
    """Floors by document in order, cut or filled up as the selection is defined, with chunks that two documents hold."""

    def brute(rows, limit):
        key = lambda r: (-r[2], -r[3], r[5], r[0])
        docs = sorted({r[1] for r in rows if r[1]})
        floor = max(limit // len(docs), 1) if docs else limit
        sure = sorted((r for d in docs for r in sorted((x for x in rows if x[1] == d), key=key)[:floor]), key=key)
        if len(sure) >= limit:
            return [r[0] for r in sure[:limit]]
        rest = sorted((r for r in rows if r[0] not in {s[0] for s in sure}), key=lambda r: (-r[2], r[4] <= 0, -r[3], r[5], r[0]))
        return [r[0] for r in (sure + rest)[:limit]]

    rng = random.Random(5)
    for limit in (1, 3, 8, 40):
        rows = sorted({(f"c{c:02d}", rng.choice([None, "d1", "d2", "d3", "d4"])) for c in [rng.randrange(30) for _ in range(45)]}, key=str)
        facts = {c: (rng.choice([0.0, 0.5, 1.0]), rng.randrange(3), rng.randrange(2), rng.randrange(4)) for c, _ in rows}
        full = [(c, d, *facts[c]) for c, d in rows]
        df = spark.createDataFrame([(1, *r) for r in full], "question_id int, chunk_id string, doc_id string, score double, mentions int, spans int, char_start int")
        got = [r.chunk_id for r in evidence.selected(df, limit).orderBy("rank").collect()]
        assert got == brute(full, limit)


def test_chunks_against_a_scan(spark, tiny):
    def cut(text, most):
        out, at = [], 0
        while True:
            end = min(at + most, len(text))
            if end < len(text):
                fits = [i for i in range(at, end) if text[i] == "。" or i + 1 < end and text[i : i + 2] in ("\n\n", ". ")]
                if fits and fits[-1] > at + most // 2:
                    end = fits[-1] + 1
            out.append((len(out), at, text[at:end]))
            at = end
            if at >= len(text):
                return out

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()} | {-1: None, -2: "", -3: "。" * 95, -4: "a. " * 60, -5: "\n" * 99, -6: "x" * 41}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (40, 800):
        got = {}
        for r in documents.chunked(docs, most).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append((r.chunk_no, r.char_start, r.chunk))
        assert got == {i: cut(t or "", most) for i, t in texts.items()}


def test_bounds_close_the_tail(spark):
    cases = [(0, 10), (10, 10), (3, 10), (1, 1), (0, 0), (57, 200)]
    tail = lambda p, ks, n: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
    for r in spark.createDataFrame(cases, "k int, n int").select("k", "n", evaluation.exact_bounds(F.col("k"), F.col("n")).alias("b")).collect():
        k, n, (lo, hi) = r.k, r.n, r.b
        if n == 0:
            assert lo is None and hi is None
            continue
        assert lo == 0 if k == 0 else abs(tail(lo, range(k, n + 1), n) - 0.05) < 1e-9
        assert hi == 1 if k == n else abs(tail(hi, range(k + 1), n) - 0.05) < 1e-9


def test_resolution_with_ratio_against_all_pairs(spark, tiny):
    names = sorted({f"{r.p_name} {r.p_type.lower()}" for r in spark.read.parquet(f"{tiny}/part.parquet").collect()})
    grams = {n: {n[i : i + 2] for i in range(len(n) - 1)} for n in names}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a[:2] == b[:2]:
                near = round(max(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), SequenceMatcher(None, a, b).ratio()), 6)
                if near >= 0.7:
                    want[a, b] = near
    got = {(r.left_name, r.right_name): r.similarity for r in relations.entity_resolution_with_ratio(spark, tiny).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_layout_coverage(spark):
    flat = json.dumps([{"text": "aa", "page_idx": 0}, {"text": "lost", "page_idx": 0}, {"text": "no page"}, {"text": "bb", "page_idx": 1}])
    docs = spark.createDataFrame([(1, "aa bb", flat), (2, "aa", "[]")], "doc_id long, text string, layout string")
    got = {r.doc_id: (r.total, r.matched, r.coverage) for r in layout.coverage(docs, layout.page_spans(docs)).collect()}
    assert got == {1: (3, 2, 0.6667), 2: (0, 0, 0.0)}


def test_secrets_are_redacted(spark):
    lines = spark.createDataFrame([("DB_PASSWORD=abc=d",), ("  api_key = x",), ("PORT=80",), ("TOKENS",)], "l string")
    assert [r[0] for r in lines.select(text.redacted(F.col("l"))).collect()] == ["DB_PASSWORD=***", "  api_key =***", "PORT=80", "TOKENS"]
    assert [r[0] for r in lines.select(text.bigrams(F.lit("Ab-b中a"))).limit(1).collect()] == [["ab", "bb", "b中", "中a"]]


def test_gain_is_undefined_without_a_baseline(spark):
    rows = spark.createDataFrame([(1.0, 0.875), (1.0, 0.0), (None, 0.5)], "s double, b double")
    assert [r[0] for r in rows.select(F.round(evaluation.gain(F.col("s"), F.col("b")), 6)).collect()] == [0.142857, None, None]


def test_merged_aliases_keep_their_order(spark):
    nodes = spark.createDataFrame([(1, "L", ["z", "a"], 0.3), (2, "R", ["a", " ", "k"], 0.9), (3, "X", [], 0.1)], "id long, name string, aliases array<string>, confidence double")
    edges = spark.createDataFrame([(2, 3, "e"), (1, 3, "e"), (1, 2, "e")], "src long, dst long, kind string")
    kept, moved = versions.merge_entities(nodes, edges, 1, 2)
    assert {r.id: (r.aliases, r.confidence) for r in kept.collect()} == {1: (["z", "a", "R", "k"], 0.9), 3: ([], 0.1)}
    assert [tuple(r) for r in moved.collect()] == [(1, 3, "e")]


def test_only_what_was_given_is_cited(spark):
    chunks = spark.createDataFrame([("chunk-1", 10, 0, " " + "a b" * 100, 4), ("chunk-2", 10, 400, "short", None)], "chunk_id string, doc_id long, char_start long, text string, page int")
    spans = spark.createDataFrame([], "chunk_id string, mention string, char_start long, char_end long")
    answers = spark.createDataFrame([(1, ["chunk-1", "chunk-2"]), (2, ["chunk-1", "chunk-2"])], "answer_id long, evidence array<string>")
    given = spark.createDataFrame([(1, "chunk-1"), (2, "chunk-2"), (2, "chunk-2"), (2, "chunk-7")], "answer_id long, chunk_id string")
    got = {(r.answer_id, r.chunk_id, r.page, r.snippet) for r in citations.located(answers, chunks, spans, given).collect()}
    assert got == {(1, "chunk-1", 4, ("a b" * 100)[:200] + "…"), (2, "chunk-2", None, "short")}


@pytest.mark.parametrize("lot_chars", [10**9, 60])
def test_names_in_texts(spark, lot_chars):
    rng = random.Random(3)
    names = [None, "", "a", "ab", "abab", "b🙂", "🙂", *{"".join(rng.choice("abc🙂 ") for _ in range(rng.randint(1, 6))) for _ in range(40)}]
    texts = [(i, "".join(rng.choice("abc🙂 ") for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "a"), (62, "🙂")]
    known = spark.createDataFrame([(n,) for n in [*names, "ab"]], "name string")
    got = [tuple(r) for r in substrings.occurring(spark.createDataFrame(texts, "id long, text string"), known, "id", lot_chars=lot_chars).collect()]
    want = {(i, n) for i, t in texts for n in names if t and n and n in t}
    assert set(got) == want and len(got) == len(want)


def test_bridge_over_many_systems(spark):
    """No cap on the systems: the clause names the last of them."""
    systems = spark.range(20_000).select("id", F.concat(F.lit("s"), F.col("id") + 10_000).alias("name")).withColumnRenamed("id", "system_id")
    clauses = spark.createDataFrame([("c1", 1, "by s29999 and s10001"), ("c2", 1, "none"), (" ", 1, "s29999")], "clause_id string, doc_id long, text string")
    windows = spark.createDataFrame([("c1", "2024-01-01", None)], "clause_id string, valid_from string, valid_to string")
    document = spark.createDataFrame([], "doc_id long, valid_from string, valid_to string")
    for lot in (10**9, 20_000):
        edges = rules.bridged(clauses, systems, windows, document, lot_chars=lot)
        assert sorted((r.clause_id, r.system_id, r.origin) for r in edges.where("system_id is not null").collect()) == [("c1", 1, "inherited"), ("c1", 19_999, "inherited")]
        assert {r.what: r.n for r in rules.bridge_counts(edges).collect()} == {"unmatched": 1, "inherited": 2, "system:1": 1, "system:19999": 1}


def test_clause_paragraphs(spark):
    """A place in the middle, at the start, in another block, none, and past the end."""
    texts = ["头一段\n\n第十一条 适用标准工时制的岗位。\n\n尾段", "第一条 综合工时制"]
    rows = spark.createDataFrame([("a", texts[0], 5, 9), ("b", texts[1], 0, 3), ("c", texts[0], 0, 3), ("d", texts[0], None, None), ("e", texts[1], 5, 500)], "id string, text string, start int, end int")
    got = {r.id: r.p for r in rows.select("id", rules.clause_text(F.lit("n"), F.lit(None).cast("string"), rules.paragraph(F.col("text"), F.col("start"), F.col("end"))).alias("p")).collect()}
    assert got == {"a": "n  第十一条 适用标准工时制的岗位。", "b": "n  第一条 综合工时制", "c": "n  头一段", "d": "n ", "e": "n "}


@pytest.mark.parametrize("limit", [1, 4, 9])
def test_covering_rows_are_all_that_can_be_selected(spark, limit):
    """Groups with few and many rows and none, keys in several groups, ties, nulls, a question without bigrams; lots far smaller than the table."""
    rng = random.Random(limit)
    docs = [(rng.choice([None, "a", "b", *"cdefgh"]), rng.randint(0, 50), "".join(rng.choice("abc ") for _ in range(rng.choice([0, 3, 9]))) or None, rng.choice([None, 1, 2]), rng.choice([0, 1, None]), rng.choice([None, 3, 4])) for _ in range(150)]
    rows = spark.createDataFrame(sorted({(d[0], d[1]): d for d in docs}.values(), key=str), "grp string, id long, text string, mentions long, spans long, char_start long").repartition(3)
    asked = spark.createDataFrame([(1, "abcab"), (2, "cc"), (3, "-"), (4, None)], "item_id long, text string")
    wanted = evidence.selected(_all_pairs(rows, asked), limit, "item_id", "grp", "id")
    got = evidence.selected(retrieval.covering(rows, asked, limit, "grp", "id", lot=7), limit, "item_id", "grp", "id")
    of = lambda df: sorted((r.item_id, r["rank"], r.id, str(r.grp), r.sure, round(r.score, 6)) for r in df.collect())
    assert of(got) == of(wanted)


def _all_pairs(rows, asked):
    grams = lambda c: text.bigrams(F.coalesce(F.col(c), F.lit("")))
    pairs = rows.withColumn("g", grams("text")).crossJoin(asked.select("item_id", grams("text").alias("q")))
    share = F.when(F.size("q") > 0, F.round(F.size(F.array_intersect("g", "q")) / F.size("q"), 6)).otherwise(0.0)
    return pairs.select("item_id", "grp", "id", share.alias("score"), "mentions", "spans", "char_start")


@pytest.mark.parametrize("block", [3, 2048])
def test_nearest_vectors(spark, block):
    """Ragged and zero vectors, nulls, equal vectors, and blocks so small that bounds and the grid count."""
    rng = random.Random(block)
    near = [[rng.gauss(3 * (i % 3), 0.2), rng.gauss(0, 0.2), rng.gauss(i % 2, 0.2)] for i in range(60)]
    every = [*near, [0.0, 0.0], [], [1.0], [1.0, 2.0], [1.0, 2.0, 0.0, 0.0], None, [2.0, 4.0], [-1.0, 0.5, 0.0, 3.0, 1.0], [None, 1.0]]
    df = spark.createDataFrame(list(enumerate(every)), "vec_id long, embedding array<double>")
    plain = {i: [x or 0.0 for x in v] for i, v in enumerate(every) if v is not None}

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=False)) / size if size else 0.0

    got = {}
    for r in vectors.dense_topk(df, df.where("vec_id % 2 = 0"), 4, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {i for i in plain if i % 2 == 0}
    for i, found in got.items():
        want = sorted(((cosine(plain[i], v), j) for j, v in plain.items() if j != i), key=lambda x: (-round(x[0], 9), x[1]))[:4]
        assert [round(s, 9) for _, _, s in sorted(found)] == [round(s, 9) for s, _ in want]


def test_index_search_against_all_scores(spark):
    """Segments and blocks far smaller than the table, so that bounds cut; ties, empty and null texts, repeated terms; a kept index is searched again."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, weights=range(1, 13), k=rng.choice([0, 1, 4, 30]))) for _ in range(120)] + [None, "漢字仮名 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(1, "w0 w3 W3"), (2, "w11"), (3, "none"), (4, None), (5, " ".join(words)), (6, "漢字")], "item_id long, text string")
    path = shared_path(spark, "index")
    lexical_index.build(docs, path, block=3)
    index = lexical_index.opened(spark, path)
    got = {}
    for r in retrieval.top(lexical_index.search(index, asked, 5), "item_id", F.round("score", 6), "doc_id", 5).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id))
    of = [text.token_list(t or "") for t in texts]
    mean, want = sum(map(len, of)) / len(of), {}
    for i, q in ((r.item_id, set(text.token_list(r.text or ""))) for r in asked.collect()):
        scores = []
        for d, found in enumerate(of):
            s = 0.0
            for t in q & set(found):
                df, tf = sum(t in x for x in of), found.count(t)
                s += math.log(1 + (len(of) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(found) / mean))
            if q & set(found):
                scores.append((-round(s, 6), d))
        if scores:
            want[i] = [(n, d) for n, (_, d) in enumerate(sorted(scores)[:5], start=1)]
    assert {i: sorted(x) for i, x in got.items()} == want


@pytest.mark.parametrize("with_ratio", [False, True])
def test_similar_names_in_one_large_block(spark, with_ratio):
    """5,000 names that share their beginning (fewer with the ratio, which brute force is slow at): all pairs that brute force finds, from few candidates."""
    rng, n = random.Random(9), 700 if with_ratio else 4600
    stems = ["ab" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(6, 14))) for _ in range(n)]
    names = sorted({*stems, *(s[:5] + rng.choice("xyz") + s[6:] for s in stems[:200]), *(s + "q" for s in stems[200:400])})
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(r.left_name, r.right_name) for r in alignment.candidates(df, with_ratio=with_ratio).select("left_name", "right_name").collect()}
    grams = {n: {n[i : i + 2] for i in range(len(n) - 1)} for n in names}
    changed = {(min(a, b), max(a, b)) for a, b in [*((s, s[:5] + c + s[6:]) for s in stems[:200] for c in "xyz"), *((s, s + "q") for s in stems[200:400])] if a != b and a in grams and b in grams}
    near = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.7 or with_ratio and SequenceMatcher(None, a, b).ratio() >= 0.7
    assert {p for p in changed if near(*p)} <= got and all(near(*p) for p in got)
    if not with_ratio:
        of = {}
        for n in names:
            for g in grams[n]:
                of.setdefault(g, []).append(n)
        some = rng.sample(names, 150)
        want = {(min(a, b), max(a, b)) for a in some for b in {x for g in grams[a] for x in of[g]} if a != b and near(a, b)}
        assert want == {p for p in got if p[0] in some or p[1] in some}
    block = df.select(F.substring("name", 1, 2).alias("block"), F.col("name").alias("key"), text.name_bigrams(F.col("name")).alias("grams"), "name")
    assert alignment.near_names(block, None, 0.7, False).count() < len(names) ** 2 / 100


@pytest.mark.parametrize("tile", [3, 1000])
def test_pairs_by_tiles(spark, tile):
    rng = random.Random(tile)
    edges = [(rng.randint(0, 40), rng.choice(["hot", "hot", "hot", "a", "b", None]), None, None) for _ in range(120)] + [(None, "hot", None, None)]
    df = spark.createDataFrame(edges, "src long, dst string, valid_from date, valid_to date")
    got = [tuple(r) for r in patterns.shared_pairs(df, temporal=False, tile=tile).collect()]
    of = {d: sorted({s for s, x, *_ in edges if x == d and s is not None}) for d in ("hot", "a", "b")}
    assert sorted(got) == sorted((a, b, d) for d, members in of.items() for a in members for b in members if a < b)


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = {r.nth: r.x for r in projection.numbered(rows.orderBy("x")).collect()}
    assert got == {i + 1: i for i in range(1000)}
    assert projection.numbered(rows.where("x < 0").orderBy("x")).collect() == []


def test_records_without_a_key_meet_nothing(spark):
    records = spark.createDataFrame([(i, None if i % 3 else "t1", None if i % 2 else "n2") for i in range(12)], "id long, tax_id string, name string")
    subjects = spark.createDataFrame([(1, "t1", None), (2, None, "n2"), (3, None, "n2")], "sid long, tax_id string, name string")
    got = {r.id: (r.level, r.aligned_id, r.reason) for r in alignment.cascade(records, subjects, ["tax_id", "name"], "sid").collect()}
    assert got == {i: ("tax_id", 1, None) if i % 3 == 0 else (None, None, "multiple_candidates") if i % 2 == 0 else (None, None, "key_missing") for i in range(12)}


def test_matches_against_each_pair(spark):
    """All tiers, equal names, odd names and queries, Han terms; against the score of each pair, for a limit and for all."""
    rng = random.Random(6)
    names = [None, "", " ", "a", "ab", "工时", "标准工时制", "abcd", *("".join(rng.choice("abc 工时制标") for _ in range(rng.randint(1, 5))) for _ in range(60))]
    asked = [None, "", "  ", "ab", " abcd ", "标准工时制是什么", "ab，工时 abc", *("".join(rng.choice("abc 工时制标，") for _ in range(rng.randint(1, 9))) for _ in range(25))]
    n = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    score = text.match_score(F.col("name"), F.col("query"), text.terms(F.col("query")))
    pairs = n.crossJoin(q).withColumn("score", score).where("score is not null")
    for limit in (3, 100):
        want = {(r.query_id, r["rank"], r.id, r.score) for r in retrieval.top(pairs, "query_id", F.col("score"), "id", limit).collect()}
        assert {(r.query_id, r["rank"], r.id, r.score) for r in retrieval.matches(n, q, limit).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_best_paths_without_all_walks(spark, seed):
    """Random graphs with parallel edges, loops back to the start, hubs, open and missing days: the same path as ranking all walks."""
    rng = random.Random(seed)
    day = lambda: rng.choice([None, *(datetime.date(2020, 1, d) for d in (1, 9, 20))])
    nodes = [(f"n{i}", rng.choice(["A", "B", "C", "H"])) for i in range(12)]
    edges = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("xy")) for _ in range(22)})
    e = spark.createDataFrame([(*x, day(), day()) for x in edges], "src string, dst string, kind string, valid_from date, valid_to date")
    n, starts = spark.createDataFrame(nodes, "id string, type string"), spark.createDataFrame([(f"n{i}",) for i in range(12)], "id string")
    priority = F.when(F.col("terminal_type") == "A", 0).otherwise(1)
    rank = F.when(F.col("terminal_type") == "B", 0).otherwise(1)
    at = F.lit("2020-01-10").cast("date")
    of = lambda df: sorted((r.start, tuple(r.ids), r.hops, r.verdict, r.proven, r.terminal_type) for r in df.collect())
    assert of(paths.search_best(starts, e, n, priority, rank, at, 3, "H")) == of(paths.best(paths.paths(starts, e, n, 3, "H"), priority, rank, at))
