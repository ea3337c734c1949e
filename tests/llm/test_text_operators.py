"""Each text operator against a brute-force version, a round trip or held-out labels, and its behaviour on odd input."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vestigraph.llm import chat, common, decontaminate, exact_dedup, fill_middle, html_text, langid, merkle, packing, pii, simhash, token_counts, toxicity, warc
from vestigraph.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null ids and texts, empty and blank ones, repeated rows, controls, a long word, a long text.
ODD_TEXTS = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b c d"), (4, "a b c d"), (5, "a b c d"), (None, "x"), (6, None), (7, "\x1cA\x1db é"), (8, "w" * 5000), (9, "one two three " * 3000), (10, "ΑΒΓ 漢字 🙂")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in ODD_TEXTS], DOCS + ", piece int, digest string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(spark, tiny, name="documents"):
    return spark.read.parquet(f"{tiny}/{name}.parquet").collect()


# packing


def brute_ids(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(packing.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check_packing(result, texts):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in result:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for slots in by_seq.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
    want = Counter()
    for doc_id, text in texts:
        ids = brute_ids(text)
        for p in range(-(-len(ids) // 4096)):
            part = ids[p * 4096 : (p + 1) * 4096]
            want[doc_id, p, p * 4096, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in result)
    total = sum(r.length for r in result)
    assert len(by_seq) <= -(-total // 4096) * 1.1 + 1


def test_packing(spark, tiny):
    check_packing(q.op1_best_fit_packing(spark, tiny).collect(), [(r.doc_id, r.text) for r in rows(spark, tiny)])


def test_packing_odd(spark, odd, empty):
    check_packing(packing.pack(odd).collect(), ODD_TEXTS)
    assert packing.pack(empty).collect() == []


def test_exact_multiple_of_capacity(spark, empty):
    word = "a"
    docs = spark.createDataFrame([(1, " ".join([word] * 4096), None, None, 0), (2, " ".join([word] * 4095), None, None, 0)], DOCS)
    check_packing(packing.pack(docs).collect(), [(1, " ".join([word] * 4096)), (2, " ".join([word] * 4095))])


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = 50
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    runs = packing.plan(Counter(lengths), capacity)
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, seq, per, offset in runs:
        ranks[length] += range(rank, rank + n)
        for k in range(n):
            filled[seq + k // per].append((offset + k % per * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in Counter(lengths).items()}
    for slots in filled.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == len(rooms)


# pages


def brute_article(page):
    """The article of a page of the table, by its tags alone."""
    import html

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h[1-6]|ul|li|div|blockquote)[^>]*>", inner))
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_html_against_tags_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in rows(spark, sf, "pages")}
    got = {r.page_id: r for r in q.op2_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        assert got[i].n_chars == len(got[i].text) and got[i].text == brute_article(page)


_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul>'
_P = "The river was low that summer, and the boats lay in the mud for weeks. Nobody in the village remembered a year like it."
_Q = "In August the council met twice. It agreed to dredge the harbour before winter, and to ask the ministry for help with the costs."
_R = "Old people said that rain would come after the feast, as it always did."
#: Pages of fourteen layouts, most of which say nowhere where the article is, with their text.
HAND_MADE = {
    "bare": (f"<html><body><p>{_P}</p><p>{_Q}</p></body></html>", [_P, _Q]),
    "id": (f"<body><nav>{_MENU}</nav><div id=main><p>{_P}</p><p>{_Q}</p></div><footer>&copy; 2020 Village News</footer></body>", [_P, _Q]),
    "nameless": (f"<body><div class=menu>{_MENU}</div><div><h1>A dry summer</h1><p>{_P}</p><p>{_Q}</p><p>{_R}</p></div><div class=footer>Copyright 2020. All rights reserved.</div></body>", ["A dry summer", _P, _Q, _R]),
    "table": (f"<body><table><tr><td>{_MENU}</td><td><p>{_P}</p><p>{_Q}</p></td></tr></table></body>", [_P, _Q]),
    "code": (f"<body><nav>{_MENU}</nav><article><h1>T</h1><p>{_P} <math><mi>a</mi><mo>=</mo><mi>b</mi></math> {_R}</p><pre>make all\n  make install</pre><p>{_Q}</p></article></body>", ["T", f"{_P} a=b {_R}", "make all make install", _Q]),
    "invented names": (f'<body><header><h1>The Gazette</h1>{_MENU}</header><div class="x7 q"><h2>A dry summer</h2><p>{_P}</p><p>{_Q}</p><blockquote>{_R}</blockquote></div><aside><h3>Related</h3><ul><li><a href=1>Storm warnings</a></li></ul></aside></body>', ["A dry summer", _P, _Q, _R]),
    "lines": (f"<body>{_MENU}<div>{_P}<br><br>{_Q}<br>{_R}</div></body>", [_P, _Q, _R]),
    "comments": (f"<body><main><p>{_P}</p><p>{_Q}</p></main><section id=comments><h2>Comments</h2><div class=comment><p>I like this very much, thanks for writing it up.</p></div></section></body>", [_P, _Q]),
    "cookies": (f'<body><div class="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div><div><p>{_P}</p><p>{_Q}</p></div><form><label>Subscribe</label><input><p>Get our letter every week.</p></form></body>', [_P, _Q]),
    "sections": (f"<body><nav>{_MENU}</nav><section><h1>A dry summer</h1><p>{_P}</p></section><section><h2>Council</h2><p>{_Q}</p><ul><li>{_R}</li><li>It did not.</li></ul></section><footer><p>Imprint</p></footer></body>", ["A dry summer", _P, "Council", _Q, _R, "It did not."]),
    "one": (f"<p>{_P}", [_P]),
    "data": (f"<body><article><h1>Levels</h1><p>{_P}</p><table><tr><th>Month</th><th>Level</th></tr><tr><td>June</td><td>120 cm</td></tr></table><p>{_Q}</p></article><footer>{_MENU}</footer></body>", ["Levels", _P, "Month", "Level", "June", "120 cm", _Q]),
    "terms": (f"<body><div class=nav>{_MENU}</div><div class=ad>Buy our boats today!</div><div><h1>Words</h1><dl><dt>Mud</dt><dd>{_P}</dd><dt>Rain</dt><dd>{_R}</dd></dl><p>{_Q}</p></div></body>", ["Words", "Mud", _P, "Rain", _R, _Q]),
    "figure": (f"<body><div id=top><p>The Gazette</p></div><main><h1>A dry summer</h1><figure><img src=a.png><figcaption>The harbour at low water</figcaption></figure><p>{_P}</p><p>{_Q}</p></main></body>", ["A dry summer", "The harbour at low water", _P, _Q]),
}


def test_html_on_hand_made_layouts():
    field = html_text.train()
    for name, (page, want) in HAND_MADE.items():
        got, words = Counter(html_text.main_text(field, page).split()), Counter(" ".join(want).split())
        both = sum((got & words).values())
        assert both and 2 * both / (sum(got.values()) + sum(words.values())) >= 0.95, name


def test_html_on_unseen_layouts():
    field = html_text.train()
    right = total = 0
    for html, truth in html_text.labelled_pages(200, seed=99):
        blocks = html_text.leaf_blocks(html)
        for b, y in zip(blocks, field.viterbi(html_text.features(blocks)), strict=True):
            right += y == (b[0] in truth)
            total += 1
    assert right / total > 0.985


def test_html_odd(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (2, "u", "", 3), (2, "u", "", 3), (3, "u", "<article><p>A &amp; b&nbsp; c<br>d<p>Second one here, with words.<div class=ad>Buy</div", 3), (None, "u", "<p>x", 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == 5
    by = {r.page_id: r.text for r in got}
    assert by[1] == "" and by[2] == ""
    assert by[3].startswith("A & b c d\nSecond one here, with words.")
    long = html_text.extract(spark.createDataFrame([(1, "u", "<article>" + f"<p>{_P}</p>" * 20_000 + "</article>")], "page_id long, url string, html string")).first()
    assert long.text == "\n".join([_P] * 20_000)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(20):
        field = html_text.Field()
        n = int(rng.integers(1, 7))
        field.weights = {str(i): float(rng.normal()) for i in range(n)}
        field.moves = rng.normal(size=(2, 2))
        feats = [[str(i)] for i in range(n)]

        def total(path, field=field):
            return sum(field.weights[str(i)] for i, y in enumerate(path) if y) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

        best = max((tuple(int(c) for c in f"{k:0{n}b}") for k in range(2**n)), key=total)
        assert tuple(field.viterbi(feats)) == best


# decontamination


def brute_hits(text, items, window=10):
    low = lambda t: [m for m in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    words = low(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = low(item)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_odd(spark, odd, empty):
    items = [(1, "a b c"), (2, None), (3, ""), (4, "one two three one two three one two three one two three"), (5, "A"), (5, "A"), (6, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (500_000, 1):
        got = Counter(tuple(r) for r in decontaminate.report(odd, bench, most=most).collect())
        assert got == Counter((i, *brute_hits(t, items)) for i, t in ODD_TEXTS)
    assert decontaminate.report(empty, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.report(odd, bench.limit(0)).collect())


@pytest.mark.parametrize("seed", range(8))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(6)]
    machine = decontaminate.Automaton([(str(i), decontaminate.words_of(t)) for i, t in items], window=4)
    for _ in range(30):
        doc = text(rng.randint(0, 40))
        spans, found = machine.match(decontaminate.words_of(doc))
        hit = sum(b - a for a, b in decontaminate.joined(spans))
        want = brute_hits(doc, items, window=4)
        assert (hit, len(found)) == want[1:3]


def test_clean_cuts_spans(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before it, {'pad ' * 40}{item.upper()}! And after", "en", "s", 9), (2, item, "en", "s", 9), (3, "clean", "en", "s", 5), (4, None, None, None, None)], DOCS)
    got = {r.doc_id: r for r in decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4}
    assert got[3].text == "clean" and got[3].n_chars == 5 and got[4].text is None
    assert "w5" not in got[1].text.lower() and got[1].text.startswith("Before it") and got[1].text.endswith("And after") and got[1].n_chars == len(got[1].text)


def test_clean_in_groups_and_on_odd_tables(spark, odd, empty):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(14))) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pad = "plain text that nobody tests " * 8
    rows = [(1, pad + items[0][1] + " and " + items[3][1]), (1, pad + items[0][1] + " and " + items[3][1]), (2, items[2][1]), (3, pad), (None, pad + items[4][1]), (4, None), (5, (pad * 300 + items[1][1] + " ") * 3)]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, digest int, spans int")
    want = None
    for most in (500_000, 30, 1):
        got = decontaminate.clean(docs, bench, most=most)
        assert got.columns == docs.columns
        found = Counter(tuple(r) for r in got.collect())
        assert want is None or found == want
        want = found
    assert Counter(i for i, *_ in want.elements()) == {1: 2, 3: 1, None: 1, 4: 1, 5: 1}
    assert not any(re.search(r"w\dx\d", t or "") for _, t, *_ in want)
    assert decontaminate.clean(empty, bench).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    plan = decontaminate.clean(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_automaton_is_small():
    rng = random.Random(3)
    items = [(str(i), [b"w%d" % rng.randrange(5000) for _ in range(100)]) for i in range(300)]
    machine = decontaminate.Automaton(items)
    flat = sum(x.itemsize * len(x) for x in (machine.link, machine.length, machine.top, machine.first, machine.words, machine.target, machine.item_first, machine.item))
    assert flat < 80 * 30_000


# simhash


def brute_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = [i for i, _ in fps]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                x, y = find(fps[a][0]), find(fps[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, tiny):
    docs = rows(spark, tiny)
    fps = [(r.doc_id, brute_simhash(r.text)) for r in docs]
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op4_simhash(spark, tiny).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in fps}


def test_simhash_odd(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    fps = [(i, brute_simhash(t)) for i, t in ODD_TEXTS]
    comp = brute_components([(i, f) for i, f in fps if i is not None])
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in fps)
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_and_components_against_brute_force(spark, tile):
    rng = random.Random(tile)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(rng.randint(1, 12)):  # chains of one- and two-bit steps
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    comp = brute_components([(i, f & (2**64 - 1)) for i, f in signed])
    got = {r.id: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "id long, fp long"), tile)).collect()}
    assert {i: got.get(i, i) for i in comp} == comp


def test_close_at_lag():
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**63), 2**63, 300)
    for i in range(0, 280, 3):
        values[i + 7] = values[i] ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) ^ (int(rng.integers(2)) << 5)
    planes = simhash._planes(values)
    for lag in (1, 7, 63, 64, 65, 130):
        same = np.zeros(320, np.uint8)
        same[: 300 - lag] = 1
        got = simhash.close_at_lag(planes, lag, np.packbits(same, bitorder="little").view("<u8"))
        far = np.bitwise_count((values[: 300 - lag] ^ values[lag:]).view(np.uint64))
        assert got.tolist() == np.flatnonzero(far <= 2).tolist()
        for radius in (0, 1, 2, 7, 26, 31, 40):
            got = simhash.near_at_lag(planes, lag, np.packbits(same, bitorder="little").view("<u8"), radius)
            assert got.tolist() == np.flatnonzero(far <= radius).tolist()


# warc


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://www.b.example.org/x#f", "<p>é</p>", 0), (2, None, None, 0), (3, "https://a.example.org:8080/y?z=1", "<p>é</p>", 0), (4, "http://b.example.org/x", "", 0), (4, "http://b.example.org/x", "", 0), (5, "u\r\nInjected: 1", "z" * 300_000, 0)], "page_id long, url string, html string, key int")
    directory = warc.write_archives(pages, block_lines=2)
    report = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted((tuple(r[c] for c in report) for r in warc.lookup(directory, pages).collect()), key=str)
    assert sorted((tuple(r) for r in warc.archive_report(pages).collect()), key=str) == got
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 9, sha("<p>é</p>"), "revisit", 3), (2, 0, sha(""), "revisit", 4), (3, 9, sha("<p>é</p>"), "response", None), (4, 0, sha(""), "response", None), (4, 0, sha(""), "response", None), (5, 300_000, sha("z" * 300_000), "response", None)]
    assert got == sorted(want, key=str)
    found = warc.lookup(directory, spark.createDataFrame([("http://a.example.org/y?z=1",), ("https://b.example.org/x",), ("http://nowhere.example/",)], "url string")).collect()
    assert sorted((r.page_id, r.record_type, r.payload) for r in found) == [(1, "revisit", ""), (3, "response", "<p>é</p>"), (4, "response", ""), (4, "response", "")]
    assert warc.archive_report(pages.limit(0)).collect() == []


def test_warc_names_every_record_once(spark):
    rows = [(7, "http://a.example/", "x"), (7, "http://a.example/", "x"), (7, "http://b.example/", "x"), (3, "http://c.example/", "x"), (None, None, "y"), (None, None, "y"), (9, "http://a.example/", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.write_archives(pages, block_lines=2, partitions=3)
    headers = []
    for r in directory.collect():
        fs, path = warc.file_system(r["archive"])
        with fs.open_input_file(path) as f:
            headers += [warc.parse_record(f.read_at(size, at))[0] for _, _, at, size in warc._block(r["index"], r["at"], r["size"])]
    ids = [h["WARC-Record-ID"] for h in headers]
    assert len(set(ids)) == len(ids) == len(rows)
    for h in headers:
        if h["WARC-Type"] == "revisit":
            assert next(x for x in headers if x["WARC-Record-ID"] == h["WARC-Refers-To"])["WARC-Type"] == "response"
    assert Counter(tuple(r)[:1] for r in warc.archive_report(pages).collect()) == Counter((i,) for i, _, _ in rows)


# exact dedup


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup.dedup(odd, files_per_batch=1).collect()
    same = defaultdict(list)
    for i, t in ODD_TEXTS:
        same[t or ""].append(i)
    assert len(got) == len(ODD_TEXTS)
    for r in got:
        group = next(g for t, g in same.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None) and r.doc_id in group
    assert sum(r.kept for r in got) == len(same)
    assert exact_dedup.dedup(empty).collect() == []
    left = exact_dedup.without_copies(odd)
    assert left.columns == odd.columns and left.count() == len(same)


def test_exact_dedup_keeps_odd_columns(spark, empty, tmp_path):
    rows = [(1, "a", "f", 1, 2), (2, "a", "g", 3, 4), (None, None, "h", 5, 6), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, at_file string, at_row long, digest int")
    docs.write.parquet(f"file://{tmp_path}/docs")
    for df in (docs, spark.read.parquet(f"file://{tmp_path}/docs")):
        left = exact_dedup.without_copies(df)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
        assert exact_dedup.dedup(df).count() == 4
    assert exact_dedup.without_copies(empty).collect() == []


def test_exact_dedup_goes_on_where_it_was(spark, tmp_path):
    """A further run with the same folder reads only what was added to the log, and the state remembers the rest."""
    place = f"file://{tmp_path}/dedup"
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/docs")
    broken = docs.selectExpr("doc_id", "cast(raise_error('lost') as string) as text")
    with pytest.raises(Exception, match="lost"):  # a log that breaks off is not taken for the whole
        exact_dedup.dedup(broken, 1, place).collect()
    first = exact_dedup.dedup(spark.read.parquet(f"file://{tmp_path}/docs"), 1, place)
    want = sorted(tuple(r)[:5] for r in first.collect())
    again = exact_dedup.dedup(spark.read.parquet(f"file://{tmp_path}/docs"), 1, place)
    assert sorted(tuple(r)[:5] for r in again.collect()) == want and [r[2] for r in want] == [2, 1, 2]
    more = exact_dedup._SIGNED, [(bytearray(hashlib.sha256(b"a").digest()), 9, "later", 0)]
    spark.createDataFrame(more[1], more[0]).write.mode("append").parquet(f"{place}/log")
    groups = {bytes(r.digest): (r.group_size, r.stay.doc_id) for r in exact_dedup.run_stream(spark, place).collect()}
    assert groups == {hashlib.sha256(b"a").digest(): (3, 9), hashlib.sha256(b"b").digest(): (1, 2)}


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = exact_dedup.located(spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "c", "b", "b"])], "doc_id long, text string"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    got = exact_dedup._dedup(docs, 10).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 2, 2, False), (1, 5, 3, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True)]


# toxicity, language, chat: held-out labels


def held_out_rate(got, truth):
    return sum(a == b for a, b in ((got[i], y) for i, y in truth.items())) / max(1, len(truth))


def test_toxicity(spark):
    """Recall and precision on rows that were never learned from, for each language with enough of them."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in q.op6_toxicity(spark, sf).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    truth = [(r.doc_id, r.toxic) for r in rows(spark, sf, "labels") if got[r.doc_id].held_out]
    for of in ("en", "de", "es", "fr"):
        own = [(got[i].predicted, y) for i, y in truth if lang[i] == of]
        toxic = [p for p, y in own if y]
        marked = [y for p, y in own if p]
        assert len(toxic) >= 8 and sum(toxic) / len(toxic) >= 0.85 and sum(marked) / len(marked) >= 0.85, (of, sum(toxic), len(toxic), sum(marked), len(marked))
    # The curve says what it means: of the rows scored above a half most are toxic.
    sure = [y for i, y in truth if got[i].score > 0.5]
    assert sum(sure) / len(sure) > 0.85


def brute_features(text, words, stems):
    low = text.lower()
    found = re.findall(r"[^\W\d_]+", low)
    begins = [len(w) >= 4 and any(w[:k] in stems for k in (4, 5, 6)) for w in found]
    whole = [w in words for w in found]
    near = sum(any(whole[j] or begins[j] for j in range(max(0, i - 4), min(len(found), i + 5))) for i, w in enumerate(found) if w in toxicity.SECOND_PERSON)
    n = max(1, len(found))
    return {"words_hit": np.log1p(sum(whole)), "stems_hit": np.log1p(sum(begins)), "word_density": sum(whole) / n, "stem_density": sum(begins) / n, "near_you": near / n, "capitals": sum(c.isupper() for c in text) / max(1, len(text)), "exclaim": text.count("!") / max(1, len(text)), "log_words": np.log1p(len(found))}


@pytest.mark.parametrize("seed", range(3))
def test_features_against_plain_counts(seed):
    rng = random.Random(seed)
    lexicon = toxicity.Lexicon(frozenset({"idiot", "du", "xyz"}), frozenset({"stup", "dumbo", "bloede"}))
    kinds = toxicity.Kinds(lexicon)
    parts = ["you", "Du", "idiot", "IDIOT!", "stupid", "stu", "dumbox", "bloeder", "well", "é1", "a.b", "...", "xyz", "tú", "\n"]
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        got = dict(zip(toxicity.NAMES, toxicity.dense(text, kinds), strict=True))
        want = brute_features(text, lexicon.words, lexicon.stems)
        assert {k: got[k] for k in want} == pytest.approx(want), text


def plain_features(text, lexicon):
    """All features by patterns over the whole text, each as it is said."""
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low)
    whole, you = [w in lexicon.words for w in words], [w in toxicity.SECOND_PERSON for w in words]
    stems = [len(w) >= 4 and any(w[:k] in lexicon.stems for k in (4, 5, 6)) for w in words]
    near = sum(any(whole[max(0, i - 4) : i + 5] + stems[max(0, i - 4) : i + 5]) for i, x in enumerate(you) if x) if any(whole) or any(stems) else 0
    odd = [m.group() for m in re.finditer(r"[^\W\d_]+[@$*!#0-9]+[^\W\d_]+|(\w)\1{3,}", low)]
    ways = [{w.translate(str.maketrans("013457@$!", to)).strip("*#") for to in ("oleastasi", "oieastasi")} for w in odd] + [{w.replace(" ", "")} for w in re.findall(r"\b(?:\w ){3,}\w\b", low)]
    n, chars, letters, upper = max(1, len(words)), max(1, len(text)), max(1, sum(map(len, words))), sum(map(str.isupper, text)) if text != low else 0
    loud = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper else 0
    return [np.log1p(sum(whole)), np.log1p(sum(stems)), sum(whole) / n, sum(stems) / n, sum(any(map(lexicon.holds, x)) for x in ways) / n, near / n, sum(you) / n, upper / chars, loud / n, (chars - letters - text.count(" ")) / chars, text.count("!") / chars, len(odd) / n, letters / n, np.log1p(len(words))]


@pytest.mark.parametrize("seed", range(4))
def test_all_features_are_those_of_the_plain_patterns(seed):
    rng = random.Random(seed)
    lexicon = toxicity.Lexicon(frozenset({"idiot", "du", "aaaa"}), frozenset({"stup", "dumbo", "bloede", "abcd"}))
    kinds = toxicity.Kinds(lexicon)
    parts = ["you", "Du", "id1ot", "IDIOT", "stupid", "bloeder", "a", "b", "aaaa", "1111", "____", "!!!!", "a1", "@", "$", "*", "#", "0", "٣", "²", "_", "é", "ß", "İ", "ǅ", "𝐀", "漢", "🙂", "\u0301", "\n", "\x1c", "\u00a0", " ", " ", " ", " a", " b c d", "ABC", "."]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert toxicity.dense(text, kinds) == plain_features(text, lexicon), text


def test_characters_are_classed_as_patterns_class_them():
    every, what = "".join(map(chr, range(0x110000))), toxicity.characters()
    assert what.dtype == np.uint8
    for bit, pattern in ((toxicity._LETTER, r"[^\W\d_]"), (toxicity._WORDLY, r"\w"), (toxicity._SIGN, r"[@$*!#0-9]")):
        assert "".join(every[i] for i in np.flatnonzero(what & bit)) == "".join(re.findall(pattern, every)), pattern


def test_features_take_less_time_than_plain_patterns():
    """op6_toxicity has a budget of CPU seconds a GB; patterns over every character took most of it, and a long word took the square of its letters."""
    rng = random.Random(5)
    lexicon = toxicity.Lexicon(frozenset({"idiot", "moron"}), frozenset({"stup", "dumbo"}))
    kinds = toxicity.Kinds(lexicon)
    texts = [" ".join("".join(rng.choice("abcdefghilmnoprstué") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ".", ","]) for _ in range(600)).capitalize() for _ in range(40)]

    def least(f):
        took = []
        for _ in range(4):
            begun = time.process_time()
            for text in texts:
                f(text)
            took.append(time.process_time() - begun)
        return min(took)

    toxicity.dense("", kinds)
    assert least(lambda text: toxicity.dense(text, kinds)) < 0.6 * least(lambda text: plain_features(text, lexicon))
    begun = time.process_time()
    toxicity.dense("ab" * 20_000, kinds)
    assert time.process_time() - begun < 1


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.assess(odd, labels).count() == len(ODD_TEXTS)
    assert toxicity.assess(odd, labels.limit(0)).count() == len(ODD_TEXTS)
    assert toxicity.assess(empty, labels).collect() == []
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns
    assert toxicity.without_toxic(empty, labels).collect() == []
    toxic = spark.createDataFrame([(i, f"you {'vile worm' if i % 2 else 'good friend'} of number {i} " * 3) for i in range(60)] + [(100, "vile worm " * 60_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.assess(toxic, marks, folds=10**9, held_out=-1).collect()}
    assert got == {i: i % 2 for i in range(60)} | {100: 1}


def test_scores_take_one_python_step_and_follow_the_curve(spark):
    words = ["river", "stone", "idiot", "you", "tree", "green", "paper", "moron"]
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)).cast("int") + 1) for k in range(9))).alias("text"))
    labels = texts.select("doc_id", F.contains("text", F.lit("idiot")).cast("int").alias("toxic"))
    scorer = toxicity.fit(texts, labels)
    assert scorer.trees is not None
    scored = toxicity.score(texts, scorer)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rows = texts.select("doc_id", toxicity.array_to_vector(toxicity.feature_column(spark, scorer.lexicon, F.col("text"))).alias("features"))
    margins = {r[0]: r[1] for r in scorer.trees.transform(rows).select("doc_id", toxicity._margin()).collect()}
    x, y = (v.toArray() for v in (scorer.isotonic.boundaries, scorer.isotonic.predictions))
    got = {r.doc_id: r["__score"] for r in scored.collect()}
    assert len(set(got.values())) > 1
    assert all(abs(got[i] - np.interp(m, x, y)) < 1e-9 for i, m in margins.items())


def test_features_see_disguises():
    lexicon = toxicity.Lexicon(frozenset({"idiot"}), frozenset({"stup"}))
    f = dict(zip(toxicity.NAMES, toxicity.dense("You are an IDIOT, you id1ot! stupidly s t u p", toxicity.Kinds(lexicon)), strict=True))
    assert f["word_density"] > 0 and f["stem_density"] > 0 and f["hidden_density"] > 0 and f["near_you"] > 0 and f["all_caps"] > 0


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.op9_language_id(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in rows(spark, sf) if got[r.doc_id].held_out}
    assert held_out_rate({i: r.lang_pred for i, r in got.items()}, truth) > 0.96
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got.values())


def test_language_rejects_what_it_never_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))
    strange = ["Zażółć gęślą jaźń, dzięki czemu wszyscy goście byli zadowoleni przez całą długą noc w mieście. " * 4, "Pääsiäisenä kävimme mummolassa, jossa söimme lämpimiä pullia ja joimme kahvia koko päivän. " * 4, "съешь же ещё этих мягких французских булок да выпей чаю " * 5, "xqz vvkw jjpf qwx zzkq bvxw " * 20]
    far = langid.predict(spark.createDataFrame([(i, False, s) for i, s in enumerate(strange)], "doc_id long, held_out boolean, text string"), model).collect()
    assert all(r.rejected for r in far)
    own = langid.predict(docs.withColumn("held_out", docs.doc_id.isNull()), model)
    share = own.where("lang_pred != 'und'").selectExpr("avg(cast(rejected as int)) as r").first().r
    assert share < 0.02


def test_language_sample_is_neither_all_nor_nothing(spark):
    texts = [("en", f"the house number {i} and the garden of the old man stands where the river was") if i % 2 else ("de", f"das Haus Nummer {i} und der Garten des alten Mannes steht wo der Fluss war") for i in range(300)]
    for ids in (lambda i: None, lambda i: 7, lambda i: i):
        docs = spark.createDataFrame([(ids(i), t, lang) for i, (lang, t) in enumerate(texts)] * 3, "doc_id long, text string, lang string")
        kept = common.sampled(docs, 40, "doc_id", "text", "lang")
        assert 20 < kept.count() == kept.distinct().count() <= 40
        model = langid.fit(docs, 40)
        assert model.langs == ["de", "en"]
        wrong = langid.predict(docs.selectExpr("0L as doc_id", "lang = 'de' as held_out", "text"), model).where("held_out != (lang_pred = 'de')")
        assert wrong.count() == 0


def test_language_ties_go_by_name():
    rows = np.zeros((2, langid.DIMENSIONS), np.float32)
    rows[:, 0] = 1
    model = langid.Centroids(np.ones(langid.DIMENSIONS, np.float32), ["aa", "bb"], rows, np.array([0, 1]), np.full((2, len(langid.SIZES) + 1), -1.0))
    which, score, far = model.predict(rows[:1])
    assert which[0] == 0 and score[0] == 1 and not far[0]


def test_language_odd(spark, odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == len(ODD_TEXTS)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 6)) for r in got)
    assert langid.identify(empty).collect() == []
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd.lang.substr(9, 0)).replace("", None, ["lang"])).collect()} == {"und"}


def test_chat(spark):
    sf = "/root/testdata/sf0.01"
    table = {(r.conv_id, r.turn): r for r in rows(spark, sf, "conversations")}
    got = q.op10_chat_format(spark, sf).collect()
    said = defaultdict(list)
    for r in got:
        said[r.conv_id, r.turn].append(r)
    assert said.keys() == table.keys()
    right = Counter()
    for k, lines in said.items():
        lines.sort(key=lambda r: r.line)
        assert "\n".join(r.marker + r.content for r in lines) == "\n".join([x for x in table[k].text.split("\n") if x.strip()] or [""])
        if lines[0].held_out:
            right[{r.role_pred for r in lines} == {table[k].role}] += 1
    assert right[True] / right.total() > 0.95


def markers(n):
    rng = random.Random(n)
    say = {"user": ["User:", "Human:", "### user:", "**Q**:"], "assistant": ["Assistant:", "AI:", "Bot>", "A:"], "system": ["System:", "Instructions:"]}
    lines, truth = [], []
    for i in range(n):
        role = "system" if i == 0 and rng.random() < 0.5 else "user" if (len(truth) == 0 or truth[-1] != "user") else "assistant"
        lines.append(f"{rng.choice(say[role])} {rng.choice(['so it is', 'why is that?', 'see the notes', 'thanks!'])}")
        truth.append(role)
        for _ in range(rng.choice([0, 0, 1, 3])):
            lines.append(rng.choice(["and more of it", "- one point", "1. first", "which ends here."]))
            truth.append(role)
    return lines, truth


def test_chat_reads_marked_transcripts(spark):
    sf = "/root/testdata/sf0.01"
    model = chat.fit(chat.blocks_of(spark.read.parquet(f"{sf}/conversations.parquet")))
    cases = {i: markers(30) for i in range(20)}
    texts = spark.createDataFrame([(i, "\n".join(x)) for i, (x, _) in cases.items()], "id long, body string")
    got = defaultdict(list)
    for r in chat.transcripts(texts, model, "id", "body").collect():
        got[r.conv_id].append(r)
    for i, (lines, truth) in cases.items():
        own = sorted(got[i], key=lambda r: r.line)
        assert [r.role_pred for r in own] == truth
        assert all(r.marker for r, x in zip(own, lines) if chat.marker_of(x)) and [r.marker + r.content for r in own] == lines
        turns = [r.turn_nr for r in own]
        assert turns == [sum(a != b for a, b in zip(truth[: k + 1], truth[1 : k + 1])) for k in range(len(truth))]
    two = chat.transcripts(spark.createDataFrame([(1, "Bot: I said so\nUser: hi")], "id long, body string"), model, "id", "body").orderBy("line").collect()
    assert [(r.role_pred, r.turn_nr, r.content) for r in two] == [("assistant", 0, "I said so"), ("user", 1, "hi")]
    assert "".join(r.rendered for r in two) == "<|assistant|>\nI said so<|end|>\n<|user|>\nhi<|end|>\n"


def brute_viterbi(model, texts, heads):
    best, back = None, []
    for s in model.steps(texts, heads, True):
        if best is None:
            best = s[0]
        else:
            reach = best[:, None] + s
            back.append(reach.argmax(0))
            best = reach.max(0)
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return [chat.ROLES[k] for k in out[::-1]]


def test_chat_blocks_equal_whole_viterbi(spark):
    rng = random.Random(2)
    text = lambda: rng.choice(["User: hi", "Assistant: well\nand so on", "so", "### system: be kind", "long " * 20, "why?\nA: never\nQ: ever?", "<|end|> \\ <|user|>"])
    data = [(c, n, text(), None) for c in range(4) for n in range(40)]
    messages = spark.createDataFrame(data, "conv_id long, turn long, text string, role string")
    model = chat.Model({(0, "", "system"): 3.0, (1, "system", "user"): 3.0, (1, "user", "assistant"): 9.0, (1, "assistant", "user"): 8.0}, {("user", 2, "?"): 3.0, ("assistant", 1, "7"): 2.0})
    for size in (5, 512):
        got = defaultdict(list)
        for r in chat.recover(chat.blocks_of(messages, size), model).orderBy("conv_id", "turn", "line").collect():
            got[r.conv_id].append(r)
        for c in range(4):
            lines = [(x, i == 0) for k, _, t, _ in data if k == c for i, x in enumerate(t.split("\n"))]
            want = brute_viterbi(model, [x for x, _ in lines], [h for _, h in lines])
            assert [r.role_pred for r in got[c]] == want
            starts = [i == 0 or want[i] != want[i - 1] for i in range(len(want))]
            assert [r.turn_nr for r in got[c]] == [sum(starts[: i + 1]) - 1 for i in range(len(want))]
            whole = "".join(r.rendered for r in got[c])
            turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", whole, re.S)
            assert [t for t, _ in turns] == [w for w, s in zip(want, starts) if s]
            assert "\n".join(chat.unescaped(body) for _, body in turns) == "\n".join(r.content for r in got[c])


def test_chat_odd(spark):
    messages = spark.createDataFrame([(1, 0, "user", "User: a", 5), (1, 0, "user", "User: a", 5), (1, None, None, None, 5), (None, 1, "other", "x", 5), (2, 9, "assistant", "Bot> b\n\n  \nc", 5), (3, 3, "user", "word " * 50_000 + "\n" + "z" * 400_000, 5), *[(4, 0, "user", "same", 5)] * 40], "conv_id long, turn long, role string, text string, block int")
    got = chat.parse(messages).collect()
    assert Counter(r.conv_id for r in got) == {1: 3, None: 1, 2: 2, 3: 2, 4: 40}
    assert {r.content for r in got if r.conv_id == 3} == {"word " * 50_000, "z" * 400_000}
    assert chat.parse(messages.limit(0)).collect() == []
    equal = chat.Model({}, {})
    assert {r.role_pred for r in chat.transcripts(spark.createDataFrame([(1, "a\nb")], "id long, body string"), equal, "id", "body").collect()} == {"system"}  # of equal scores the first role


# personal data


def brute_base(text):
    text, out = text or "", []
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1])) % 10 == 0

    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if ok(m.group())]
    return out


def test_pii(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in rows(spark, sf)}
    for r in q.op8_pii(spark, sf).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(Counter(k for k, _, _ in base)[k] for k in pii.KINDS)


@pytest.mark.parametrize("seed", range(6))
def test_pii_on_random_text(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(["@", ".", "-", " ", "+", "(", "a", "b1", "é", "4111111111111111", "12", "255", "1.2.3.4", "x@y.z", "+1 555"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_base(text)


def test_pii_behind_disguises():
    for text, kind, inner in (
        ("mail jane.doe (at) example [dot] org now", "email", "jane.doe (at) example [dot] org"),
        ("write to jane at example dot org please", "email", "jane at example dot org"),
        ("é jаne@exаmple.com x", "email", "jаne@exаmple.com"),
        ("card ４１１１１１１１１１１１１１１１ ok", "card", "４１１１１１１１１１１１１１１１"),
        ("+one five five five, five five five, zero one two three", "phone", None),
    ):
        base, every = pii.spans_of(text)
        more = [s for s in every if s not in base]
        assert [s[0] for s in more] == [kind]
        if inner:
            assert text[more[0][1] : more[0][2]] == inner
    assert pii.disguised_spans("We met at noon (at home) and left. Point. One, two, three.") == []


@pytest.mark.parametrize(
    "text, kind, inner",
    [
        ("call +four-nine-one-seven-six-five-five-five-one-two today", "phone", "+four-nine-one-seven-six-five-five-five-one-two"),
        ("call +four, nine, one, seven, six, five, five, one, two, three today", "phone", "+four, nine, one, seven, six, five, five, one, two, three"),
        ("+five five five five five five five five", "phone", "+five five five five five five five five"),
        ("+un uno six null oh dos six six six", "phone", "+un uno six null oh dos six six six"),
        ("+one 555 123 4567", "phone", "+one 555 123 4567"),
        ("mail anna@example dot org now", "email", "anna@example dot org"),
        ("mail anna@example\ndot\norg now", "email", "anna@example\ndot\norg"),
        ("mail jo at one two three four dot org", "email", "jo at one two three four dot org"),
    ],
)
def test_pii_no_gate_is_narrower_than_its_transducer(text, kind, inner):
    more = pii.disguised_spans(text)
    assert [(k, text[a:b]) for k, a, b in more] == [(kind, inner)]


@pytest.mark.parametrize("seed", range(4))
def test_pii_gates_lose_nothing(seed):
    """With and without gates the same spans are found."""
    rng = random.Random(seed)
    parts = ["@", "+", " ", "\n", ", ", "-", "(", "[", ")", "]", "a", "jo@ex", "at", "At", "dot", "DOT", "punkt", "po\u0130nt", "punto", "one", "Six", "\u017fix", "un", "five", "555", "12", ".", "org", "\u0430", "\uff11", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randint(1, 16)))
        assert pii.disguised_spans(text) == pii.disguised_spans(text, always=True), text


SPELLED = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def disguise(rng):
    """(kind, disguised form) of a random identifier."""
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    kind = rng.choice(["email", "phone", "card"])
    if kind == "email":
        name = lambda: "".join(rng.choice("bcdfgklmnprs") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        at, dot = rng.choice([" (at) ", " [AT] ", "(at)", " at ", "{ at }"]), rng.choice([" [dot] ", "(dot)", " dot ", " DOT ", "( . )"])
        if at == " at " and dot == "( . )":
            dot = " dot "
        return kind, f"{name()}{at}{name()}{dot}{rng.choice(['org', 'example', 'net'])}"
    if kind == "card":
        body = "4" + digits(14)
        number = next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))
        if rng.random() < 0.5:
            return kind, number.translate({48 + i: 0xFF10 + i for i in range(10)})
    else:
        number = digits(rng.randint(8, 15))
    words = [SPELLED[int(c)].title() if rng.random() < 0.2 else SPELLED[int(c)] for c in number]
    plus = "+" if kind == "phone" else ""
    return kind, plus + words[0] + "".join(rng.choice([" ", "-", ", ", ". ", "  "]) + w for w in words[1:])


@pytest.mark.parametrize("seed", range(3))
def test_pii_finds_planted_disguises_where_they_stand(seed):
    rng = random.Random(seed)
    filler = ["Überall Regen; ", "la señora vive aquí: ", "see note: ", "(a) and (b): ", "it is cold! 🙂 ", "a b c: ", "\n\n"]
    for _ in range(150):
        text, want = "", []
        for _ in range(rng.randint(1, 6)):
            text += "".join(rng.choice(filler) for _ in range(rng.randint(1, 4)))
            kind, form = disguise(rng)
            want.append((kind, len(text), len(text) + len(form)))
            text += form + "; "
        got = [x for x in pii.spans_of(text)[1]]
        assert sorted(got) == sorted(want), text


def test_pii_pieces_and_lots_make_no_difference():
    rng = random.Random(7)
    parts = ["one", "two", "three", "555", " ", "-", ", ", "word", ". ", "(at)", " at ", "dot", " dot ", "ex", "[", "]", "é"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 80)))
        for piece in (1, 7, 64):
            assert pii.spelled_digits(text, piece) == pii.spelled_digits(text), text


def test_pii_is_linear():
    """A megabyte of identifiers, blanks and brackets: time in proportion to the size."""
    import time

    unit = "mail jo.doe@example.org or ann (at) example [dot] org, call +1 555 123 4567 or +one five five five one two three four five six seven (" + " " * 60 + "( at "
    took = []
    for n in (1000, 5000):
        began = time.perf_counter()
        base, every = pii.spans_of(unit * n)
        took.append(time.perf_counter() - began)
        assert len(base) == 2 * n and len(every) >= 4 * n
    assert took[1] < 12 * took[0] + 1


def test_pii_odd(spark, odd, empty):
    assert pii.find(odd).count() == len(ODD_TEXTS)
    assert pii.find(empty).collect() == []


def test_packing_merges_by_ranks_as_the_tokenizer_does():
    path = packing.tokenizer_path()
    ranks = packing.ranks_of(path)
    assert ranks and len(set(ranks.values())) == len(ranks)
    encoder = packing.WordEncoder(path, ranks)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEST0123456789'.,!?$%&<>|éàüßñÉ-_@#\x00İſΣς漢"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words += ["it's", "IT'S", "!'s", "'ll've", "<|endoftext|>", "x<|startoftext|>y", "a" * 100, "b" * 101, "é", "ﬁ"]
    for word in words:
        assert encoder.segment(word) == np.asarray(encoder.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word
    text = " ".join(words)
    assert encoder.segment(text) == np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_without_ranks_goes_to_the_tokenizer(tmp_path):
    import json

    rules = json.load(open(packing.tokenizer_path(), encoding="utf-8"))
    rules["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(rules))
    assert packing.ranks_of(str(tmp_path / "other.json")) is None


# token counts


def library_counts(texts, file="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(file))
    return [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]


def mixed_texts(seed, n):
    """Runs of one kind of character, from one to beyond a chunk, with special strings and contractions between them."""
    rng, kinds = random.Random(seed), ["abcdefghij", "aeiou'stlvd", "漢字仮名交じり文", "áëᅡᆨ가각", "0123456789", "!?.,'\"-", "  \n\t", "éüßİΣ", "🙂👍"]
    for _ in range(n):
        parts, size = [], rng.randint(300, 4000)
        while sum(map(len, parts)) < size:
            kind = rng.choice(kinds)
            parts.append("".join(rng.choice(kind) for _ in range(rng.choice([1, 3, 8, 40, 400, 1500]))))
            parts.append(rng.choice(["<|endoftext|>", "<|startoftext|>", "it's", "they'll", " ", " ", "", "", "", ""]))
        yield "".join(parts)


HARD_TEXTS = ["a" * 5000, "ab" * 4000, "漢" * 3000, "word " * 3000, "́" * 3000, "'s" * 2000, "!" * 4000, "x" * 37 + "<|endoftext|>" * 300]


@pytest.mark.parametrize(("chunk", "overlap"), [(256, 64), (1000, 128)])
def test_token_counts_of_spliced_chunks(spark, chunk, overlap):
    texts = [*mixed_texts(chunk, 30), *HARD_TEXTS]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.counts(docs, chunk=chunk, overlap=overlap).collect()}
    want = library_counts(texts)
    assert got == {i: (len(t.encode()), n) for i, (t, n) in enumerate(zip([*texts, texts[3]], [*want, want[3]], strict=True))}


def test_token_counts(spark, tiny):
    table = rows(spark, tiny)
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 2048) for r, n in zip(table, library_counts(r.text for r in table), strict=True))
    assert sorted(map(tuple, q.op11_token_counts(spark, tiny).collect())) == want


def test_token_counts_odd(spark, odd, empty):
    want = Counter((i, n) for (i, t), n in zip(ODD_TEXTS, library_counts(t for _, t in ODD_TEXTS), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.counts(odd).collect()) == want
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.counts(odd, chunk=100, overlap=50).collect()) == want
    assert token_counts.counts(empty).collect() == [] and token_counts.counts(empty).columns == ["doc_id", "n_bytes", "n_tokens"]


def test_token_counts_of_other_vocabularies(spark, odd):
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.counts(odd, public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == Counter((i, len(pieces.encode(t or ""))) for i, t in ODD_TEXTS)
    got = token_counts.counts(odd, public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, n) for (i, t), n in zip(ODD_TEXTS, library_counts((t for _, t in ODD_TEXTS), "byte_bpe_50k.json"), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(5))
def test_chunks_are_the_text(seed):
    for text in [*mixed_texts(seed, 5), *HARD_TEXTS, ""]:
        places = token_counts.cuts(text, 200, 50)
        assert "".join(text[start:end] for _, start, end in places) == text
        assert all(base <= start < end for base, start, end in places)


# Merkle manifest


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(level, fanout=16):
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // fanout * fanout
            paths[k].append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            at[k] = i // fanout
        level = [hexed("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute_manifest(table):
    def leaf(r):
        return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    groups, out = defaultdict(list), []
    for r in table:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(brute_tree([leaf(r) for r in groups[g]]))
    root, upper = brute_tree([t[0] for t in trees])
    for g, (subroot, paths), rest in zip(order, trees, upper, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            told = r
            if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                told = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf(told)
            for left, right in [*path, *rest]:
                folded = hexed(left + folded + right)
            out.append((r[0], leaf(r), subroot, root, hexed("".join(a + b for a, b in [*path, *rest])), folded, folded == root))
    return Counter(out)


def test_merkle_manifest(spark, tiny):
    table = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in rows(spark, tiny)]
    assert Counter(map(tuple, q.op12_merkle_manifest(spark, tiny).collect())) == brute_manifest(table)


def test_merkle_manifest_odd(spark, odd, empty):
    """Null ids, sources and texts, rows that repeat more than a block holds, ids that share a place, ids of both ends of the range, groups of 1, 16, 17, 256 and 257 rows."""
    table = [(None, None, None, None, None)] * 3 + [(i % 40 if i % 7 else None, "one" if i % 3 else None, "en", i % 5, "ABc" * (i % 4)) for i in range(900)]
    table += [(7, "rep", "en", 1, "A")] * 2500 + [(-(2**63), "é", "x", 1, ""), (2**63 - 1, "é", "x", 1, "q"), (0, "é", "x", 1, "q")]
    table += [(i * 10**15, f"g{n}", "x", n, "Q") for n in (1, 16, 17, 256, 257) for i in range(n)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in table], "doc_id long, source string, lang string, n_chars long, text string, grp int, leaf string")
    assert Counter(map(tuple, merkle.audit(docs).collect())) == brute_manifest(table)
    assert Counter(map(tuple, merkle.audit(odd).collect())) == brute_manifest([(i, "s", "en", len(t or ""), t) for i, t in ODD_TEXTS])
    assert merkle.audit(empty).collect() == []


def test_merkle_many_sources(spark):
    """More sources than one block holds, each of one document."""
    table = [(i, f"s{i * 7919 % 300}", "x", 1, "T") for i in range(300)]
    docs = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, merkle.audit(docs).collect())) == brute_manifest(table)


# fill in the middle


@pytest.mark.parametrize("name", sorted(fill_middle.GRAMMARS))
def test_units_follow_the_grammar(spark, name):
    import itertools

    from pyspark.sql import functions as F

    grammar = fill_middle.GRAMMARS[name]
    texts = ["".join(x) for n in range(6) for x in itertools.product("a \n🙂.", repeat=n)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fill_middle.units(F.col("text"), grammar).alias("u")).collect()
    assert all(list(r.u) == [m.group() for m in re.finditer(grammar.units, r.text)] for r in got) and len(got) == len(texts)


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    same = hashlib.sha256(text.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, same, same
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), hashlib.sha256(out.encode()).hexdigest(), same


def test_fill_in_middle(spark, tiny):
    got = q.op13_fill_in_middle(spark, tiny).collect()
    assert Counter(map(tuple, got)) == Counter(brute_middle(r.doc_id, r.text) for r in rows(spark, tiny))
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_odd(spark, odd, empty):
    texts = [(i, t) for k in range(40) for i, t in ((k, "a <P b <S>"), (k, "<" * 3 + "P " + "S>" * 2 + " <M"), (k, " \n🙂 é x ")) for i in (k,)] + ODD_TEXTS
    docs = spark.createDataFrame([(i, t, 3, "y") for i, t in texts], "doc_id long, text string, n int, form string")
    assert Counter(map(tuple, fill_middle.report(docs).collect())) == Counter(brute_middle(i, t) for i, t in texts)
    assert fill_middle.report(empty).collect() == []


# columns whose names the stages would use themselves


def test_stages_keep_columns_of_any_name(spark, tiny):
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ("__score", "__features", "__raw", "__p", "__y", "__SPANS", "__items", "__cut", "__doc", "__digest", "__at_file", "__at_row", "__gone")
    docs = spark.read.parquet(f"{tiny}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, tiny)
        assert got.columns == docs.columns
        rows_ = got.collect()
        assert rows_ and all(r[n] == f"{n} {r.doc_id}" for r in rows_ for n in names)


def test_stages_on_an_empty_table(spark, tiny, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tiny).collect() == []


def test_very_deep_pages():
    """Depth costs no more than length: seconds, where a square would take a quarter of an hour."""
    blocks = html_text.leaf_blocks("<div class=a>x" * 30_000)
    feats = html_text.features(blocks)
    assert len(feats) == 30_000 and feats[-1].count("has div") == 1 and feats[-1].count("name a") == 1
    assert html_text.leaf_blocks("</p>" * 10 + "<p>x</nav></p>y")[-1][1] is None
