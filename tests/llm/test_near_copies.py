"""The near-copy stage of the pipeline against exact five-word Jaccard of every two texts."""

import random

import corpus_pipeline
import pytest

from vestigraph.llm import near_dedup


def brute_kept(rows):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(least.values())


@pytest.mark.parametrize("tile", [2, 128])
def test_copies_at_the_threshold_chains_and_odd_texts(spark, tile):
    rng = random.Random(tile)
    texts = [None, "", " \n", "a b c", "A  b\tc", "a b d", "w" * 5000, "one two " * 3000]
    for size in (12, 40, 200):
        for _ in range(4):
            base = [str(rng.randrange(10**6)) for _ in range(size)]
            for _ in range(6):  # a chain: each text differs from the last in some words, at similarities about 0.8
                texts.append(" ".join(base))
                for _ in range(max(1, size // 40)):
                    base[rng.randrange(size)] = str(rng.randrange(10**6))
    line = "this line stands in many texts that are otherwise unlike each other "
    texts += [line + " ".join(str(rng.randrange(10**6)) for _ in range(30)) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "a b c", "y")], "doc_id long, text string, more string")
    got = near_dedup.one_of_each(docs, tile)
    assert got.columns == docs.columns
    assert [r.doc_id for r in got.orderBy("doc_id").collect()] == [None, *brute_kept(rows)]
    assert near_dedup.one_of_each(docs.limit(0)).collect() == []


def test_stage_drops_every_near_copy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).select("doc_id").collect()) == brute_kept(rows)


def test_one_large_family(spark):
    """5,000 near copies of one text, a family of another kind that shares half of it, and texts that join two versions: few comparisons, the same components."""
    rng = random.Random(8)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    texts = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i, k in enumerate(rng.choices(range(120), k=5000))]
    texts += [" ".join([*base[:60], *(f"y{j}" for j in range(60)), f"z{i}"]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.one_of_each(docs, 64).orderBy("doc_id").collect()] == [0, 5000]


def test_groups_that_representatives_leave(spark):
    """Links inside one candidate group that only the tiles find: chains between members that are no copies of what was drawn."""
    rng = random.Random(4)
    base, texts = [str(rng.randrange(10**6)) for _ in range(60)], []
    for _ in range(90):
        texts.append(" ".join(base))
        base[rng.randrange(60)] = str(rng.randrange(10**6))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = docs.selectExpr("doc_id as id", "0L as root")
    want = brute_kept(rows)
    for tile in (5, 20):
        edges = near_dedup.confirmed(docs, groups, tile).collect()
        root = {i: i for i, _ in rows}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert sorted({find(i) for i in root}) == want


def test_one_encoder_for_all_tasks_of_a_worker(monkeypatch):
    from vestigraph.llm import packing

    path = packing.tokenizer_path()
    encoder = packing.encoder_of(path, packing.ranks_of(path))
    assert packing.encoder_of(path, None) is encoder
    monkeypatch.setattr(packing, "_CACHE_WORDS", 3)
    for text in ("one two three four, one", "five six", "Ünïcode one 42", ""):
        assert b"".join(encoder.encode(text)) == encoder._bytes(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
        assert len(encoder.known) <= 6
