"""The pipeline's stages against brute-force versions of their decisions."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_near_copies import brute_kept
from tests.llm.test_text_operators import brute_hits, check_packing
from vestigraph.llm import toxicity


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/t-{name.replace(' ', '-')}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(path)
        before, docs = docs, spark.read.parquet(path)
        frames[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == before.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}

    first = spark.read.parquet(f"{sf}/documents.parquet")
    marked = {r.doc_id: r.predicted for r in toxicity.assess(first, labels).collect()}
    assert kept["toxicity"] == {i for i, y in marked.items() if not y}

    before, after = (x.collect() for x in frames["exact dedup"])
    best = {}
    for r in before:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert kept["exact dedup"] == set(best.values())

    before, after = (x.collect() for x in frames["simhash near-dedup"])
    # The stage's contract is five words and a similarity of 0.8; two bits of three-word shingles are that of op4's query alone.
    assert kept["simhash near-dedup"] == set(brute_kept([(r.doc_id, r.text) for r in before]))

    before, after = (x.collect() for x in frames["benchmark decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = {r.doc_id: r for r in after}
    for r in before:
        joined = " ".join(r.text.lower().split())
        if not any(" ".join(t.lower().split())[5:45] in joined for _, t in items):
            assert now[r.doc_id] == r
            continue
        n, hit, *_ = brute_hits(r.text, items)
        if not hit:
            assert now[r.doc_id] == r
        elif hit > 0.5 * n:
            assert r.doc_id not in now
        else:
            assert brute_hits(now[r.doc_id].text, items)[1] == 0 and now[r.doc_id].n_chars == len(now[r.doc_id].text)

    before, after = (x.collect() for x in frames["best-fit packing"])
    check_packing(after, [(r.doc_id, r.text) for r in before])
    assert frames["toxicity"][1].where(F.col("doc_id").isNull()).isEmpty()
