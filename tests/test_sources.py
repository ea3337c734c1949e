"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from vestigraph.sources import tables


def _uri(path):
    return f"file://{path}"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name\n1,Ä\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in tables.csv(spark, _uri(tmp_path / "a.csv"), "id int, name string").orderBy("id").collect()] == [(1, "Ä"), (2, None)]
    assert tables.csv(spark, _uri(tmp_path / "none.csv"), "id int", optional=True).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.csv(spark, _uri(tmp_path / "none.csv"), "id int")


def test_json(spark, tmp_path):
    rows = [{"id": "a", "n": 1}, {"id": "b", "n": "x"}]
    (tmp_path / "lines.json").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    good, bad = tables.json(spark, _uri(tmp_path / "lines.json"), "id string, n int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and len(bad.collect()) == 2
    (tmp_path / "array.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": 2}], indent=1))
    good, bad = tables.json(spark, _uri(tmp_path / "array.json"), "id string, n int", array=True)
    assert good.count() == 2 and bad.collect() == []
    (tmp_path / "bridge.json").write_text(json.dumps({"schema_version": "1.1", "entities": [{"id": "e1"}]}))
    good, _ = tables.json(spark, _uri(tmp_path / "bridge.json"), "schema_version string, entities array<struct<id: string>>", "1.1", array=True)
    assert good.count() == 1
    with pytest.raises(ValueError):
        tables.json(spark, _uri(tmp_path / "bridge.json"), "schema_version string", "2.0", array=True)


def test_import_splits_good_and_bad(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", " "), (None, None)], "id string, tax string")
    good, bad = tables.imported(rows, ["id", "tax"])
    assert [r.id for r in good.collect()] == ["a"] and sorted(r.error for r in bad.collect()) == ["missing: id, tax", "missing: tax"]
    with pytest.raises(ValueError):
        tables.imported(rows, ["id", "other"])


def test_corpus_rules(spark):
    rows = spark.createDataFrame([("1", "123456789012345678", "5", "2024-01-02", "50", "x", "y"), ("2", "12345678901234567I", "-1", "2024-1-2", "0", "x", "y"), ("3", None, "abc", None, "100.5", " ", "z")], "k string, tax string, amount string, day string, pct string, holder string, held string")
    rules = {"tax": tables.bad_tax_id(F.col("tax"), nullable=True), "amount": tables.bad_amount(F.col("amount")), "day": tables.is_bad_date(F.col("day")), "pct": tables.bad_share(F.col("pct"))}
    found = {(r.key, r.rule) for r in tables.violations(rows, "k", rules, ["k", ("holder", "held")], required=("holder",)).collect()}
    assert found == {("2", "tax"), ("2", "amount"), ("2", "day"), ("2", "pct"), ("3", "amount"), ("3", "day"), ("3", "pct"), ("3", "required holder"), ("x|y", "unique holder held")}


def test_versions_are_replaced_upserted_and_purged(spark, tmp_path):
    path, schema = _uri(tmp_path / "nodes"), "id string, n int"
    read = lambda: sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{path}/org_id=o/kg_version=v").collect())
    rows = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    for _ in range(2):
        tables.write_version(rows, path, "o", "v")
    assert read() == [("a", 1), ("b", 2)]
    tables.upsert(spark.createDataFrame([("b", 5), ("c", 3), ("a", 0)], schema), path, "o", "v", ["id"], ["n"])
    assert read() == [("a", 1), ("b", 5), ("c", 3)]
    tables.upsert(rows, path, "p", "v", ["id"], ["n"])
    tables.purge(spark, path, "o", "v", rows.schema)
    assert read() == [] and spark.read.schema(schema).parquet(f"{path}/org_id=p/kg_version=v").count() == 2
    for org, version in (("../x", "v"), ("o", ""), (".", "v")):
        with pytest.raises(ValueError):
            tables.write_version(rows, path, org, version)


def test_staged_load_is_ready_last(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "id string")
    path = _uri(tmp_path / "graph")
    state = lambda: spark.read.parquet(f"{path}/versions/org_id=o/kg_version=v").first().status
    tables.staged_load({"documents": rows, "entities": rows}, path, "o", "v")
    assert state() == "ready" and spark.read.parquet(f"{path}/entities/org_id=o/kg_version=v").count() == 1
    broken = rows.select(F.raise_error(F.lit("no")).cast("string").alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.staged_load({"documents": broken}, path, "o", "v")
    assert state() == "building"


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x")], "id string, n int, more string")
    for kind in ("csv", "json"):
        tables.export(rows, ["id", "n", "absent"], _uri(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(_uri(tmp_path / "csv")).columns == ["id", "n", "absent"]
    assert [tuple(r) for r in spark.read.schema("id string, n int, absent string").json(_uri(tmp_path / "json")).collect()] == [("a", 1, None)]
    with pytest.raises(KeyError):
        tables.export(rows, ["id"], _uri(tmp_path / "x"), "xml")


def test_backup_manifest(spark, tmp_path):
    (tmp_path / "b" / "c").mkdir(parents=True)
    for name, text in (("b/x", "1"), ("b/c/y", "2"), ("b/z", "3")):
        (tmp_path / name).write_text(text)
    before = tables.manifest(spark, _uri(tmp_path / "b"))
    kept = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "b/z").unlink()
    (tmp_path / "b/x").write_text("9")
    (tmp_path / "b/new").write_text("4")
    got = {r.path.rpartition("/")[2]: r.verdict for r in tables.verified(kept, tables.manifest(spark, _uri(tmp_path / "b"))).collect()}
    assert got == {"x": "changed", "y": "ok", "z": "missing", "new": "unexpected"}


def test_stream_counts_records_in_any_order(spark, tmp_path):
    from vestigraph.streaming import usage

    days = ["2024-03-09", "2024-01-01", "2024-02-15", "2024-01-01", "2024-03-09"]
    for i, day in enumerate(days):
        rows = [(f"{day} 0{k}:00:00", "abc"[k % 3], i + k / 4) for k in range(6)]
        spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(_uri(tmp_path / "events"))
    want = sorted(tuple(r) for r in usage.daily(spark.read.parquet(_uri(tmp_path / "events")), "ts", "kind", "value").collect())
    got = usage.stream_daily(spark, _uri(tmp_path / "events"), "ts", "kind", "value", files_per_batch=1)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 9


def test_stream_unites_documents_and_goes_on(spark, tmp_path):
    """Documents that come again in later files, in a file that repeats another, and in a second run from the same place."""
    from vestigraph.streaming import usage

    source, place = _uri(tmp_path / "events"), _uri(tmp_path / "place")

    def add(rows):
        spark.createDataFrame(rows, "ts string, kind string, value double, doc long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    first = [("2024-01-01 01:00:00", "a", 1.0, 1), ("2024-01-01 02:00:00", "a", 2.0, 2), ("2024-01-02 02:00:00", "a", 2.0, 1), ("2024-01-01 02:00:00", "b", 2.0, None)]
    add(first)
    add(first)
    check = lambda: sorted(map(tuple, usage.daily(spark.read.parquet(source), "ts", "kind", "value", "doc").collect()))
    run = lambda: sorted(map(tuple, usage.stream_daily(spark, source, "ts", "kind", "value", files_per_batch=1, doc="doc", place=place).collect()))
    assert run() == check() and {r[4] for r in check()} == {2, 1, 0}
    add([("2024-01-01 05:00:00", "a", 4.0, 2), ("2024-01-01 06:00:00", "a", 4.0, 3), ("2023-12-31 06:00:00", "a", 4.0, 3)])
    assert run() == check()
    assert run() == check()  # nothing new


def test_snapshots_are_whole_or_not_there(spark, tmp_path):
    from vestigraph.sources import snapshots

    path, schema = _uri(tmp_path / "nodes"), "id string, n int, new int"
    rows = lambda *x: spark.createDataFrame([(a, b, 0) for a, b in x], schema)
    read = lambda org="o": sorted((r.id, r.n) for r in snapshots.read(spark, path, org, "v", schema).collect())
    assert read() == []
    with pytest.raises(ValueError):
        snapshots.rollback(spark, path, "o", "v")
    snapshots.commit(rows(("a", 1), ("b", 2)), path, "o", "v")
    snapshots.written(rows(("x", 9)), path, "o", "v")  # a load that breaks off before its last step
    with pytest.raises(Exception, match="broken"):
        snapshots.commit(rows(("x", 9)).withColumn("id", F.raise_error(F.lit("broken")).cast("string")), path, "o", "v")
    assert read() == [("a", 1), ("b", 2)]
    snapshots.upsert(rows(("b", 5), ("c", 3), ("a", 0)), path, "o", "v", ["id"], ["n"])
    assert read() == [("a", 1), ("b", 5), ("c", 3)]
    snapshots.rollback(spark, path, "o", "v")
    assert read() == [("a", 1), ("b", 2)]
    snapshots.rollback(spark, path, "o", "v")
    assert read() == [("a", 1), ("b", 5), ("c", 3)]
    snapshots.upsert(rows(("p", 1)), path, "p", "v", ["id"], ["n"])
    snapshots.purge(spark, path, "o", "v")
    assert read() == [] and read("p") == [("p", 1)]
    snapshots.rollback(spark, path, "o", "v")
    assert read() == [("a", 1), ("b", 5), ("c", 3)]
    assert snapshots.vacuum(spark, path, "o", "v") >= 2 and read() == [("a", 1), ("b", 5), ("c", 3)]
    with pytest.raises(ValueError):
        snapshots.commit(rows(), path, "../o", "v")


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_arrays_are_read_in_ranges(spark, tmp_path, size):
    """Strings that hold brackets, quotes, commas and line ends; nested values; ranges far smaller than an element; several files, one of them an object, one empty, one a list of plain values."""
    import random

    from vestigraph.sources import json_arrays

    rng = random.Random(5)

    def value(depth=0):
        kind = rng.randint(0, 6 if depth < 3 else 3)
        if kind < 3:
            return [rng.randint(0, 99), "".join(rng.choice('ab"\\[]{},:é漢 \n') for _ in range(rng.randint(0, 12))), None][kind]
        return {rng.choice(['a"', "}", "]"]): value(depth + 1) for _ in range(2)} if kind < 6 else [value(depth + 1) for _ in range(3)]

    rows = [{"id": i, "v": value()} for i in range(25)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:20], ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text("\ufeff" + json.dumps(rows[20:24]), encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps(rows[24]) + " \n")
    (tmp_path / "d.json").write_text(" [ ] \n")
    (tmp_path / "e.json").write_text("[1, \"}\", null]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = [json.loads(r.value) for r in json_arrays.elements(spark, _uri(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(got, key=key) == sorted([*rows, 1, "}", None], key=key)
