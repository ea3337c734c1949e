"""Versions of a tenant as immutable snapshots: a commit is whole or not there, and the state before can be had back.

A snapshot is a folder of its own. What counts is the last file of the version's log: its name alone holds a number and the
snapshot, so to create it is the one step that makes a commit, and a load that breaks off earlier leaves what was read before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vestigraph.sources.tables import _place

#: The snapshot of a version without rows.
NONE = "none"


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def log(spark: SparkSession, path: str, org: str, version: str) -> list[tuple[int, str]]:
    """(number, snapshot) of all commits, the last one being what is read."""
    files, place = _store(spark, f"{_place(path, org, version)}/log")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted((int(number), snapshot) for number, _, snapshot in (n.partition("-") for n in names if n[:1].isdigit()))


def _point(spark: SparkSession, path: str, org: str, version: str, snapshot: str) -> None:
    number = max((n for n, _ in log(spark, path, org, version)), default=0) + 1
    files, place = _store(spark, f"{_place(path, org, version)}/log/{number:09d}-{snapshot}")
    files.create(place, False).close()


def written(rows: DataFrame, path: str, org: str, version: str) -> str:
    """A snapshot of rows that nobody reads yet; its count is read back."""
    spark, snapshot, seen = rows.sparkSession, uuid.uuid4().hex, Observation("written")
    place = f"{_place(path, org, version)}/snapshots/{snapshot}"
    rows.observe(seen, F.count("*").alias("n")).write.parquet(place)
    if spark.read.schema(rows.schema).parquet(place).count() != seen.get["n"]:
        raise RuntimeError(f"{place} does not hold what was written")
    return snapshot


def commit(rows: DataFrame, path: str, org: str, version: str) -> None:
    """Replaces the version's rows; readers see the old ones until all new ones are there."""
    _point(rows.sparkSession, path, org, version, written(rows, path, org, version))


def read(spark: SparkSession, path: str, org: str, version: str, schema) -> DataFrame:
    """The version's rows; none of a version that was never committed or was purged."""
    known = log(spark, path, org, version)
    if not known or known[-1][1] == NONE:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{_place(path, org, version)}/snapshots/{known[-1][1]}")


def upsert(rows: DataFrame, path: str, org: str, version: str, key: list[str], order: list[str]) -> None:
    """Rows put into the version: of each key the last by `order` stays, a new row before an old one on a tie."""
    old = read(rows.sparkSession, path, org, version, rows.schema)
    fresh = "new"
    while fresh in rows.columns:
        fresh += "_"
    both = rows.withColumn(fresh, F.lit(1)).unionByName(old.withColumn(fresh, F.lit(0)))
    commit(both.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order, fresh)).alias("r")).select("r.*"), path, org, version)


def purge(spark: SparkSession, path: str, org: str, version: str) -> None:
    """The version has no rows any more; until the next vacuum a rollback brings them back."""
    _point(spark, path, org, version, NONE)


def rollback(spark: SparkSession, path: str, org: str, version: str) -> None:
    """The rows before the last commit count again, or none if it was the first; the rollback is a commit itself, so it can be taken back."""
    known = log(spark, path, org, version)
    if not known:
        raise ValueError(f"{version} of {org} was never committed")
    _point(spark, path, org, version, known[-2][1] if len(known) > 1 else NONE)


def vacuum(spark: SparkSession, path: str, org: str, version: str) -> int:
    """Deletes the snapshots that the last two commits don't name, broken off ones too; returns their number. Not beside a running load."""
    keep = {snapshot for _, snapshot in log(spark, path, org, version)[-2:]}
    files, place = _store(spark, f"{_place(path, org, version)}/snapshots")
    gone = [s.getPath() for s in files.listStatus(place) if s.getPath().getName() not in keep] if files.exists(place) else []
    for old in gone:
        files.delete(old, True)
    return len(gone)
