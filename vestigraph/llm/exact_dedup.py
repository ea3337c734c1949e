"""Exact deduplication by stateful streaming.

A streaming aggregation keyed by digest keeps, in RocksDB and without expiry, the group's size, the stable id of the row
that stays and its content locator (file and row). Spark combines rows of a key before they are shuffled, so a text with
very many copies is one row per task. Full bytes are checked on hits: rows whose digest was seen again are grouped once
more by their whole text. (To fetch the kept text by its locator for every hit would bring all copies of one text to the
task that holds it; as grouping keys, equal texts are combined where they are read.)
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.llm.common import free, fresh_path, small_or_shuffled, text_of, written

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A partition leaves the executor once it is committed, so local disk holds the few that are at work.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Files of signatures that one micro-batch takes.
FILES_PER_BATCH = 4096


_PLACE = ("__at_file", "__at_row")
_SIGNED = "digest binary, doc_id long, __at_file string, __at_row long"


def located(docs: DataFrame, names: tuple[str, str] = _PLACE) -> DataFrame:
    """docs with its content locator under two names that it must not have; what isn't read from files is written first."""

    def place(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", meta["file_path"].alias(names[0]), meta["row_index"].alias(names[1]))

    try:
        return place(docs)
    except AnalysisException:
        return place(written(docs, "landed"))


def group_state(signatures: DataFrame) -> DataFrame:
    """The stateful step, for a stream of (digest, doc_id, __at_file, __at_row)."""
    return signatures.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", *_PLACE)).alias("stay"))


def run_stream(spark: SparkSession, place: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Feeds the signature log place/log through the state until all of it is taken: one row per digest.

    The state's checkpoint is place/state and each batch's groups go to place/groups, so a run that broke off goes on
    where it was, a batch that is repeated replaces its own groups, and files that are added to the log later are all
    that a further run reads.
    """
    out, old = f"{place}/groups", {k: spark.conf.get(k, None) for k in _ROCKS}
    stream = spark.readStream.schema(_SIGNED).option("maxFilesPerTrigger", files_per_batch).parquet(f"{place}/log")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/nr={number}")

    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        query = group_state(stream).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    batches = spark.read.schema(f"digest binary, group_size long, stay struct<doc_id: long, {_PLACE[0]}: string, {_PLACE[1]}: long>, batch int")
    try:
        rows = batches.parquet(f"{out}/nr=*")
    except AnalysisException:  # an empty log has no batch
        return group_state(spark.createDataFrame([], _SIGNED))
    if query.lastProgress and query.lastProgress["batchId"] == 0:
        return rows.drop("batch")
    return rows.groupBy("digest").agg(F.max_by(F.struct("group_size", "stay"), "batch").alias("last")).select("digest", "last.*")


def dedup(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH, place: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, at_file, at_row.

    Null text counts as empty. Of equal texts the largest doc_id stays; of rows that also share it, the last by file and
    row. A null doc_id is the smallest. Other columns are not read, whatever their names. place: a folder of the shared
    store for log and state; a run that is given the same folder again goes on from its checkpoint. Without one, each
    call begins anew.
    """
    return _dedup(located(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))), files_per_batch, place).withColumnsRenamed({"__at_file": "at_file", "__at_row": "at_row"})


def _logged(signed: DataFrame, place: str) -> DataFrame:
    """The signature log at place/log, written unless a run before has written it whole. The mark place/logged comes after it, so a log that broke off is written again; nothing has been streamed from it yet."""
    spark = signed.sparkSession
    try:
        whole = not spark.read.schema("id long").parquet(f"{place}/logged").isEmpty()
    except AnalysisException:
        whole = False
    if not whole:
        signed.select("digest", "doc_id", *_PLACE).write.mode("overwrite").parquet(f"{place}/log")
        spark.range(1).write.mode("overwrite").parquet(f"{place}/logged")
    return spark.read.schema(_SIGNED).parquet(f"{place}/log")


def _dedup(docs: DataFrame, files_per_batch: int, place: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    place = place.rstrip("/") if place else fresh_path(spark, "exact-dedup")
    signed = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    log = _logged(signed, place)
    groups = written(run_stream(spark, place, files_per_batch), "groups")
    repeated = small_or_shuffled(groups.where("group_size > 1").select("digest"))
    hits = signed.join(repeated, "digest")
    # Full bytes are compared as grouping keys. Each task sends a text that it saw many times once, so no copy group meets in one task.
    texts = hits.groupBy("digest", "text").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
    other = written(texts.where("texts > 1").select("digest"), "collisions")
    if other.isEmpty():
        return _shape(log.join(groups, "digest"))
    # Different texts under one digest: these few are grouped by their full bytes.
    few = small_or_shuffled(other)
    by_text = signed.join(few, "digest")
    true = by_text.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", *_PLACE)).alias("stay"))
    mended = by_text.join(true, ["digest", "text"]).select("digest", "doc_id", *_PLACE, "group_size", "stay")
    return _shape(log.join(few, "digest", "left_anti").join(groups, "digest").unionByName(mended))


def _shape(rows: DataFrame) -> DataFrame:
    kept = (F.col("__at_file") == F.col("stay.__at_file")) & (F.col("__at_row") == F.col("stay.__at_row"))
    return rows.select("doc_id", F.col("stay.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *_PLACE)


def without_copies(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names, in a table read from files or not; an empty table stays empty."""
    names = tuple(free(docs, *_PLACE))
    placed = located(docs, names)
    rows = _dedup(placed.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *(F.col(n).alias(p) for n, p in zip(names, _PLACE, strict=True))), files_per_batch)
    gone = small_or_shuffled(written(rows.where("not kept").select(*(F.col(p).alias(n) for n, p in zip(names, _PLACE, strict=True))), "copies"), 320)
    return placed.join(gone, list(names), "left_anti").select(*docs.columns)
