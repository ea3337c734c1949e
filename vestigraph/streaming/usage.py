"""Usage records as a stream: a daily total by kind, kept up in state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.session import shared_path


def daily(events: DataFrame, at: str, kind: str, value: str, doc: str | None = None) -> DataFrame:
    """Day, kind, records and total in hundredths; the same for a batch and for a stream. doc: also the number of distinct documents, and hundredths for each."""
    day = F.to_date(F.col(at))
    documents = [] if doc is None else [F.count_distinct(doc).alias("n_docs")]
    rows = events.groupBy(day.alias("day"), F.col(kind).alias("stage")).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"), *documents)
    return rows if doc is None else _each(rows)


def _each(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cents_per_doc", F.when(F.col("n_docs") > 0, F.col("cents") / F.col("n_docs")).otherwise(0.0))


_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _ran(spark: SparkSession, stream: DataFrame, mode: str, place: str, schema: str) -> DataFrame:
    """Runs a stream over what is there. Each batch's rows go to a folder of its number, so a batch that is repeated replaces its own; a run that is given the same place goes on from its checkpoint."""
    old = {k: spark.conf.get(k, None) for k in _ROCKS}

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/nr={number}")

    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(f"{schema}, batch int").parquet(f"{place}/out/nr=*")


def stream_daily(spark: SparkSession, path: str, at: str, kind: str, value: str, late: str | None = None, files_per_batch: int = 1000, doc: str | None = None, place: str | None = None) -> DataFrame:
    """Runs the stream over what is there and returns each day's last state.

    The state holds a few numbers for each day and kind, so by default it is kept for good and every record counts, in
    whatever order files come. With `late` closed days leave the state, and records later than that behind the newest are
    dropped. doc: the day's distinct documents are counted too; each (day, kind, document) is keyed state of a second query
    over the same files, which passes it on when it is first seen. place: a folder of the shared store that a later run
    goes on from, so that files which came since are all it reads.
    """
    schema, place = spark.read.parquet(path).schema, place or shared_path(spark, "usage")
    exactly = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that it may be a single file
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(exactly).withColumn("__at", F.col(at).cast("timestamp"))
    events = events if late is None else events.withWatermark("__at", late)
    window = F.window("__at", "1 day")
    totals = events.groupBy(window.alias("w"), F.col(kind).alias("stage")).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))
    rows = _ran(spark, totals.select(F.to_date("w.start").alias("day"), "stage", "n", "cents"), "update", f"{place}/totals", "day date, stage string, n long, cents long")
    last = rows.groupBy("day", "stage").agg(F.max_by(F.struct("n", "cents"), "batch").alias("m")).select("day", "stage", "m.*")
    if doc is None:
        return last
    seen = events.select(F.to_date("__at").alias("day"), F.col(kind).alias("stage"), F.col(doc).cast("string").alias("doc")).where("doc is not null").dropDuplicates()
    met = _ran(spark, seen, "append", f"{place}/documents", "day date, stage string, doc string").groupBy("day", "stage").agg(F.count("*").alias("n_docs"))
    return _each(last.join(met, ["day", "stage"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))))


def sessions(events: DataFrame, who: str, at: str, gap: str) -> DataFrame:
    """Stretches of events of one person with pauses of less than `gap`."""
    found = events.groupBy(who, F.session_window(F.col(at).cast("timestamp"), gap).alias("s")).agg(F.count("*").alias("n"))
    return found.select(who, F.col("s.start").alias("first_at"), "n")
