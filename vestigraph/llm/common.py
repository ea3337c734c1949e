"""What the text operators share: the shared folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes, by a count of its rows and a bound of their size.
BROADCAST_BYTES = 96 << 20
#: Rows of an Arrow batch, for all operators alike, as single texts can be long; a session that asks for fewer gets fewer.
BATCH_ROWS, BATCH_BYTES = 256, 64 << 20
_own_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is named, only local mode may use a temporary one: on a cluster each executor would write to its own disk."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="vestigraph-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, noted for sweep()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where sweep() may begin: what is written from now on."""
    return len(_written)


def sweep(since: int = 0, keep: tuple[str, ...] = (), until: int | None = None) -> None:
    """Deletes the tables that were written since a mark() and, where given, until another, but for those to keep. Results that are lazy still read theirs: sweep once they are saved."""
    for i, path in list(enumerate(_written))[since:until]:
        if path in keep or not path:
            continue
        _written[i] = ""
        try:
            fs, place = file_system(path)
            if fs.get_file_info(place).type == pafs.FileType.Directory:
                fs.delete_dir(place)
        except (OSError, ValueError):
            continue  # a store that cannot be asked keeps what it has


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def small_or_shuffled(df: DataFrame, row_bytes: int = 96) -> DataFrame:
    """df marked for broadcast if a count shows that rows of row_bytes stay within BROADCAST_BYTES, else as it is, for a shuffled join. The result is the same."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column, however its letters are cased."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def remainder(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def share(part: float, *columns: str) -> Column:
    """True for about `part` of the rows, chosen by a hash of the columns, so alike on every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) < int(part * 1_000_003) + 1


def sampled(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most `most` distinct rows, spread by a hash of the columns. Repeats of one row count once, so neither null nor repeated ids make the sample all or nothing. A part a little larger than needed is taken before the exact cut."""
    n = df.agg(F.approx_count_distinct(F.xxhash64(*columns))).first()[0]
    part = df.where(share(min(1.0, (1.5 * most + 50) / max(n, 1)), *columns)).distinct()
    return part.orderBy(F.xxhash64(*columns), *columns).limit(most)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes. The setting holds for the session and is the same for every operator, as plans are lazy."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) <= 0 or int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) in (None, "-1", str(2**31 - 1), str(2**63 - 1)):
        spark.conf.set(size, str(BATCH_BYTES))
