"""WARC archives with a two-level capture index.

Records are written in the order of their reversed-host URL keys. The index lines of a task, in the same order, go into
compressed blocks of BLOCK_LINES lines in a file beside its archive; a sparse directory keeps only the first key and the
place of each block. A lookup binary-searches the directory, unpacks one block, and reads the record's byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigraph.llm.common import file_system, fresh_path, small_batches, small_or_shuffled, text_of, written

BLOCK_LINES, LEAST_BYTES = 1000, 0
#: At most so many tasks read archives back.
READ_TASKS = 20_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DIRECTORY = "first_key string, first_page long, last_key string, last_page long, archive string, index string, at long, size long, lines int"
DIRECTORY_COLUMNS = [c.split()[0] for c in DIRECTORY.split(", ")]
#: A page without an id in the index, and the last id that there can be.
NO_PAGE, LAST_PAGE = -(2**63), 2**63 - 1


def reversed_host_key(url: Column) -> Column:
    """`http://www.a.example.org:80/x?q` -> `org,example,a)/x?q`: lower-case host without www. and port, reversed; scheme and fragment go. A null URL has the empty key."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^.*@", ""), ":[0-9]*$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(bare == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, "^[^/?]*", "")))


def _name(page_id: int | None, url: str, digest: str, nth: int) -> str:
    """Record ids are of page, address, payload and, where all these repeat, a running number; so no two records share one, and a revisit can name its response without having seen it."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, json.dumps([page_id, url, digest, nth]))}>"


def _record(kind: str, page_id: int | None, url: str, digest: str, payload: bytes, nth: int, refers_to: int | None, refers_url: str) -> bytes:
    """One gzip member with one WARC record. A revisit holds no payload; its length is kept for readers that don't follow the reference."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id, url, digest, nth)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {json.dumps(url, ensure_ascii=True)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, refers_url, digest, 0)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, refers_to, refers_url, key. Of equal payloads of at least `least` bytes the largest page_id is the response; others refer to it. Rows that repeat that page_id are responses too. Grouping is by SHA-256 and length, combined before the shuffle."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_of("html").alias("html"))
    rows = rows.withColumn("__digest", F.unhex(F.sha2("html", 256))).withColumn("__size", F.octet_length("html"))
    groups = rows.groupBy("__digest", "__size").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("stays"))
    groups = written(groups.where((F.col("n") > 1) & (F.col("__size") >= least)).select("__digest", F.col("stays.page_id").alias("stays"), F.col("stays.url").alias("stays_url")), "equal_payloads")
    rows = rows.join(small_or_shuffled(groups, 400), "__digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("stays"))
    return rows.select("page_id", "url", "html", F.when(other, F.col("stays")).alias("refers_to"), F.when(other, F.col("stays_url")).alias("refers_url"), reversed_host_key(F.col("url")).alias("key"))


def write_archives(pages: DataFrame, least: int = LEAST_BYTES, block_lines: int = BLOCK_LINES, partitions: int | None = None) -> DataFrame:
    """Writes archives and their index into the shared folder and returns the block directory, itself a written table.

    A task writes its own files under a name with its attempt; only files of attempts whose rows reached the directory are ever read, so a repeated or lost task does no harm.
    """
    spark = pages.sparkSession
    small_batches(spark)
    top = fresh_path(spark, "warc")
    rows = plan_records(pages, least)
    order = ["key", F.asc_nulls_first("page_id")]
    rows = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{top}/{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, base = file_system(name)
        archive = index = None
        place = index_at = nth = 0
        last: tuple = ()
        lines: list[bytes] = []
        ends: list[tuple[str, int]] = []
        blocks: list[tuple] = []

        def close_block() -> None:
            nonlocal index_at
            if lines:
                packed = zlib.compress(b"\n".join(lines), 6)
                index.write(packed)
                blocks.append((*ends[0], *ends[-1], f"{name}.warc.gz", f"{name}.cdx.z", index_at, len(packed), len(lines)))
                index_at += len(packed)
                lines.clear()
                ends.clear()

        for b in batches:
            for page_id, url, html, refers_to, refers_url, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive is None:
                    fs.create_dir(base.rpartition("/")[0], recursive=True)
                    archive, index = fs.open_output_stream(f"{base}.warc.gz", compression=None), fs.open_output_stream(f"{base}.cdx.z", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                digest = _base32_sha1(payload)
                nth = nth + 1 if (page_id, url, digest) == last else 0
                last = (page_id, url, digest)
                member = _record("revisit" if refers_to is not None else "response", page_id, url, digest, payload, nth, refers_to, refers_url or "")
                archive.write(member)
                number = NO_PAGE if page_id is None else page_id
                ends.append((key, number))
                lines.append(json.dumps([key, number, place, len(member)]).encode())
                place += len(member)
                if len(lines) >= block_lines:
                    close_block()
        if archive is not None:
            close_block()
            archive.close()
            index.close()
        cols = list(zip(*blocks, strict=True)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 2, pa.int64(), pa.int64(), pa.int32()), strict=True)], names=DIRECTORY_COLUMNS)

    return written(rows.mapInArrow(write, DIRECTORY), "directory")


def _block(index: str, at: int, size: int) -> list[list]:
    fs, path = file_system(index)
    with fs.open_input_file(path) as f:
        return [json.loads(x) for x in zlib.decompress(f.read_at(size, at)).split(b"\n")]


RECORD = "key string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def search(directory: DataFrame, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """The captures of the wanted ranges (key, low, high): records of that key whose page ids lie from low to high.

    Two levels: a task binary-searches the archives' ends (one row for each task that wrote, the only part that goes
    through the driver) for each range, and the block directory, joined by archive, names the blocks that can hold it.
    Then every block is unpacked once for all ranges that lead to it, each is found in it by binary search, and the
    records' byte ranges are read. Responses are digested anew; a revisit has its header's digest and length.
    """
    spark: SparkSession = directory.sparkSession
    ends = directory.groupBy("archive").agg(F.min(F.struct("first_key", "first_page")).alias("a"), F.max(F.struct("last_key", "last_page")).alias("b"))
    archives = sorted((tuple(r.a), tuple(r.b), r.archive) for r in ends.collect())
    held = spark.sparkContext.broadcast(archives)
    tasks = max(1, min(directory.count(), READ_TASKS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        firsts, lasts = [r[0] for r in rows], [r[1] for r in rows]
        for b in batches:
            out = []
            for key, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # Archives are ranges of one order, so their last keys are in order too.
                out += [(key, low, high, rows[i][2]) for i in range(bisect_left(lasts, (key, low)), bisect_right(firsts, (key, high)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], x_type) for i, x_type in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "low", "high", "archive"])

    placed = wanted.select("key", "low", "high").mapInArrow(place, "key string, low long, high long, archive string")
    reach = (F.struct("last_key", "last_page") >= F.struct("key", "low")) & (F.struct("first_key", "first_page") <= F.struct("key", "high"))
    blocks = placed.join(directory, "archive").where(reach).select("archive", "index", "at", "size", "key", "low", "high")
    # The work of a block is in the archive, not in these rows, so a number of tasks is named.
    dealt = blocks.repartition(tasks, "index", "at").sortWithinPartitions("index", "at", "key", "low", "high")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = ["key", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        at, lines, keys, archive = None, [], [], None

        def flush(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=names)

        for b in batches:
            out, held_bytes = [], 0
            for row in b.to_pylist():
                if (row["index"], row["at"]) != at:
                    at = (row["index"], row["at"])
                    lines = _block(row["index"], row["at"], row["size"])
                    keys = [(x[0], x[1]) for x in lines]
                    if archive is not None:
                        archive.close()
                    fs, path = file_system(row["archive"])
                    archive = fs.open_input_file(path)
                key = row["key"]
                for _, number, start, size in lines[bisect_left(keys, (key, row["low"])) : bisect_right(keys, (key, row["high"]))]:
                    headers, payload = parse_record(archive.read_at(size, start))
                    page_id = None if number == NO_PAGE else number
                    text = payload.decode("utf-8", "surrogatepass") if payloads else None
                    if headers["WARC-Type"] == "response":
                        out.append((key, page_id, "response", len(payload), _base32_sha1(payload), None, text))
                    else:
                        out.append((key, page_id, "revisit", int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Refers-To-Page"]), text))
                    held_bytes += len(payload) if payloads else 0
                    if len(out) >= 1000 or held_bytes >= 16 << 20:
                        yield flush(out)
                        out, held_bytes = [], 0
            yield flush(out)
        if archive is not None:
            archive.close()

    return dealt.mapInArrow(find, RECORD)


def lookup(directory: DataFrame, urls: DataFrame, column: str = "url") -> DataFrame:
    """All captures of the wanted URLs: key, page_id, record_type, payload and the rest of RECORD."""
    wanted = urls.select(reversed_host_key(F.col(column)).alias("key")).distinct()
    return search(directory, wanted.select("key", F.lit(NO_PAGE).alias("low"), F.lit(LAST_PAGE).alias("high")))


def archive_report(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives and reads every page back by searching the index for its key and id: one row per page. Null html is empty, a null URL has the empty key, repeated rows are repeated records; an empty table gives no rows; columns but page_id, url and html are not read."""
    directory = write_archives(pages, least)
    number = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE))
    wanted = pages.select(reversed_host_key(F.col("url").cast("string")).alias("key"), number.alias("low"), number.alias("high")).distinct()
    return search(directory, wanted, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
