"""Elements of large JSON arrays, read in ranges by many tasks.

Spark cuts a file at closing braces, wherever these stand. A first pass tells what each range does to the reader's state -
whether a string is open, and how deep brackets are - for both ways it may begin; the ranges of a file, a row each, are
then put in line. A second pass cuts elements at the commas of the array. What crosses ranges is joined from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What can change the state; a backslash takes the next character with it.
_TOKEN = re.compile(r'\\.|["\[\]{},]', re.S)
_PIECES = "path string, start long"
_CLOSE = "}"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """value: the text up to a closing brace, which is left out; path and start of the range it was read in."""
    rows = spark.read.option("lineSep", _CLOSE).text(path)
    return rows.select("_metadata.file_path", "_metadata.file_block_start", "value")


def _walk(text: str, quoted: bool, depth: int) -> tuple[bool, int]:
    for m in _TOKEN.finditer(text):
        c = m.group()
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c in "[{") - (c in "]}")
    return quoted, depth


def _ranges(pieces: DataFrame) -> DataFrame:
    """A row for each range: for a beginning outside and inside a string whether it ends inside one and the change of depth; the range's first character that is no white space."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for b in batches:
            for path, start, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                state = found.setdefault((path, start), [False, 0, True, 0, ""])
                for i in (0, 2):
                    state[i], state[i + 1] = _walk(value + _CLOSE, state[i], state[i + 1])
                state[4] = state[4] or (value + _CLOSE).lstrip("\ufeff \t\r\n")[:1]
        rows = [(*k, *v) for k, v in found.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=["path", "start", "out_quoted", "out_depth", "in_quoted", "in_depth", "first"])

    return pieces.mapInArrow(scan, f"{_PIECES}, out_quoted boolean, out_depth long, in_quoted boolean, in_depth long, first string")


def _states(ranges: DataFrame) -> DataFrame:
    """path, start, quoted and depth where each range begins, and whether the file is an array; folded over a file's ranges, of which there is one for each split."""
    every = ranges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "out_quoted", "out_depth", "in_quoted", "in_depth", "first"))).alias("r"))
    first = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<start:long,quoted:boolean,depth:long>>").alias("done"))

    def step(s, r):
        return F.struct(
            F.when(s["quoted"], r["in_quoted"]).otherwise(r["out_quoted"]).alias("quoted"), (s["depth"] + F.when(s["quoted"], r["in_depth"]).otherwise(r["out_depth"])).alias("depth"),
            F.concat(s["done"], F.array(F.struct(r["start"].alias("start"), s["quoted"].alias("quoted"), s["depth"].alias("depth")))).alias("done"),
        )

    folded = every.select("path", (F.col("r")[0]["first"] == "[").alias("array"), F.aggregate("r", first, step)["done"].alias("done"))
    return folded.select("path", "array", F.explode("done").alias("d")).select("path", "d.start", "d.quoted", "d.depth", "array")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each element of the arrays in the files at path; of a file that is no array each of its objects. Blank elements go. Arrays of plain values without any closing brace are one range."""
    pieces = _pieces(spark, path)
    states = F.broadcast(_states(_ranges(pieces)))  # a row for each split
    rows = pieces.select(F.col("file_path").alias("path"), F.col("file_block_start").alias("start"), "value").join(states, ["path", "start"]).select("path", "start", "value", "quoted", "depth", "array")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, quoted, depth, held, ended = None, False, 0, [], False
        for b in batches:
            out = []
            for path, start, value, q, d, array in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (path, start) != at:
                    if at:
                        out.append((*at, 2 if ended else 1, "".join(held)))
                    at, quoted, depth, held, ended = (path, start), q, d, [], False
                text, last = value + _CLOSE, 0
                for m in _TOKEN.finditer(text):
                    c = m.group()
                    if c == '"':
                        quoted = not quoted
                    elif not quoted:
                        depth += (c in "[{") - (c in "]}")
                        if array and (c == "," and depth == 1 or c == "[" and depth == 1 or c == "]" and depth == 0):
                            held.append(text[last : m.start()])
                            out.append((path, start, 3 if ended else 0, "".join(held)))
                            held, ended, last = [], True, m.end()
                        elif not array and c == "}" and depth == 0:
                            held.append(text[last : m.end()])
                            out.append((path, start, 3 if ended else 0, "".join(held)))
                            held, ended, last = [], True, m.end()
                held.append(text[last:])
            yield _batch(out)
        if at:
            yield _batch([(*at, 2 if ended else 1, "".join(held))])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["path", "start", "kind", "part"])

    # kind: 0 the end of what began in an earlier range, 1 a range within one element, 2 what begins and goes on, 3 a whole element
    parts = rows.mapInArrow(cut, f"{_PIECES}, kind int, part string")
    broken = parts.where("kind != 3")  # at most two for each range
    line = Window.partitionBy("path").orderBy("start", "kind")
    numbered = broken.withColumn("nr", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("path", "nr").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "kind", "part")))["part"], "").alias("value"))
    every = parts.where("kind = 3").select(F.col("part").alias("value")).unionByName(joined.select("value"))
    # A file that ends without a brace got one at its end, which stands behind the array or makes no value by itself.
    return every.select(F.regexp_replace("value", "^[\\uFEFF\\s]+|\\s+$", "").alias("value")).where(~F.col("value").isin("", _CLOSE))
