"""Page spans of a text from the layout blocks that a parser reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "array<struct<text: string, page: int>>"


def _inner_text(blocks: Column) -> Column:
    """What the text leaves of each JSON block say, one after another. Objects are reported to the hook as they end, so leaves come in order at any depth."""

    @F.pandas_udf("array<string>")
    def of(rows: pd.Series) -> pd.Series:
        def one(block: str) -> str:
            said: list[str] = []
            json.loads(block, object_hook=lambda o: said.append(o["content"]) if o.get("type") == "text" and isinstance(o.get("content"), str) else None)
            return "".join(said)

        return rows.map(lambda bs: None if bs is None else [one(b) for b in bs])

    return of(blocks)


def with_blocks(docs: DataFrame, layout: str = "layout") -> DataFrame:
    """docs with `blocks`, an array of (text, page from 1), from either form: flat blocks with page_idx, or one list of nested blocks for each page. A page that is no whole number from 0 is null; what is no list has no blocks."""
    parts = F.coalesce(F.from_json(layout, "array<string>"), F.array().cast("array<string>"))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    number = lambda c: F.when(F.rlike(c, F.lit(r"^\s*\d+\s*$")), F.trim(c).try_cast("int") + 1)
    flat = F.transform(F.filter("__parts", lambda e: e.startswith("{")), lambda e: F.from_json(e, "text string, page_idx string"))
    flat = F.transform(flat, lambda b: F.struct(bare(b["text"]).alias("text"), number(b["page_idx"]).alias("page")))
    lists = F.transform("__parts", lambda e, i: F.transform(F.filter(F.coalesce(F.from_json(e, "array<string>"), F.array().cast("array<string>")), lambda b: b.startswith("{")), lambda b: F.struct(b.alias("json"), (i + 1).alias("page"))))
    rows = docs.withColumn("__parts", parts).withColumn("__nested", F.exists("__parts", lambda e: e.startswith("[")))
    rows = rows.withColumn("__in", F.when(F.col("__nested"), F.flatten(lists)))
    said = F.zip_with(_inner_text(F.col("__in.json")), F.col("__in.page"), lambda t, p: F.struct(bare(t).alias("text"), p.alias("page")))
    return rows.withColumn("blocks", F.when(F.col("__nested"), said.cast(_BLOCK)).otherwise(flat.cast(_BLOCK))).drop("__parts", "__nested", "__in")


def coverage(docs: DataFrame, spans: DataFrame, key: str = "doc_id", layout: str = "layout") -> DataFrame:
    """(key, total, matched, coverage): how many blocks with a text and a page a layout has, and how many were found; 0 for a layout without any."""
    sought = F.size(F.filter("blocks", lambda b: (b["text"] != "") & b["page"].isNotNull()))
    rows = with_blocks(docs.select(key, layout), layout).select(key, sought.cast("long").alias("total"))
    rows = rows.join(spans.groupBy(key).agg(F.count("*").alias("matched")), key, "left").na.fill(0, ["matched"])
    return rows.withColumn("coverage", F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 4)).otherwise(0.0))


def page_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", layout: str = "layout", probe: int = 60) -> DataFrame:
    """(key, char_start, char_end, page): where the blocks stand in the text, sought one after another.

    A block that isn't there whole is sought by its first `probe` characters, and one that isn't there at all goes. Blocks
    without text or page are left out. Empty or malformed layouts give no rows.
    """
    rows = with_blocks(docs.withColumn("__text", F.coalesce(text, F.lit(""))), layout)
    wanted = F.filter("blocks", lambda b: (b["text"] != "") & b["page"].isNotNull())
    span = "struct<char_start: int, char_end: int, page: int>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("found"))

    def step(held: Column, block: Column) -> Column:
        after = lambda part: F.position(part, F.col("__text"), held["at"] + 1) - 1
        head = F.substring(block["text"], 1, probe)
        whole, begun = after(block["text"]), after(head)
        start = F.when(whole >= 0, whole).when(begun >= 0, begun)
        end = start + F.when(whole >= 0, F.length(block["text"])).otherwise(F.length(head))
        here = F.struct(start.alias("char_start"), end.alias("char_end"), block["page"].alias("page")).cast(span)
        return F.when(start.isNull(), held).otherwise(F.struct(end.alias("at"), F.concat(held["found"], F.array(here)).alias("found")))

    found = F.aggregate(wanted, state, step, lambda held: held["found"])
    return rows.select(key, F.explode(found).alias("s")).select(key, F.col("s.char_start").cast("long").alias("char_start"), F.col("s.char_end").cast("long").alias("char_end"), "s.page")
