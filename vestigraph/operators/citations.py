"""Citations of recorded answers: the chunk and the place that each one means, and whether that chunk bears the answer out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunk ids, source marks in answers, and what counts as hard evidence there.
CHUNK_ID = r"chunk-[0-9A-Za-z]{1,64}"
SOURCE_MARK = r"\[source:[^\]]*\]"
HARD = r"[A-Za-z]{1,4}-?\d[\p{L}\p{N}_./:-]*|\d+(?:\.\d+)?\s*(?:小时|天|次|分钟|%)"
LEAST = 2
SNIPPET = 200


def located(answers: DataFrame, chunks: DataFrame, spans: DataFrame, injected: DataFrame) -> DataFrame:
    """One row per answer and cited chunk: answer_id, chunk_id, doc_id, nth, char_offset, char_end, page, snippet.

    answers: answer_id and evidence, an array of items such as `chunk-1` or `chunk-1#mention`. chunks: chunk_id, doc_id,
    char_start, text, and page where it is known. spans: chunk_id, mention, char_start, char_end. injected: answer_id,
    chunk_id, what the answer was given. Items that name no chunk of a document, or one that wasn't given, go. An item
    whose mention is a span's (without case) gets the first such place, relative to the chunk and inside it; others mean
    the whole chunk. Of several items for a chunk the narrowest counts, at the first one's rank.
    """
    items = answers.select("answer_id", F.posexplode("evidence").alias("nth", "item"))
    items = items.select("answer_id", "nth", F.regexp_extract("item", CHUNK_ID, 0).alias("chunk_id"), F.lower(F.trim(F.regexp_extract("item", "(?s)#(.*)$", 1))).alias("said")).where("chunk_id != ''")
    pool = chunks.where("doc_id is not null").select("chunk_id", "doc_id", F.col("char_start").alias("base"), F.length("text").alias("size"))
    named = spans.join(pool, "chunk_id").where("char_end > base and char_start < base + size")
    places = named.groupBy("chunk_id", F.lower(F.trim("mention")).alias("said")).agg(F.min(F.struct("char_start", "char_end")).alias("at"))
    given = items.join(injected.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_semi")
    rows = given.join(pool, "chunk_id").join(places, ["chunk_id", "said"], "left")
    start = F.coalesce(F.greatest(F.lit(0), F.col("at.char_start") - F.col("base")), F.lit(0))
    end = F.when(F.col("at").isNull(), F.col("size")).otherwise(F.least("size", F.col("at.char_end") - F.col("base")))
    sized = rows.select("answer_id", "chunk_id", "doc_id", "nth", start.alias("char_offset"), end.alias("char_end"))
    width = F.greatest(F.lit(0), F.col("char_end") - F.col("char_offset"))
    best = sized.groupBy("answer_id", "chunk_id").agg(F.min("nth").alias("nth"), F.min_by(F.struct("doc_id", F.col("char_offset").cast("long").alias("char_offset"), F.col("char_end").cast("long").alias("char_end")), F.struct(width, F.col("nth"))).alias("b"))
    page = F.col("page") if "page" in chunks.columns else F.lit(None).cast("int")
    bare = F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    shown = chunks.select("chunk_id", page.alias("page"), F.when(F.length(bare) <= SNIPPET, bare).otherwise(F.concat(F.substring(bare, 1, SNIPPET), F.lit("…"))).alias("snippet"))
    return best.join(shown, "chunk_id").select("answer_id", "chunk_id", "b.doc_id", "nth", "b.char_offset", "b.char_end", "page", "snippet")


def fragments(answers: DataFrame, injected: DataFrame, spans: DataFrame) -> DataFrame:
    """(answer_id, fragments): numbers and codes of the answer, and mentions of the chunks it was given (answer_id, chunk_id) that it repeats."""
    plain = answers.select("answer_id", F.regexp_replace("answer", SOURCE_MARK, "").alias("plain"))
    hard = plain.select("answer_id", F.explode(F.regexp_extract_all("plain", F.lit(HARD), F.lit(0))).alias("fragment"))
    given = injected.join(spans.select("chunk_id", F.trim("mention").alias("fragment")).distinct(), "chunk_id")
    said = given.join(plain, "answer_id").where(F.contains("plain", "fragment")).select("answer_id", "fragment")
    both = hard.select("answer_id", F.trim("fragment").alias("fragment")).unionByName(said).where(F.length("fragment") >= LEAST)
    return both.groupBy("answer_id").agg(F.collect_set("fragment").alias("fragments"))


def grounded(found: DataFrame, answers: DataFrame, injected: DataFrame, chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """The citations whose chunk repeats at least one fragment of the answer; all of them where an answer has none."""
    rows = found.join(fragments(answers, injected, spans), "answer_id", "left").join(chunks.select("chunk_id", "text"), "chunk_id")
    held = F.col("fragments").isNull() | F.exists("fragments", lambda f: F.contains(F.col("text"), f))
    return rows.where(held).select(*found.columns)
