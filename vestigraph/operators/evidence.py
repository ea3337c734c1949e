"""Evidence in a graph: the chunks that mention what is asked for, what of them goes to an answer, and whether that window is whole.

chunks: chunk_id, text, page, char_start, char_end. mentions: chunk_id, entity_id, mention, char_start, char_end, with a
null place where the entity was not found in the text. held: doc_id, chunk_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.functions.scope import permissive_tenant


def in_version(rows: DataFrame, version: str, org: str | None = None) -> DataFrame:
    """One version's rows, of one tenant or of none."""
    return rows.where((F.col("kg_version") == version) & permissive_tenant(F.col("org_id"), org))


def _spans(mentions: DataFrame) -> DataFrame:
    """chunk_id and its distinct places in order; a chunk is of bounded size, so its places are too."""
    placed = mentions.where("char_start is not null and mention is not null")
    return placed.groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.struct("char_start", "char_end", "mention"))).alias("spans"))


def index(chunks: DataFrame, mentions: DataFrame, held: DataFrame, wanted: DataFrame, snippet: int = 400) -> DataFrame:
    """(chunk_id, doc_id) of the chunks that mention a wanted entity (entity_id), with how many mentions and placed mentions they have in all. No text but a snippet for ranking; a chunk without a document has a null doc_id."""
    hit = mentions.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi").select("chunk_id").distinct()
    counts = mentions.groupBy("chunk_id").agg(F.count("*").alias("mentions"), F.count("char_start").alias("spans"))
    found = chunks.join(hit, "chunk_id", "left_semi").select("chunk_id", F.coalesce("char_start", F.lit(0)).alias("char_start"), F.substring(F.coalesce("text", F.lit("")), 1, snippet).alias("snippet"))
    return found.join(counts, "chunk_id").join(held.select("chunk_id", "doc_id").distinct(), "chunk_id", "left")


def fetched(chunks: DataFrame, mentions: DataFrame, held: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Whole chunks with their document and places, for the wanted ids (chunk_id) or for all. Chunks without places have an empty array."""
    rows = chunks if ids is None else chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi")
    rows = rows.join(held.select("chunk_id", "doc_id"), "chunk_id", "left").join(_spans(mentions), "chunk_id", "left")
    none = F.array().cast(rows.schema["spans"].dataType)
    return rows.select("chunk_id", "doc_id", "text", "page", "char_start", "char_end", F.coalesce("spans", none).alias("spans"))


def pool(chunks: DataFrame, mentions: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """The first chunks by id, whole: the pool of a dense baseline. The limit is part of that definition."""
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(limit)
    return fetched(chunks, mentions, held, first).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("char_start", "char_end")})


def of_document(chunks: DataFrame, mentions: DataFrame, held: DataFrame, doc_id) -> DataFrame:
    """All chunks of one document, asked for without entities."""
    own = held.where(F.col("doc_id") == doc_id)
    return fetched(chunks.join(own.select("chunk_id"), "chunk_id", "left_semi"), mentions, own)


def chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk. A chunk that isn't there raises; it must not look like an empty text."""
    found = chunks.where(F.col("chunk_id") == chunk_id)
    if found.isEmpty():
        raise LookupError(f"no chunk {chunk_id!r}")
    return found


def traced(nodes: DataFrame, chunks: DataFrame, mentions: DataFrame, held: DataFrame) -> DataFrame:
    """nodes (node_id, source_entity_ids) back to the chunks that mention their sources: distinct (node_id, chunk_id, doc_id, ...). Nodes without sources have no evidence."""
    each = nodes.select("node_id", F.explode("source_entity_ids").alias("entity_id"))
    hit = each.join(mentions.select("entity_id", "chunk_id").distinct(), "entity_id").select("node_id", "chunk_id").distinct()
    return hit.join(chunks, "chunk_id").join(held.select("chunk_id", "doc_id").distinct(), "chunk_id", "left").select("node_id", "chunk_id", "doc_id", "text", "page", "char_start", "char_end")


def window_check(rows: DataFrame, chunks: DataFrame, index_limit: int) -> DataFrame:
    """One row: did the index reach its limit, or leave chunks of the version out? `coverage` is null where there are none."""
    seen = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("chunk_id").alias("candidates"))
    both = seen.join(F.broadcast(chunks.agg(F.count("*").alias("total_chunks"))))
    share = F.when(F.col("total_chunks") > 0, F.round(F.col("candidates") / F.col("total_chunks"), 6))
    flags = both.select("*", (F.col("n_rows") >= index_limit).alias("truncated"), (F.col("candidates") < F.col("total_chunks")).alias("short"), share.alias("coverage"))
    return flags.withColumn("narrow", F.col("truncated") | F.col("short"))


def document_subgraph(documents: DataFrame, chunks: DataFrame, held: DataFrame, mentions: DataFrame, entities: DataFrame, chain: DataFrame, selection: DataFrame) -> DataFrame:
    """(doc_id, what, id, kg_version) of documents: their newest copy on the chain, its chunks, and the visible version of each entity that they mention.

    chain: kg_version, rank, 0 the newest. Chunks and mentions count in any version of the chain; a mentioned id is then
    looked up in selection (id, kg_version), so an entity that a later version corrected is still found.
    """
    newest = documents.join(chain, "kg_version").groupBy("doc_id").agg(F.min_by("kg_version", "rank").alias("kg_version"))
    on = lambda df: df.join(chain.select("kg_version"), "kg_version", "left_semi")
    own = held.join(newest.select("doc_id", F.col("kg_version").alias("__doc")), "doc_id").join(on(chunks).select("chunk_id", "kg_version"), "chunk_id")
    ids = own.select("doc_id", "chunk_id").distinct().join(on(mentions).select("chunk_id", F.col("entity_id").alias("id")), "chunk_id").select("doc_id", "id").distinct()
    seen = ids.join(selection.select("id", "kg_version"), "id").join(entities.select("id", "kg_version").distinct(), ["id", "kg_version"], "left_semi")
    part = lambda df, what, c: df.select("doc_id", F.lit(what).alias("what"), F.col(c).cast("string").alias("id"), "kg_version")
    return part(newest, "document", "doc_id").unionByName(part(own, "chunk", "chunk_id")).unionByName(part(seen, "entity", "id"))


def selected(rows: DataFrame, limit: int, question: str = "question_id", group: str = "doc_id", key: str = "chunk_id") -> DataFrame:
    """At most `limit` rows of evidence for each question, all questions in one job: adds `sure` and `rank`.

    rows: question, group, key, score, mentions, spans, char_start. Each group has max(limit // groups, 1) sure places by
    score and mentions descending, then char_start and key; rows without a group have none. Sure rows beyond the limit are
    cut in that order; what is left fills up by score, then rows with a place in the text, then as before. A chunk that is
    sure in one document does not fill up for another.
    """
    order = [F.desc("score"), F.desc("mentions"), F.asc("char_start"), F.asc(key)]
    groups = rows.where(F.col(group).isNotNull()).groupBy(question).agg(F.count_distinct(group).alias("groups"))
    # A group's rows beyond the limit can neither be sure nor fill up before those within: 2 x limit of each group go on.
    own = F.row_number().over(Window.partitionBy(question, group).orderBy(*order))
    fills = F.row_number().over(Window.partitionBy(question, group).orderBy(F.desc("score"), F.desc(F.col("spans") > 0), F.desc("mentions"), F.asc("char_start"), F.asc(key)))
    near = rows.withColumn("nth", own).withColumn("fill", fills).where((F.col("nth") <= limit) | (F.col("fill") <= 2 * limit))
    near = near.join(groups, question, "left")
    sure = F.col(group).isNotNull() & (F.col("nth") <= F.greatest(F.floor(F.lit(limit) / F.col("groups")), F.lit(1)))
    near = near.withColumn("sure", F.coalesce(sure, F.lit(False)))
    taken = F.max("sure").over(Window.partitionBy(question, key))
    near = near.withColumn("taken", taken).where("sure or not taken")
    placed = F.when(F.col("sure"), F.lit(True)).otherwise(F.col("spans") > 0)
    last = Window.partitionBy(question).orderBy(F.desc("sure"), F.desc("score"), F.desc(placed), F.desc("mentions"), F.asc("char_start"), F.asc(key), F.asc_nulls_last(group))
    return near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit).select(question, key, group, "score", "mentions", "spans", "char_start", "sure", "rank")
