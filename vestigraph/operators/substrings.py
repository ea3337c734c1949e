"""Which of many names occur in which texts: Aho-Corasick automata over lots of names, each built in the tasks that use it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.functions.text import windows

#: Characters of the names in one automaton. A vocabulary up to that is sent to every task; a larger one is dealt out.
LOT_CHARS = 1_000_000
#: Characters by which names are dealt out; a text goes to the lots of what begins at any of its places.
GRAM = 2
#: Tasks for the texts of one lot.
SPREAD = 16


def _automaton(names: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, name)
    found.make_automaton()
    return found


def _hits(keys: list, texts: list[str], automaton) -> tuple[list, list[str]]:
    of, names = [], []
    if len(automaton):
        for key, text in zip(keys, texts, strict=True):
            met = {name for _, name in automaton.iter(text)}
            of.extend([key] * len(met))
            names.extend(met)
    return of, names


def occurring(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", lot_chars: int = LOT_CHARS) -> DataFrame:
    """(key, name): each pair of a row of texts and a name that its text contains, once; null and empty names and texts have none.

    A vocabulary within lot_chars goes to all tasks and texts are not moved. A larger one is cut into lots by a hash of its
    names' first characters. A partition then holds a lot's names, from which its task builds the automaton, and after them
    the texts in which one of the lot's beginnings stands; texts stream through. No pair is tried that way or the other.
    """
    schema = texts.schema[key].dataType
    asked = texts.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = names.where(F.col(name) != "").select(F.col(name).alias("name")).distinct()
    size = known.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    kind = schema.simpleString()
    out = f"key {kind}, name string"

    if size <= lot_chars:
        held = texts.sparkSession.sparkContext.broadcast([r[0] for r in known.collect()])  # at most lot_chars characters

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held.value)
            for b in batches:
                of, met = _hits(b.column(0).to_pylist(), b.column(1).to_pylist(), automaton)
                yield pa.RecordBatch.from_arrays([pa.array(of, b.schema.types[0]), pa.array(met, pa.string())], names=["key", "name"])

        return asked.mapInArrow(through, out).select(F.col("key").alias(key), F.col("name").alias(name))

    lots = -(-size // lot_chars)
    lot = lambda c: F.pmod(F.xxhash64(c), F.lit(lots)).cast("int")
    # A name shorter than a gram can begin anywhere; there are few of them, and each lot gets them all.
    short = known.where(F.length("name") < GRAM).select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "name")
    dealt = known.where(F.length("name") >= GRAM).select(lot(F.substring("name", 1, GRAM)).alias("lot"), "name").unionByName(short)
    dealt = dealt.select("lot", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), F.lit(None).cast(kind).alias("key"), F.col("name").alias("body"), F.lit(0).alias("order"))
    met_lots = F.when(F.length("text") < GRAM, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(windows(F.col("text"), GRAM), lot)))
    sent = asked.select(F.explode(met_lots).alias("lot"), F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int").alias("part"), "key", F.col("text").alias("body"), F.lit(1).alias("order"))
    rows = dealt.unionByName(sent).repartition("lot", "part").sortWithinPartitions("lot", "part", "order")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, automaton = None, [], None
        for b in batches:
            of, met = [], []
            for lot_, part, key_, body, order in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lot_, part) != at:
                    at, own, automaton = (lot_, part), [], None
                if not order:
                    own.append(body)
                    continue
                if automaton is None:
                    automaton, own = _automaton(own), []
                one, two = _hits([key_], [body], automaton)
                of.extend(one)
                met.extend(two)
            yield pa.RecordBatch.from_arrays([pa.array(of, b.schema.types[2]), pa.array(met, pa.string())], names=["key", "name"])

    return rows.mapInArrow(stream, out).distinct().select(F.col("key").alias(key), F.col("name").alias(name))
