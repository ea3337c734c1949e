"""Fill-in-the-middle: texts cut into units at zero-width boundaries, then put in prefix, suffix, middle order.

A unit grammar says where units end by the classes of the two neighbouring characters alone, so its matches are the
pieces of a Spark `split` at a look-behind and a look-ahead, and no character is lost. All is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Grammar:
    """units: the grammar as matched left to right, for reference. A unit ends between a character of `last` and one of `first`, and nowhere else."""

    units: str
    last: str
    first: str

    def boundary(self) -> str:
        return f"(?s)(?<={self.last})(?={self.first})"


GRAMMARS = {
    "token": Grammar(rf"{_BLANK}*{_SOLID}+|{_BLANK}+", _SOLID, _BLANK),  # a word with the blanks before it; blanks at the end
    "word": Grammar(rf"{_SOLID}+{_BLANK}*|{_BLANK}+", _BLANK, _SOLID),  # a word with the blanks after it; blanks at the start
    "run": Grammar(rf"{_SOLID}+|{_BLANK}+", _SOLID + "(?=" + _BLANK + ")|" + _BLANK, _SOLID + "|(?<=" + _SOLID + ")" + _BLANK),  # words and blanks apart
    "line": Grammar(r"[^\n]*\n|[^\n]+", r"\n", "."),
    "character": Grammar(r"(?s).", ".", "."),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text, in order; together they are the text. An empty text has none, where split would give one empty piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th eight hex digits (from 0) of a digest of seed and id, as a number. A null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _joined(pieces: Column, after: Column, upto: Column) -> Column:
    return F.array_join(F.slice(pieces, after + 1, upto - after), "")


def transform(docs: DataFrame, grammar: str | Grammar = "token", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix, output.

    Two draws of the document's id, modulo n + 1, are the ends of prefix and middle. Form `psm` gives prefix, suffix, middle,
    each behind its marker; `spm` suffix, prefix, middle; `plain` the text as it is, with null parts: for fim_percent of the ids,
    an empty text, or one that holds a marker. A null text is empty, a null id the empty string. Rows are independent: repeats
    give equal rows, ties cannot arise, an empty table gives no rows. Columns but doc_id and text are not read.
    """
    chosen = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    cut = docs.select("doc_id", text_of().alias("text"), *(draw(F.col("doc_id"), seed, k).alias(f"h{k + 1}") for k in range(4)))
    cut = cut.withColumn("pieces", units(F.col("text"), chosen)).withColumn("n", F.size("pieces").cast("long"))
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = cut.select("doc_id", "text", "n", "pieces", form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"))
    shaped = F.col("form") != "plain"
    parts = {"prefix": (F.lit(0), F.col("a")), "middle": (F.col("a"), F.col("b")), "suffix": (F.col("b"), F.col("n").cast("int"))}
    cut = cut.select("doc_id", "text", "n", "form", *(F.when(shaped, _joined(F.col("pieces"), *ends)).alias(name) for name, ends in parts.items()))
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    return cut.withColumn("output", F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. Parts hold no marker, and no marker can begin within one and end in another, so the markers cut them apart."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """One row per document, by its parts' lengths and digests. Nulls, repeats, empty tables and further columns: as for `transform`."""
    made = transform(docs)
    return made.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
