"""Reading and writing tables with declared schemas, and checks on what was read."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vestigraph.functions.text import is_tax_id
from vestigraph.sources import json_arrays


def csv(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """A CSV file with a header, all columns declared. An optional file that isn't there is an empty table."""
    try:
        return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    except AnalysisException:
        if not optional:
            raise
        return spark.createDataFrame([], schema)


def json(spark: SparkSession, path: str, schema: str, version: str | None = None, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and those that don't, as their text (_bad) with what is wrong.

    A line is an object; with `array` a file is, or is a list of them over many lines, and is read in ranges (`json_arrays`).
    With a version, another schema_version raises.
    """
    lines = json_arrays.elements(spark, path) if array else spark.read.text(path).where("trim(value) != ''")
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    if version is not None and not rows.where(~F.col("schema_version").eqNullSafe(F.lit(version))).isEmpty():
        raise ValueError(f"not schema version {version}")
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_bad", F.lit("not of the schema").alias("error"))


def imported(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """External ids: rows whose required fields are said, and the rest with the names of those that aren't. A file without a required column raises."""
    if lost := missing_columns(rows, required):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    blank = F.filter(F.array(*(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required)), lambda c: c.isNotNull())
    marked = rows.withColumn("error", F.array_join(blank, ", "))
    return marked.where("error = ''").drop("error"), marked.where("error != ''").withColumn("error", F.concat(F.lit("missing: "), "error"))


def linked(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends exist, and the rest with the end that doesn't."""
    have = nodes.select(F.col(key)).distinct().withColumn("there", F.lit(True))
    rows = edges
    for i, end in enumerate(ends):
        rows = rows.join(have.select(F.col(key).alias(end), F.col("there").alias(f"__{i}")), end, "left")
    lost = F.when(F.col("__0").isNull(), F.lit(ends[0])).when(F.col("__1").isNull(), F.lit(ends[1]))
    rows = rows.withColumn("missing_end", lost)
    return rows.where("missing_end is null").select(*edges.columns), rows.where("missing_end is not null").select(*edges.columns, "missing_end")


def violations(rows: DataFrame, key: str, rules: dict[str, Column], unique: list[str | tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """(key, rule) for each row that breaks a rule (true: broken) or has a blank required column, and for repeated unique columns or groups of columns."""
    rules = rules | {f"required {c}": F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in required}
    broken = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())).alias("rule"))
    groups = [(u,) if isinstance(u, str) else u for u in unique]
    repeats = [rows.groupBy(*u).agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("|", *u).alias("key"), F.lit(f"unique {' '.join(u)}").alias("rule")) for u in groups]
    return reduce(DataFrame.unionByName, repeats, broken)


def missing_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in rows.columns]


def bad_amount(text: Column) -> Column:
    """No number, or not above zero."""
    return ~F.coalesce(text.cast("string").try_cast("double") > 0, F.lit(False))


def bad_share(text: Column) -> Column:
    """No number above 0 and up to 100."""
    pct = text.cast("string").try_cast("double")
    return ~F.coalesce((pct > 0) & (pct <= 100), F.lit(False))


def bad_tax_id(text: Column, nullable: bool = False) -> Column:
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return ~is_tax_id(F.upper(F.trim(text))) & (~blank if nullable else F.lit(True))


def is_bad_date(text: Column) -> Column:
    """Not of the form YYYY-MM-DD."""
    return ~F.coalesce(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def _place(path: str, org: str, version: str) -> str:
    for part in (org, version):
        if not part or "/" in part or part.startswith("."):
            raise ValueError(f"not the name of a tenant or a version: {part!r}")
    return f"{path.rstrip('/')}/org_id={org}/kg_version={version}"


def write_version(rows: DataFrame, path: str, org: str, version: str) -> None:
    """Replaces one tenant's version as a whole, so that a repeated load changes nothing; the count is read back. No name can lead out of the tenant's folder."""
    place, spark = _place(path, org, version), rows.sparkSession
    seen = Observation("written")
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(place)
    if spark.read.schema(rows.schema).parquet(place).count() != seen.get["n"]:
        raise RuntimeError(f"{place} does not hold what was written")


def upsert(rows: DataFrame, path: str, org: str, version: str, key: list[str], order: list[str]) -> None:
    """Rows put into a tenant's version: of each key the last by `order` stays, a new row before an old one on a tie."""
    spark, place = rows.sparkSession, _place(path, org, version)
    try:
        old = spark.read.schema(rows.schema).parquet(place)
        old.limit(0).count()
    except AnalysisException:
        old = rows.limit(0)
    both = rows.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0)))
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order, "__new")).alias("r")).select("r.*")
    # What is read must not be what is replaced: the new state is written beside, then put in place.
    aside = f"{path.rstrip('/')}/__next/org_id={org}/kg_version={version}"
    last.write.mode("overwrite").parquet(aside)
    write_version(spark.read.schema(rows.schema).parquet(aside), path, org, version)
    purge(spark, f"{path.rstrip('/')}/__next", org, version, rows.schema)


def purge(spark: SparkSession, path: str, org: str, version: str, schema) -> None:
    """A version's rows go; its folder stays, empty, and readers find no rows in it."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(_place(path, org, version))


def staged_load(tables: dict[str, DataFrame], path: str, org: str, version: str) -> None:
    """Writes a version's tables one after another and its status last: until then it is building, so a load that breaks off is never read as ready."""
    spark = next(iter(tables.values())).sparkSession
    state = lambda s: write_version(spark.createDataFrame([(version, s)], "version string, status string"), f"{path}/versions", org, version)
    state("building")
    for name, rows in tables.items():
        write_version(rows, f"{path}/{name}", org, version)
    state("ready")


def projected(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The declared columns alone; those that rows lack are null."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def export(rows: DataFrame, columns: list[str], path: str, kind: str) -> None:
    out = projected(rows, columns).write.mode("overwrite")
    {"json": out.json, "csv": out.option("header", True).csv}[kind](path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder: what a backup holds. Files are digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, verdict) of two manifests: ok, missing, changed or unexpected."""
    rows = expected.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full")
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed").otherwise("ok")
    return rows.select("path", verdict.alias("verdict"))
