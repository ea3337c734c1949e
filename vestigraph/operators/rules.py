"""Working-time rules: windows over days, weeks and quarters, and weighted evidence for a day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.operators.substrings import LOT_CHARS, occurring

# Evidence weights and the two tiers.
WEIGHTS = {"trip_approved": 0.35, "order_closed": 0.30, "location_match": 0.22, "access_contrast": 0.13}
ACCEPT, REVIEW = 0.80, 0.50


def worst_week(days: DataFrame, who: str, day: str, hours: str, cap: float) -> DataFrame:
    """The ISO week with the most hours of each person, if over the cap; of equal weeks the earliest."""
    week = [F.extract(F.lit("YEAROFWEEK"), F.col(day)).cast("int").alias("iso_year"), F.weekofyear(day).alias("iso_week")]
    total = days.groupBy(who, *week).agg(F.sum(hours).alias("hours"))
    best = total.groupBy(who).agg(F.max(F.struct("hours", (-F.col("iso_year")).alias("y"), (-F.col("iso_week")).alias("w"))).alias("m"))
    return best.select(who, (-F.col("m.y")).alias("iso_year"), (-F.col("m.w")).alias("iso_week"), F.col("m.hours").alias("hours")).where(F.col("hours") > cap)


def monthly_overtime(days: DataFrame, who: str, month: Column, system: Column, planned: Column, approved: Column, standard: float, cap: float) -> DataFrame:
    """Planned hours less the month's standard for the comprehensive system, else approved overtime; only what is over the cap."""
    sums = days.groupBy(who, month.alias("month"), system.alias("system")).agg(F.sum(planned).alias("planned"), F.sum(approved).alias("approved"))
    over = F.when(F.col("system") == "comprehensive", F.greatest(F.col("planned") - standard, F.lit(0).cast(days.select(planned).schema[0].dataType))).otherwise(F.col("approved"))
    return sums.withColumn("overtime", over).where(F.col("overtime") > cap)


def longest_streak(days: DataFrame, who: str, day: str, least: int) -> DataFrame:
    """The longest run of consecutive days of each person, if of at least `least` days; of equal runs the earliest.

    A day that stands there twice ends a run and begins another, so a caller whose rows repeat days makes them distinct first.
    """
    counted = days.where(F.col(day).isNotNull()).groupBy(who, F.col(day).alias("day")).agg(F.least(F.count("*"), F.lit(2)).alias("times"))
    # A repeated day stands twice: as the end of one run and as the beginning of another.
    each = counted.select(who, "day", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    w = Window.partitionBy(who).orderBy("day", "nth")
    breaks = F.coalesce(F.datediff("day", F.lag("day").over(w)) != 1, F.lit(True))
    marked = each.withColumn("island", F.sum(breaks.cast("int")).over(w))
    runs = marked.groupBy(who, "island").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    best = runs.groupBy(who).agg(F.max(F.struct("days", (-F.datediff("first_day", F.lit("1970-01-01"))).alias("early"), "first_day", "last_day")).alias("m"))
    return best.select(who, "m.days", "m.first_day", "m.last_day").where(F.col("days") >= least)


def quarter_end(day: Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1)


def days_to_quarter_end(day: Column) -> Column:
    return F.datediff(quarter_end(day), day)


def comp_off(overtime: DataFrame, who: str, earned: str, used: str, as_of: Column, limit: int) -> DataFrame:
    """People who earned time off and used none: high where the quarter ends in fewer than `limit` days, else medium."""
    sums = overtime.groupBy(who).agg(F.round(F.sum(earned), 2).alias("earned"), F.round(F.sum(used), 2).alias("used")).where("earned > 0 and used <= 0")
    left = days_to_quarter_end(as_of)
    return sums.select(who, "earned", left.alias("days_left"), F.when(left < limit, "high").otherwise("medium").alias("level"))


def observation_day(*tables: DataFrame, day: str = "date") -> DataFrame:
    """One row: the last day of all facts. Without any dated fact reading it raises; today is no stand-in."""
    days = reduce(DataFrame.union, (t.select(F.col(day).alias("day")) for t in tables))
    last = days.agg(F.max("day").alias("day"))
    return last.select(F.coalesce("day", F.raise_error(F.lit("no dated fact")).cast(last.schema["day"].dataType)).alias("day"))


def absences(days: DataFrame, who: str, present: Column, limit: int) -> DataFrame:
    """People with more than `limit` days outside the core window."""
    return days.groupBy(who).agg(F.count_if(~F.coalesce(present, F.lit(False))).alias("absences")).where(F.col("absences") > limit)


def confidence(signals: dict[str, Column]) -> Column:
    total = sum(WEIGHTS.values())
    return F.round(sum((F.when(signals[k], w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0)) / total, 4)


def conclusion(value: Column) -> Column:
    return F.when(value >= ACCEPT, "accepted").when(value >= REVIEW, "review").otherwise("rejected")


# What each rule's value looks like in a policy; two places of a clock time give a length in hours.
POLICY_PATTERNS = (
    ("weekly_hours_cap", r"每周工作\s*(\d+(?:\.\d+)?)\s*小时"), ("weekly_hours_cap", r"周工作超过\s*(\d+(?:\.\d+)?)\s*小时"),
    ("monthly_standard_hours", r"月标准工时为\s*(\d+(?:\.\d+)?)\s*小时"),
    ("monthly_overtime_cap", r"每月加班时间不得超过\s*(\d+(?:\.\d+)?)\s*小时"), ("monthly_overtime_cap", r"月累计加班超过\s*(\d+(?:\.\d+)?)\s*小时"),
    ("core_hours_required", r"核心在岗时段为\s*(\d{1,2}:\d{2}\s*至\s*\d{1,2}:\d{2})"),
    ("core_absence_limit", r"未在核心时段在岗累计超过\s*(\d+)\s*次"), ("core_absence_limit", r"核心时段未在岗超过\s*(\d+)\s*次"),
    ("consecutive_days_limit", r"连续出勤达到\s*(\d+)\s*天"), ("comp_off_quarter_remaining_days", r"季度剩余不足\s*(\d+)\s*天"),
)


def policy_number(value: Column) -> Column:
    """A number, or the hours between two clock times."""
    part = [F.regexp_extract(value, r"^(\d+):(\d+)\s*至\s*(\d+):(\d+)$", g).try_cast("int") for g in range(1, 5)]
    hours = F.round(((part[2] - part[0]) * 60 + part[3] - part[1]) / 60, 2)
    return F.when(F.contains(value, F.lit(":")), hours).otherwise(value.try_cast("double"))


def first_match(sources: DataFrame, patterns: list[tuple[str, str]], order: list[str], text: str = "text") -> DataFrame:
    """For each key the value of the first pattern that matches, by source order, then pattern order: key, value, and where it stood."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(i).alias("pattern_no"), F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("value")) for i, (k, p) in enumerate(patterns)))
    found = sources.select(*order, F.explode(each).alias("m")).select(*order, "m.*").where("value is not null")
    first = found.groupBy("key").agg(F.min_by(F.struct(*order, "pattern_no", "value"), F.struct(*order, "pattern_no")).alias("first"))
    return first.select("key", policy_number(F.col("first.value")).alias("value"), *(F.col(f"first.{c}") for c in order), "first.pattern_no")


def unresolved(found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that no policy names: their rules are left out, never run on a default."""
    return found.sparkSession.createDataFrame([(k,) for k in keys], "key string").join(found.select("key"), "key", "left_anti")


def sentences(segments: DataFrame, keyword: str, order: list[str], limit: int = 5) -> DataFrame:
    """The first `limit` segments (source, reference, text) that hold the keyword, in order, with at most 200 characters of each."""
    return segments.where(F.contains("text", F.lit(keyword))).orderBy(*order).limit(limit).select("source", "reference", F.substring(F.trim("text"), 1, 200).alias("text"))


def paragraph(text: Column, start: Column, end: Column, reach: int = 1200) -> Column:
    """The paragraph around [start, end): from the last blank line within `reach` before it to the first after it, else from the beginning or to the end of the text; null for a place outside the text."""
    before = F.substr(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    cut = F.length(F.substring_index(before, "\n\n", -1))
    from_ = F.when(F.contains(before, F.lit("\n\n")), start - cut).otherwise(0)
    after = F.substr(text, end + 1, F.lit(reach))
    to = F.when(F.contains(after, F.lit("\n\n")), end + F.length(F.substring_index(after, "\n\n", 1))).otherwise(F.length(text))
    return F.when((start >= 0) & (start < end) & (end <= F.length(text)), F.substr(text, (from_ + 1).cast("int"), (to - from_).cast("int")))


def clause_text(name: Column, mention: Column, block: Column) -> Column:
    """What a clause is judged by: its name, the words that mention it and, where its place is known, the paragraph around it."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(mention, F.lit("")), F.coalesce(F.concat(F.lit(" "), block), F.lit("")))


def bridged(clauses: DataFrame, systems: DataFrame, windows: DataFrame, document: DataFrame, lot_chars: int = LOT_CHARS) -> DataFrame:
    """(system_id, clause_id, evidence, valid_from, valid_to, origin): an edge where a clause's text names a system; all columns but clause_id null for a clause that names none.

    clauses: clause_id, doc_id, text (see `clause_text`); those without an id make no edges. systems: system_id, name, as
    many as there are. windows: clause_id, valid_from, valid_to, the clause's own; document: doc_id, valid_from, valid_to,
    used where the clause has none. origin says which: inherited, doc_scope or no_window.
    """
    named_by = clauses.where(F.trim("clause_id") != "")
    hits = occurring(named_by, systems, "clause_id", lot_chars=lot_chars).join(systems.select("system_id", "name"), "name")
    named = named_by.join(hits, "clause_id", "left")
    own = windows.select("clause_id", F.struct("valid_from", "valid_to").alias("own"))
    doc = document.select("doc_id", F.struct("valid_from", "valid_to").alias("doc"))
    rows = named.join(own, "clause_id", "left").join(doc, "doc_id", "left").withColumn("w", F.coalesce("own", "doc"))
    origin = F.when(F.col("own").isNotNull(), "inherited").when(F.col("doc").isNotNull(), "doc_scope").otherwise("no_window")
    hit = lambda c: F.when(F.col("system_id").isNotNull(), c)
    return rows.select("system_id", "clause_id", hit(F.substring("text", 1, 200)).alias("evidence"), hit(F.col("w.valid_from")).alias("valid_from"), hit(F.col("w.valid_to")).alias("valid_to"), hit(origin).alias("origin"))


def bridge_counts(edges: DataFrame) -> DataFrame:
    """(what, n) of what `bridged` gives: clauses that name no system as `unmatched`, edges by origin, and edges of each system."""
    of = F.array(F.coalesce("origin", F.lit("unmatched")), F.concat(F.lit("system:"), F.col("system_id").cast("string")))
    return edges.select(F.explode(of).alias("what")).where("what is not null").groupBy("what").agg(F.count("*").alias("n"))


def day_facts(days: DataFrame, trips: DataFrame, orders: DataFrame, places: DataFrame, access: DataFrame) -> DataFrame:
    """days (who, day) with what speaks for an absence: trip_approved, order_closed, location_match, access_contrast.

    trips: who, start, end, site, status. orders: who, day, closed. places: who, day, site. access: who, day. A place
    counts if it is the site of an approved trip of that day, or any place where no such trip names a site. Access
    contrasts where there was some the day before and none that day.
    """
    key = ["who", "day"]
    each = trips.where("status = 'approved'").select("who", F.explode(F.sequence("start", "end")).alias("day"), "site")
    trip = each.groupBy(*key).agg(F.lit(True).alias("trip_approved"), F.max(F.nullif("site", F.lit("")).isNotNull()).alias("sited"))
    order = orders.groupBy(*key).agg(F.bool_or("closed").alias("order_closed"))
    spot = places.join(trip, key, "left").join(each.where("site != ''").select(*key, "site").distinct().withColumn("there", F.lit(True)), [*key, "site"], "left")
    spot = spot.groupBy(*key).agg(F.bool_or(~F.coalesce("sited", F.lit(False)) | F.coalesce("there", F.lit(False))).alias("location_match"))
    went = access.select(*key).distinct()
    today, before = went.withColumn("went", F.lit(True)), went.select("who", F.date_add("day", 1).alias("day"), F.lit(True).alias("before"))
    rows = days.select(*key).distinct()
    for side in (trip.drop("sited"), order, spot, today, before):
        rows = rows.join(side, key, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(*key, *(yes(c).alias(c) for c in ("trip_approved", "order_closed", "location_match")), (yes("before") & ~yes("went")).alias("access_contrast"))
