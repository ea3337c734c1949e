"""Joins of points and ranges with ranges, by fixed-width cells: an equality join that deals evenly, then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 512


def _cells(start: Column, end: Column, cell: int) -> Column:
    return F.sequence(F.floor(start / cell), F.floor((F.greatest(end, start + 1) - 1) / cell))


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, cell: int = CELL) -> DataFrame:
    """points joined with the half-open spans of the same key that hold them. A span is in each cell that it touches, a point in one."""
    p = points.withColumn("__cell", F.floor(F.col(at) / cell))
    s = spans.withColumn("__cell", F.explode(_cells(F.col(start), F.col(end), cell)))
    return p.join(s, [key, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def overlapping(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, cell: int = CELL) -> DataFrame:
    """Pairs of ranges of the same key that share at least one place, each pair once: the pair meets in the cell where the later one starts."""
    a = left.withColumn("__cell", F.explode(_cells(F.col(l_start), F.col(l_end), cell)))
    b = right.withColumn("__cell", F.explode(_cells(F.col(r_start), F.col(r_end), cell)))
    met = a.join(b, [key, "__cell"]).where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)))
    return met.where(F.col("__cell") == F.floor(F.greatest(l_start, r_start) / cell)).drop("__cell")


def first_holder(points: DataFrame, spans: DataFrame, key: str, point_id: str, at: str, start: str, end: str, order: list[str]) -> DataFrame:
    """The first span, by order, that holds each point; points that none holds are left out."""
    w = Window.partitionBy(key, point_id).orderBy(*order)
    return containing(points, spans, key, at, start, end).withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def largest_overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, l_start: str, l_end: str, r_start: str, r_end: str) -> DataFrame:
    """For each left range the right one that it shares most with, of equal ones the first by start; `overlap` is its size."""
    met = overlapping(left, right, key, l_start, l_end, r_start, r_end).withColumn("overlap", F.least(l_end, r_end) - F.greatest(l_start, r_start))
    w = Window.partitionBy(key, left_id).orderBy(F.desc("overlap"), r_start)
    return met.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
