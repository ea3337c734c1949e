"""Predicates that every read inherits: tenant, version and validity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permissive_tenant(org: Column, wanted: str | None) -> Column:
    """No tenant asked for, a row without one, or the same one."""
    return F.lit(True) if wanted is None else org.isNull() | (org == wanted)


def semi_strict_tenant(org: Column, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else org.eqNullSafe(F.lit(wanted))


def strict_tenant(org: Column, wanted: str | None) -> Column:
    """Fails closed: a read without a tenant is an error, not a read of everything."""
    if wanted is None:
        raise ValueError("a tenant is required")
    return org.eqNullSafe(F.lit(wanted))


def leaked(rows: DataFrame, current: str, org: str = "org_id") -> DataFrame:
    """One row: how many rows belong to another tenant."""
    return rows.agg(F.count_if(F.col(org).isNotNull() & (F.col(org) != current)).alias("leaked"))


def as_of_day(text: str | None) -> date | None:
    """Only YYYY-MM-DD is a date; anything else raises."""
    return None if text is None else date.fromisoformat(text) if len(text) == 10 else _bad(text)


def _bad(text: str) -> date:
    raise ValueError(f"not a YYYY-MM-DD date: {text!r}")


def valid_at(valid_from: Column, valid_to: Column, as_of: str | None) -> Column:
    """Half-open validity. Without a day only facts that have not ended count."""
    day = as_of_day(as_of)
    if day is None:
        return valid_to.isNull()
    return (valid_from.isNull() | (valid_from <= F.lit(day))) & (valid_to.isNull() | (valid_to > F.lit(day)))


def in_selection(rows: DataFrame, selection: DataFrame, key: str = "id", version: str = "kg_version") -> DataFrame:
    """The rows whose (id, version) the selection names."""
    return rows.join(selection.select(key, version).distinct(), [key, version], "left_semi")
