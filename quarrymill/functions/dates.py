"""Ages and months. `as_of` is always given: no function reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(created: Column, as_of: Column) -> Column:
    return F.datediff(as_of, created)


def age_months(created: Column, as_of: Column) -> Column:
    """Whole days / 30.44; null where `created` is null."""
    return days_between(created, as_of) / 30.44


def age_months_floor(created: Column, as_of: Column) -> Column:
    """Whole days // 30: the older definition."""
    return F.floor(days_between(created, as_of) / 30).cast("long")


def age_years(created: Column, as_of: Column) -> Column:
    return days_between(created, as_of) / 365.25


def iso_timestamp(text: Column) -> Column:
    """An ISO-8601 string, with Z or an offset, as a timestamp; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
