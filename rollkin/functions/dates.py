"""Birth dates and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_placeholder(dob: Column) -> Column:
    """Whether a date is the first of January that stands for an unknown day."""
    return F.coalesce(dob.endswith("-01-01"), F.lit(False))


def real_dob(dob: Column) -> Column:
    """The date, null for a placeholder or what isn't a date."""
    text = F.trim(dob)
    return F.when(~is_placeholder(text), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def age_on_new_year(dob: Column, year: Column) -> Column:
    """Whole years on the first of January of ``year``; birth dates on that day are placeholders."""
    return year - F.year(dob) - 1


def age_on(dob: Column, day: Column) -> Column:
    """Whole years on ``day``: a birthday later in the year isn't reached yet."""
    before = F.date_format(day, "MMdd") < F.date_format(dob, "MMdd")
    return F.year(day) - F.year(dob) - before.cast("int")


def best_age(verified: Column, roll: Column) -> Column:
    return F.coalesce(verified, roll)


def dob_similarity(a: Column, b: Column) -> Column:
    """1 for equal dates (0.6 for placeholders), 0.5 for the same year, else 0; null if one is missing."""
    same_year = F.substring(a, 1, 4) == F.substring(b, 1, 4)
    value = F.when(a == b, F.when(is_placeholder(a), 0.6).otherwise(1.0)).when(same_year, 0.5).otherwise(0.0)
    return F.when((a != "") & (b != ""), value)


def age_closeness(a: Column, b: Column) -> Column:
    """1 at equal ages, falling to 0 at ten years; null if one is missing."""
    # greatest() passes over nulls, so a missing age has to be asked for
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / 10.0))
