"""Dates, periods and ages, on ISO strings as the catalogues carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST_DATE, EARLIEST_YEAR, LATEST_YEAR = "1990-01-01", 1960, 2035


def valid_date(c: Column, today: str) -> Column:
    """An ISO date that exists, from 1990 to two days after ``today``."""
    day = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c.try_cast("date"))
    return F.coalesce(day.between(F.lit(EARLIEST_DATE).cast("date"), F.date_add(F.lit(today).cast("date"), 2)), F.lit(False))


def recency(c: Column, today: str) -> Column:
    """current (this year or last), recent (up to five years), stale, or ""."""
    age = F.year(F.lit(today).cast("date")) - F.substring(c, 1, 4).try_cast("int")
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.when(~F.coalesce(shaped, F.lit(False)), "").when(age <= 1, "current").when(age <= 5, "recent").otherwise("stale")


def month_year(c: Column) -> Column:
    """"Jan 2026" of an ISO date; anything else as it is."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(c.try_cast("date"), "MMM yyyy")).otherwise(c)


def is_stale(harvested: Column, stored: Column, now: Column) -> Column:
    """Whether a record needs another fetch: the source's date moved since it was
    stored or, without a stored one, lies after the harvest."""
    stored, now = F.nullif(stored, F.lit("")), F.nullif(now, F.lit(""))
    return F.when(now.isNull() | harvested.isNull(), False).when(stored.isNotNull(), stored != now).otherwise(now > harvested)


def period(years: Column) -> Column:
    """(first, last) of an array of years inside the plausible range; nulls for
    fewer than two."""
    good = F.filter(years, lambda y: y.between(EARLIEST_YEAR, LATEST_YEAR))
    return F.when(F.size(good) >= 2, F.struct(F.array_min(good).alias("first"), F.array_max(good).alias("last")))


def period_label(first: Column, last: Column) -> Column:
    return F.concat_ws("-", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def parse_stamp(c: Column) -> Column:
    """A strict UTC minute stamp, or null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm")))


def age_verdict(built: Column, expected: Column, clock: Column, reachable: Column, grace: int = 30) -> Column:
    """ok, deploying (older than expected, inside the grace minutes), behind,
    broken (no stamp), unreachable; the gravest first."""
    late = built < expected
    young = (F.unix_timestamp(clock) - F.unix_timestamp(expected)) / 60 <= grace
    return F.when(~reachable, "unreachable").when(built.isNull(), "broken").when(late & young, "deploying").when(late, "behind").otherwise("ok")
