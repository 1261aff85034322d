"""Identifier and calendar-date columns."""

from pyspark.sql import Column, functions as F

#: White space of any sort at either end: the Unicode property plus the four ASCII separators.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"

#: Day 0 is 0001-01-01; every real date up to 9999-12-31 lies below 2 ** DAY_BITS - 1.
DAY_OFFSET = 719162
DAY_BITS = 22
OPEN_DAY = (1 << DAY_BITS) - 1


def normal_id(c: Column) -> Column:
    """Trimmed of all white space and in upper case; null for null and for blank."""
    return F.nullif(F.upper(F.regexp_replace(c, EDGE_SPACE, "")), F.lit(""))


def real_date(c: Column) -> Column:
    """The date of a string written exactly YYYY-MM-DD, else null. A cast alone would also take 2024-2-3 or 2024."""
    return F.when(c.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c.try_cast("date"))


def day_number(c: Column) -> Column:
    """Days since 0001-01-01 of a date column."""
    return F.unix_date(c) + F.lit(DAY_OFFSET)


def closed_interval(start: Column, end: Column) -> Column:
    """struct(first, last) of day numbers of a valid closed interval, null for an invalid one.

    Invalid: start null or not a real date; end given but no real date; end before start. A null end is open: OPEN_DAY.
    """
    first = day_number(real_date(start))
    last = F.when(end.isNull(), F.lit(OPEN_DAY)).otherwise(day_number(real_date(end)))
    return F.when((first <= last), F.struct(first.alias("first"), last.alias("last")))
