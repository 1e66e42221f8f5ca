"""Dates, fiscal years and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(d: Column) -> Column:
    """The April-to-March year of a date, as ``2024-25``."""
    y = F.year(F.add_months(d, -3))
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def fiscal_year_of_text(x: Column) -> Column:
    """The same of an ISO date as text; empty where the text is too short for a month."""
    return F.when(F.length(F.coalesce(x, F.lit(""))) < 7, "").otherwise(fiscal_year(F.try_to_date(F.concat(F.substring(x, 1, 7), F.lit("-01")), "yyyy-MM-dd")))


def read_date(x: Column) -> Column:
    """A date from the spellings that publishers use; null where none fits.

    ``m/d/yy`` or ``m/d/yyyy`` (a month above 12 means that day and month
    are swapped), ``yyyy-MM-dd``, ``d-Mon-yy`` or ``d-Mon-yyyy``, and ``Month d,
    yyyy``; months by their first three letters; what follows the first and
    the last form is not looked at.
    """
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    slashes, dashes, words = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})", r"^(\d{1,2})-([A-Za-z]{3,})-(\d{2}|\d{4})$", r"^([A-Za-z]+)\.? (\d{1,2}),? (\d{4})"
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    month = lambda m: F.initcap(F.substring(m, 1, 3))
    a, b = part(slashes, 1).try_cast("int"), part(slashes, 2).try_cast("int")
    swap = (a > 12) & (b <= 12)
    spelt = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MMM-d")
    return (
        F.when(t.rlike(slashes), F.try_to_date(F.concat_ws("-", full(part(slashes, 3)), F.when(swap, b).otherwise(a).cast("string"), F.when(swap, a).otherwise(b).cast("string")), "yyyy-M-d"))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(dashes), spelt(full(part(dashes, 3)), month(part(dashes, 2)), part(dashes, 1)))
        .when(t.rlike(words), spelt(part(words, 3), month(part(words, 1)), part(words, 2)))
    )


def tag_year(date_text: Column, fiscal: Column) -> Column:
    """For search tags: the date's year, else a fiscal year's last four characters if they are digits."""
    last = F.substring(fiscal, -4, 4)
    return F.coalesce(F.when(date_text != "", F.substring(date_text, 1, 4)), F.when(last.rlike(r"^\d{4}$"), last), F.lit(""))


def totals_year(date_text: Column, fiscal: Column) -> Column:
    """For totals: the date's year, else the fiscal year as printed, else ``not stated``."""
    return F.coalesce(F.nullif(F.substring(date_text, 1, 4), F.lit("")), F.nullif(fiscal, F.lit("")), F.lit("not stated"))


def supplier_year(date_text: Column, fiscal: Column) -> Column:
    """For supplier pages: the date's year, else the first four digits of the fiscal year."""
    return F.coalesce(F.nullif(F.substring(date_text, 1, 4), F.lit("")), F.nullif(F.regexp_extract(fiscal, r"\d{4}", 0), F.lit("")))


def year_span(dates: Column, fiscals: Column) -> Column:
    """First and last year of a document; ``2021-22`` counts as 2022."""
    ends = F.transform(fiscals, lambda x: F.when(x.rlike(r"^\d{4}-\d{2}$"), F.substring(x, 1, 4).cast("int") + 1).otherwise(F.nullif(F.regexp_extract(x, r"\d{4}", 0), F.lit("")).cast("int")))
    years = F.array_compact(F.concat(F.transform(dates, lambda d: F.year(d)), ends))
    return F.struct(F.array_min(years).alias("first"), F.array_max(years).alias("last"))


def half_year(x: Column) -> Column:
    """A claim period such as ``December 1, 2024 to May 31, 2025`` as its first and last date."""
    found = r"(?i)\b(dec|jun)\w*\D+(?:\d{1,2}\D+)?(\d{4})"
    word, year = F.lower(F.regexp_extract(x, found, 1)), F.nullif(F.regexp_extract(x, found, 2), F.lit("")).cast("int")
    return F.when(word == "dec", F.struct(F.make_date(year, F.lit(12), F.lit(1)).alias("start"), F.make_date(year + 1, F.lit(5), F.lit(31)).alias("end"))).when(
        word == "jun", F.struct(F.make_date(year, F.lit(6), F.lit(1)).alias("start"), F.make_date(year, F.lit(11), F.lit(30)).alias("end"))
    )


def stale(fetched: Column, now: Column, most_days: int | None) -> Column:
    """Whether something fetched then is too old; without a limit nothing is."""
    return F.lit(False) if most_days is None else F.coalesce(fetched < now - F.make_dt_interval(F.lit(most_days)), F.lit(True))


# Months as they are printed.
MONTHS = ("Jan.", "Feb.", "March", "April", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.")


def shown(text: Column) -> Column:
    """``Jan. 5, 2024``, ``Jan. 2024`` or ``2024``, by what an ISO text states; empty where it states nothing."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "-"), lambda p: p.try_cast("int"))
    year, month, day = (F.get(parts, F.lit(k)) for k in range(3))
    named = F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), month), F.lit(" "))
    whole = F.concat(named, F.when(day > 0, F.concat(day.cast("string"), F.lit(", "))).otherwise(""), year.cast("string"))
    return F.when(year.isNull(), "").when(month > 0, whole).otherwise(year.cast("string"))
