"""Why a record is in the ledger, and what its place means.

An address selects a record; it does not say where money was spent.  So a
record's scope stays unknown until its own words or a review settle it,
and a review holds only while the reviewed fields still read the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codes, tables

UNREVIEWED = "The record does not say where the work or benefit is"


def selected(country: Column, province: Column, code: Column) -> Column:
    """In the country, and in the province by name or by a whole postal code."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return tidy(country).isin(*tables.COUNTRY) & (tidy(province).isin(*tables.PROVINCES) | codes.in_region(code))


def location_conflict(country: Column, province: Column, code: Column, city: Column | None = None) -> Column:
    """What in an address speaks against the province; null where nothing does."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    shown = F.trim(F.coalesce(code, F.lit("")))
    stated, valid = shown != "", codes.canadian_code(code)
    town = F.lit(None).cast("string") if city is None else city
    out = F.concat_ws(
        "; ",
        F.when(~tidy(country).isin(*tables.COUNTRY), F.concat(F.lit("reported country is "), country)),
        F.when(stated & valid & ~codes.in_region(code), F.concat(F.lit("reported postal code "), shown, F.lit(" is outside NL"))),
        F.when(stated & ~valid, F.concat(F.lit("reported postal code "), shown, F.lit(" is not a valid Canadian postal code"))),
        F.when(tidy(F.split_part(town, F.lit("|"), F.lit(1))).isin(*tables.OUTSIDE_CITIES), F.concat(F.lit("reported city is "), town)),
        F.when((tidy(province) != "") & ~tidy(province).isin(*tables.PROVINCES), F.concat(F.lit("reported province is "), province)),
    )
    return F.nullif(out, F.lit(""))


def delivery_scope(regions: Column) -> Column:
    """``local`` if all delivery regions are, ``broader`` if one is wider, else ``unknown``."""
    listed = F.filter(F.transform(F.split(F.coalesce(regions, F.lit("")), "\n"), lambda r: F.regexp_replace(F.trim(r), r"^\*+", "")), lambda r: r != "")
    return F.when((F.size(listed) > 0) & F.forall(listed, lambda r: r.isin(*tables.LOCAL_REGIONS)), "local").when(F.exists(listed, lambda r: r.isin(*tables.BROADER_REGIONS)), "broader").otherwise("unknown")


def with_reviews(records: DataFrame, reviews: DataFrame, field: str) -> DataFrame:
    """Records with the status of their review; a review whose text has changed stops the job."""
    joined = records.join(reviews.select("id", F.col(field).alias("_reviewed"), "status", "statement"), "id", "left")
    same = F.trim(F.regexp_replace(F.col(field), r"\s+", " ")).eqNullSafe(F.trim(F.regexp_replace("_reviewed", r"\s+", " ")))
    broken = F.raise_error(F.concat(F.lit("reviewed text has changed for "), F.col("id").cast("string"))).cast("string")
    state = F.when(F.col("_reviewed").isNull(), "unreviewed").when(same, "reviewed").otherwise(broken)
    return joined.withColumns({"review_state": state, "scope": F.coalesce("status", F.lit("unknown")), "statement": F.coalesce("statement", F.lit(UNREVIEWED))}).drop("_reviewed", "status")


def coverage(amount: Column) -> Column:
    return F.when(amount.isNull(), "not stated").when(amount == 0, "published zero").otherwise("published value")


def native_amount(amount: Column, currency: Column) -> Column:
    """An amount in its own currency, never converted."""
    unstated = currency == "unstated"
    missing = F.concat(F.lit("Amount not stated ("), F.when(unstated, "currency not stated").otherwise(currency), F.lit(")"))
    shown = F.format_number(amount, 2)
    return F.when(amount.isNull(), missing).when(unstated, F.concat(shown, F.lit(" (currency not stated)"))).otherwise(F.concat(currency, F.lit(" "), shown))


def period_text(periods: Column) -> Column:
    """Up to three periods in full, else their number."""
    n = F.size(periods)
    return F.when(n == 0, "not stated").when(n <= 3, F.array_join(periods, "; ")).otherwise(F.concat(n.cast("string"), F.lit(" reported periods")))


def procurement_method(clause: Column, kind: Column, section: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """By the clause cited, else by the kind of call, else by the section it stands in."""
    cited = F.trim(F.coalesce(clause, F.lit("")))
    named = (cited != "") & (F.upper(cited) != "N/A")
    by_kind = F.when(F.lower(kind).contains("limited"), "Limited call").when(F.lower(kind).contains("open"), "Open call")
    other = F.when(section == "Exception", "Exception (clause not given)").otherwise("Not stated")
    table = rules or [(f"(?i){pattern}", label) for pattern, label in tables.CLAUSES]
    return F.when(named, codes.first_match(cited, table, "Exception (other)")).otherwise(F.coalesce(by_kind, other))


def section_heading(line: Column) -> Column:
    """The section that a heading opens; null for other lines."""
    t = F.upper(line)
    return F.when(t.contains("EMERGENCY"), "Emergency").when(t.contains("WITHOUT AN OPEN CALL") | t.contains("EXCEPTION"), "Exception").when(t.contains("CONTRACT AWARD"), "Award")


def report_period(text: Column, file_name: Column | None = None) -> Column:
    """First and last day of a report, from its header or, without one, from its file's name.

    The header is ``mm/dd/yyyy - mm/dd/yyyy``, or what follows ``PERIOD:`` or
    ``BIDS -``: months, days and a year in words.  Without a year it is 2021.
    """
    body = F.coalesce(text, F.lit(""))
    numeric = r"(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})"
    read = lambda k: F.try_to_date(F.regexp_extract(body, numeric, k), "MM/dd/yyyy")
    named = F.translate(F.coalesce(file_name, body) if file_name is not None else body, "_-", "  ")
    header = lambda mark: F.nullif(F.regexp_extract(body, mark + r"([^\n]*)", 1), F.lit(""))
    line = F.coalesce(header("PERIOD:"), header(r"BIDS\s*-\s*"), named)
    months = F.regexp_extract_all(F.lower(line), F.lit(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"), F.lit(1))
    numbers = F.regexp_extract_all(F.regexp_replace(line, r"20\d{2}", " "), F.lit(r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?(?!\d)"), F.lit(1))
    days = F.filter(F.transform(numbers, lambda d: d.cast("int")), lambda d: d.between(1, 31))
    year = F.coalesce(F.nullif(F.regexp_extract(line, r"20\d{2}", 0), F.lit("")), F.lit("2021"))
    day = lambda k: F.try_to_date(F.concat_ws("-", year, F.initcap(F.coalesce(F.get(months, F.lit(k)), months[0])), F.get(days, F.lit(k)).cast("string")), "yyyy-MMM-d")
    in_words = (F.size(months) > 0) & (F.size(days) >= 2)
    return F.when(body.rlike(numeric), F.struct(read(1).alias("start"), read(2).alias("end"))).when(in_words, F.struct(day(0).alias("start"), day(1).alias("end")))


def longest_prefix(df: DataFrame, column: str, table: DataFrame, name: str = "name") -> DataFrame:
    """Rows with the name of the longest prefix in a small table (``prefix, name``) that their text begins with.

    A text has few prefixes by length, so they meet by equal keys.
    """
    lengths = [r[0] for r in table.select(F.length("prefix")).distinct().collect()]  # as many as there are lengths
    keys = df.select(column).distinct().select(column, F.explode(F.array(*(F.substring(column, 1, n) for n in lengths))).alias("prefix"))
    best = keys.join(table, "prefix").groupBy(column).agg(F.max_by(name, F.length("prefix")).alias(name))
    return df.join(best, column, "left")


def words_contained(df: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """Rows with the longest known name whose words all stand in their text; ``known`` is a small dimension.

    Texts meet names that share a word, so nothing is crossed.
    """
    drop = F.array(*map(F.lit, ("of", "and", "the", "department", "")))
    bag = lambda c: F.array_except(F.split(F.lower(c), "[^a-z]+"), drop)
    heads = df.select(column).distinct().withColumn("_has", bag(F.col(column)))
    names = known.select(name).distinct().withColumn("_needs", bag(F.col(name))).where(F.size("_needs") > 0)
    met = heads.withColumn("_w", F.explode("_has")).join(names.withColumn("_w", F.col("_needs")[0]), "_w")
    fits = met.where(F.size(F.array_except("_needs", "_has")) == 0)
    best = fits.groupBy(column).agg(F.max_by(name, F.struct(F.length(name), name)).alias(name))
    return df.join(best, column, "left")
