"""Pattern flags: questions about records, at the level of an item or of a subject.

Each function returns one or both shapes; thresholds are parameters whose
defaults are the published ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import once, totals

EXCEPTIONS = ("Sole source", "Emergency", "Pre-qualified supplier", "For resale", "Security", "Rates set by regulator", "Exception (other)", "Exception (clause not given)")


def by_method(items: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    return items.where(F.col("method").isin(*methods)).select("id", "method", F.col("amount").alias("value"))


def exception_share(items: DataFrame, methods: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """Each buyer's awards without competition, as a part of all it spent."""
    hit = F.col("method").isin(*methods)
    out = items.groupBy("buyer", "buyer_key").agg(
        F.count("*").alias("awards"), F.sum("amount").alias("amount"), F.count_if(hit).alias("exception_awards"), F.sum(F.when(hit, F.col("amount"))).alias("exception_amount")
    )
    return out.where("exception_awards > 0").withColumn("value", F.try_divide(F.coalesce("exception_amount", F.lit(0)).cast("double"), F.col("amount").cast("double")))


def repeat_pairs(items: DataFrame, method: str = "Sole source", least: int = 3, from_date: str | None = None) -> DataFrame:
    """Pairs of buyer and supplier with several awards by one method.

    The published text dates the rule; the computation has no date unless ``from_date`` is given.
    """
    rows = items.where((F.col("method") == method) & F.col("supplier_key").isNotNull())
    if from_date:
        rows = rows.where(F.col("award_date") >= F.lit(from_date).cast("date"))
    out = rows.groupBy("buyer_key", "supplier_key").agg(F.count("*").alias("awards"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("value"), F.min("award_date").alias("first"), F.max("award_date").alias("last"))
    return out.where(F.col("awards") >= least)


def growth(contracts: DataFrame, factor: float = 2, least: float = 25_000) -> DataFrame:
    """Contracts that grew to a multiple of their original value."""
    a, o = F.col("amount"), F.col("original")
    return contracts.where((o > 0) & (a >= factor * o) & (a - o >= least)).withColumn("value", a.cast("double") / o.cast("double"))


def near_limits(items: DataFrame, limits: DataFrame, width: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Items just under a limit of their body's type, and counts just below and just above.

    ``limits``: ``body_type, limit_value``; all limits of a type are tried.
    """
    met = items.where("amount IS NOT NULL").join(F.broadcast(limits), "body_type")
    a, at = F.col("amount"), F.col("limit_value")
    below, above = (a >= (1 - width) * at) & (a < at), (a >= at) & (a < (1 + width) * at)
    counts = met.groupBy("body_type", "limit_value").agg(F.count_if(below).alias("below"), F.count_if(above).alias("above"))
    return met.where(below).select("id", "limit_value", a.alias("value")), counts


def split_same_day(items: DataFrame, limit: float, person: Column | None = None) -> DataFrame:
    """Small bills of one supplier on one day for one thing that reach the limit together."""
    small = items.where((F.col("amount") > 0) & (F.col("amount") < limit))
    if person is not None:
        small = small.where(~person)
    out = small.groupBy("supplier_key", "day", "what").agg(F.count("*").alias("invoices"), F.sum("amount").cast("double").alias("value"))
    return out.where((F.col("invoices") >= 2) & (F.col("value") >= limit))


def split_clusters(items: DataFrame, keys: list[str], day: str, limit: float, days: int = 7) -> DataFrame:
    """Small awards within a week of a first one that reach the limit together; negatives count."""
    small = items.where((F.col("amount") < limit) & (F.col("amount") != 0))
    out = once.anchored_clusters(small, keys, day, days, ["amount"]).groupBy(*keys, "anchor").agg(F.count("*").alias("invoices"), F.sum("amount").alias("value"))
    return out.where((F.col("invoices") >= 2) & (F.col("value") >= limit))


def year_end(items: DataFrame, day: str = "award_date", month: int = 3, least: int = 20, ratio: float = 3) -> tuple[DataFrame, DataFrame]:
    """Buyers whose last month outweighs an even year, and that month's items."""
    rows = items.where(F.col(day).isNotNull() & (F.col("amount") != 0))
    late = F.month(day) == month
    out = rows.groupBy("buyer", "buyer_key").agg(F.count("*").alias("items"), F.sum("amount").alias("amount"), F.coalesce(F.sum(F.when(late, F.col("amount"))), F.lit(0)).alias("last_month_amount"), F.count_if(late).alias("last_month_items"))
    out = out.where((F.col("items") >= least) & (F.col("amount") > 0)).withColumn("value", F.col("last_month_amount").cast("double") / F.col("amount").cast("double") * 12)
    subjects = out.where(F.col("value") >= ratio)
    # the items' guard: the whole is at least one, and an item needs no amount
    guarded = out.where(F.col("last_month_amount").cast("double") / F.greatest(F.col("amount").cast("double"), F.lit(1.0)) * 12 >= ratio)
    marked = items.where(F.month(day) == month).join(guarded.select("buyer", "buyer_key"), ["buyer", "buyer_key"], "left_semi")
    return subjects, marked.select("id", F.col("amount").alias("value"))


def dominant(items: DataFrame, least_total: float = 250_000, share: float = 0.5, awards: int = 3) -> DataFrame:
    """Buyers with one supplier that has most of their spending."""
    top = totals.concentration(items.where("supplier_key IS NOT NULL"), ["buyer", "buyer_key"], "supplier_key")
    top = top.withColumn("value", F.col("part_total").cast("double") / F.col("total").cast("double"))
    return top.where((F.col("total") >= least_total) & (F.col("value") >= share) & (F.col("part_count") >= awards))


def odd_dates(items: DataFrame, early_days: int = 3 * 365) -> Column:
    """A date after its report's end, or years before its start."""
    d = F.col("award_date")
    return F.coalesce((d > F.col("period_end")) | (F.datediff("period_start", d) > early_days), F.lit(False))


def late_publication(items: DataFrame, days: int = 90) -> DataFrame:
    """Awards published long after they were made, without those whose date is odd."""
    late = F.datediff("period_end", "award_date")
    return items.where(~odd_dates(items) & (late > days)).select("id", late.alias("value"))


def possible_duplicates(payments: DataFrame) -> DataFrame:
    """One supplier, invoice and amount under several payment numbers."""
    rows = payments.where((F.col("invoice") != "") & ~F.upper("invoice").isin("EFT", "N/A") & (F.col("amount") != 0))
    out = rows.groupBy("supplier_key", "invoice", "amount").agg(F.countDistinct("payment_no").alias("payments"), F.count("*").alias("times"))
    return out.where("payments >= 2")


def over_allowance(summary: DataFrame, more: float = 1) -> DataFrame:
    return summary.where(F.col("spent") - F.col("allowance") > more).withColumn("value", F.col("spent") - F.col("allowance"))


def pay_counts(pay: DataFrame, test: Column, amount: str) -> DataFrame:
    """People by employer, title and year, never one by one."""
    out = pay.where(test).groupBy("employer", "title", "year").agg(F.count("*").alias("people"), F.sum(amount).alias("value"))
    return out
