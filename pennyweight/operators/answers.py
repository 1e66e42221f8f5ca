"""The query interface: what a service answers, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, money
from . import searching, totals


class Ambiguous(ValueError):
    """A name that fits several subjects."""


def resolve_name(df: DataFrame, column: str, name: str) -> str | None:
    """An exact name in any case, else the only one that contains it; several are an error."""
    names = df.select(column).distinct()
    exact = [r[0] for r in names.where(F.lower(column) == name.lower()).limit(2).collect()]
    if exact:
        return exact[0]
    found = [r[0] for r in names.where(F.contains(F.lower(column), F.lit(name.lower()))).orderBy(column).limit(5).collect()]
    if len(found) > 1:
        raise Ambiguous(f"{name} may be {', '.join(found)}")
    return found[0] if found else None


def search_records(spark: SparkSession, items: DataFrame, posted: DataFrame, text: str, page: int = 1, size: int = 25, window: int | None = None) -> DataFrame:
    """Items whose description has every word of the query, largest first.

    Paging is exact; with ``window`` only that many documents of the largest
    totals are looked at, and pages are slices of their items.
    """
    hits, _ = searching.find(spark, posted, text)
    rows = items.join(hits.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    if window:
        top = rows.groupBy("supplier_key").agg(F.sum("amount").alias("v")).orderBy(F.col("v").desc_nulls_last(), "supplier_key").limit(window)
        rows = rows.join(top.select("supplier_key"), "supplier_key", "left_semi")
    return rows.orderBy(F.col("amount").desc_nulls_last(), "id").offset((page - 1) * size).limit(size)


def get_record(items: DataFrame, record: str) -> DataFrame:
    return items.where(F.col("id") == record)


def get_supplier(items: DataFrame, name: str, k: int = 40) -> DataFrame:
    """A supplier's totals by source, currency and year, and how many records each has."""
    found = resolve_name(items, "supplier", name)
    return totals.group_totals(items.where(F.col("supplier") == F.lit(found)), "supplier", "fiscal_year")


def get_body(items: DataFrame, body: str, column: str = "place") -> DataFrame:
    found = resolve_name(items, column, body)
    return totals.group_totals(items.where(F.col(column) == F.lit(found)), column, "fiscal_year")


def get_department(programs: DataFrame, department: str) -> DataFrame:
    """A department's programs in its latest year that is no estimate."""
    found = resolve_name(programs, "department", department)
    rows = programs.where(F.col("department") == F.lit(found))
    latest = rows.where("kind <> 'estimate'").agg(F.max("fiscal_year").alias("fiscal_year"))
    return rows.join(F.broadcast(latest), "fiscal_year")


def member_averages(spending: DataFrame, year: str | None = None) -> DataFrame:
    """Each member's spending beside the average of members present that year; by default the last year but one."""
    by = spending.groupBy("fiscal_year", "member").agg(F.sum("amount").alias("amount"))
    years = by.select("fiscal_year").distinct().withColumn("r", F.row_number().over(W.orderBy(F.desc("fiscal_year"))))
    chosen = years.where(F.col("fiscal_year") == year) if year else years.where("r = 2")
    present = by.join(F.broadcast(chosen.select("fiscal_year")), "fiscal_year")
    mean = present.groupBy("fiscal_year").agg(F.count("*").alias("members"), F.avg("amount").alias("average"))
    return present.join(mean, "fiscal_year")


def flag_examples(flags: DataFrame, flag: str, k: int = 25) -> DataFrame:
    return flags.where(F.col("flag") == flag).orderBy(F.col("value").desc_nulls_last(), "id").limit(k)


def human_scale(amounts: DataFrame, people: float, households: float, yearly_wage: float) -> DataFrame:
    a = F.col("amount").cast("double")
    return amounts.withColumns({"per_person": money.per_head(a, people), "per_household": money.per_head(a, households), "work_time": money.work_time(a, yearly_wage)})


def pay(rows: DataFrame) -> DataFrame:
    """People and mean pay by employer and year; a year without a record stays null."""
    by = rows.groupBy("employer", "year").agg(F.count("*").alias("people"), F.avg("pay").alias("mean_pay"))
    return totals.densify(by, "employer", "year")


def tax_receipt(departments: DataFrame, tax: float) -> DataFrame:
    """A person's tax dealt out by each department's share of spending."""
    whole = departments.agg(F.sum("amount").alias("whole"))
    return departments.crossJoin(F.broadcast(whole)).withColumn("share", F.col("amount") / F.col("whole")).withColumn("paid", F.col("share") * tax)  # one row


def get_totals(items: DataFrame, by: str, source: str | None = None, year: str | None = None, k: int = 100, overlap: tuple[str, ...] = ()) -> DataFrame:
    """Ranked totals within source and currency; a year is a calendar or a fiscal one."""
    rows = items if source is None else items.where(F.col("dataset") == source)
    if year:
        rows = rows.where((F.year("award_date").cast("string") == year) | (F.col("fiscal_year") == year))
    return totals.ranked(totals.group_totals(rows, by, overlap=overlap), k, by)


def budget_against_actual(facts: DataFrame, keys: list[str], documents: list[str]) -> DataFrame:
    """Budgeted and actual figures by basis; each takes the first document that states it, and bases never mix."""
    wide = facts.groupBy(*keys, "basis").pivot("doc", documents).agg(F.sum("amount"))
    actual = F.coalesce(*(F.col(f"`{d}`") for d in documents if d != "budget"))
    return wide.select(*keys, "basis", F.col("budget"), actual.alias("actual"), (actual - F.col("budget")).alias("difference"))


def budget_pairs(facts: DataFrame, keys: list[str], measures: list[str], documents: list[str]) -> DataFrame:
    """A row for each of ``keys`` and basis, with a struct of budget, actual and difference for each measure.

    ``facts``: ``keys, basis, measure, doc, amount, source, page``.  ``status`` says whether
    actuals are published; sources are links to pages, of the budget and of
    the document that the actual comes from.
    """
    link = F.when(F.col("source").isNotNull(), F.concat("source", F.lit("#page="), F.col("page").cast("string")))
    rank = F.coalesce(*(F.when(F.col("doc") == d, k) for k, d in enumerate(documents)))
    stated = facts.where("amount IS NOT NULL").withColumns({"_budget": F.col("doc") == "budget", "_rank": rank, "_link": link})
    # of each side the first document that states it counts
    sums = stated.groupBy(*keys, "basis", "measure", "_budget", "_rank").agg(F.sum("amount").alias("a"), F.min("_link").alias("link"))
    first = lambda budget: F.min(F.when(F.col("_budget") == budget, F.struct("_rank", "a", "link")))
    sides = sums.groupBy(*keys, "basis", "measure").agg(first(True).alias("b"), first(False).alias("c"))
    pair = F.struct(F.col("b.a").alias("budget"), F.col("c.a").alias("actual"), (F.col("c.a") - F.col("b.a")).alias("difference"))
    made = {m: F.max(F.when(F.col("measure") == m, pair)).alias(m) for m in measures}
    published = F.max(F.col("c").isNotNull())
    out = sides.groupBy(*keys, "basis").agg(*made.values(), F.when(published, "published").otherwise("not yet published").alias("status"), F.min("b.link").alias("budget_source"), F.min("c.link").alias("actual_source"))
    return out


def to_thousands(x):
    """Rounded to thousands, halves upward."""
    return F.floor(x / 1000 + F.lit(0.5)) * 1000


def citation(items: DataFrame) -> DataFrame:
    """What a record may be quoted with: an amount in CAD only where it is one."""
    cad = F.when(F.col("currency") == "CAD", F.col("amount"))
    return items.select("id", ids.short_id(F.col("id")).alias("short"), F.struct(cad.cast("double").alias("amount_cad"), "currency", "supplier", "buyer", "award_date").alias("cite"))
