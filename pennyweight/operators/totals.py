"""Sums that keep apart what must not be added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECIMAL = "decimal(38,2)"


def measures(amount: str = "amount") -> list[Column]:
    """Records, missing and zero amounts, and their sum, which is null where all are missing."""
    a = F.col(amount)
    return [
        F.count("*").alias("records"),
        F.count_if(a.isNull()).alias("missing"),
        F.count_if(a == 0).alias("zero"),
        F.sum(a).cast("double").alias("value"),
    ]


def group_totals(items: DataFrame, *by: str, overlap: tuple[str, ...] = ()) -> DataFrame:
    """Totals by the given columns, always within one source and one currency.

    ``included`` is false for sources that repeat what others count.
    """
    keys = [*dict.fromkeys(("dataset", "currency", *by))]
    out = items.groupBy(*keys).agg(*measures())
    return out.withColumn("included", ~F.col("dataset").isin(*overlap) if overlap else F.lit(True))


def ranked(totals: DataFrame, k: int, *ties: str) -> DataFrame:
    """The ``k`` largest groups of each source and currency, with their rank and how many there are.

    Groups are counted by an aggregate, so the window has only the limit and
    Spark keeps ``k`` rows a task before the shuffle.
    """
    order = W.partitionBy("dataset", "currency").orderBy(F.col("value").desc_nulls_last(), *ties)
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    sizes = totals.groupBy("dataset", "currency").agg(F.count("*").alias("total_groups"))
    return top.join(sizes, ["dataset", "currency"]).withColumn("truncated", F.col("total_groups") > k)


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key its most frequent value, the least of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max("n").alias("n"))
    return counts.join(best, [key, "n"]).groupBy(key).agg(F.min(value).alias(value))


def upper_median(df: DataFrame, column: str, *by: str) -> DataFrame:
    """The value at place ``floor(n / 2)`` from the smallest, counted from 0; not an interpolation.

    Values are counted before they are ordered, so a group's window holds its distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy(column))
    total = F.sum("n").over(W.partitionBy(*by))
    placed = counts.withColumns({"upto": upto, "total": total})
    return placed.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*by).agg(F.min(column).alias(column))


def concentration(df: DataFrame, whole: list[str], part: str, amount: str = "amount") -> DataFrame:
    """The largest part of each whole: its key, amount, count and share."""
    by_part = df.where(F.col(amount).isNotNull() & (F.col(amount) != 0)).groupBy(*whole, part).agg(F.sum(amount).alias("a"), F.count("*").alias("n"))
    top = by_part.groupBy(*whole).agg(F.sum("a").alias("total"), F.max(F.struct("a", (-F.col(part)).alias("p"), "n")).alias("top"))
    return top.select(*whole, "total", (-F.col("top.p")).alias(part), F.col("top.a").alias("part_total"), F.col("top.n").alias("part_count"))


def densify(df: DataFrame, left: str, right: str) -> DataFrame:
    """Every combination of two small dimensions; what is missing stays null."""
    a, b = df.select(left).distinct(), df.select(right).distinct()
    grid = a.join(b, F.lit(True))
    return grid.join(df, [left, right], "left")
