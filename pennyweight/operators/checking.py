"""Checks: figures against other figures, this run against the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two figures agree; a missing one never does."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def check_rows(df: DataFrame, name: str, what: Column, a: Column, b: Column, tolerance: float) -> DataFrame:
    return df.select(F.lit(name).alias("check"), what.alias("what"), a.cast("double").alias("a"), b.cast("double").alias("b"), within(a, b, tolerance).alias("ok"))


def tally(checks: DataFrame, families: list[str]) -> DataFrame:
    """Checks passed and made, by the beginning of their names."""
    family = F.coalesce(*(F.when(F.startswith("check", F.lit(f)), F.lit(f)) for f in families))
    return checks.withColumn("family", family).where("family IS NOT NULL").groupBy("family").agg(F.count_if("ok").alias("passed"), F.count("*").alias("made"))


def detail_against_summary(detail: DataFrame, summary: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Sums of details beside the printed total; groups on one side only are shown as failures."""
    sums = detail.groupBy(*keys).agg(F.sum("amount").alias("parsed"))
    both = sums.join(summary.select(*keys, F.col("amount").alias("printed")), keys, "full_outer")
    return both.withColumn("ok", within(F.col("parsed"), F.col("printed"), tolerance))


def must_balance(parts: DataFrame, whole: DataFrame, column: str) -> None:
    """Fail unless two tables add up to the same."""
    a, b = (df.agg(F.sum(column).alias("s")).first()["s"] or 0 for df in (parts, whole))
    if a != b:
        raise ValueError(f"{column} adds up to {a} in parts and {b} as a whole")


def guards(now: DataFrame, before: DataFrame, drop: float = 0.02) -> DataFrame:
    """Datasets that lost more rows since the last run than allowed, or vanished."""
    both = before.select("dataset", F.col("n").alias("before")).join(now.select("dataset", F.col("n").alias("now")), "dataset", "full_outer")
    kept = F.coalesce("now", F.lit(0))
    return both.select("dataset", "before", "now", F.coalesce(kept < F.col("before") * (1 - drop), F.lit(False)).alias("alarm"))


def run_guards(now: DataFrame, before: DataFrame | None, counts: DataFrame, counts_before: DataFrame | None, failures: DataFrame, known: DataFrame | None, today: Column, most_days: int = 8, drop: float = 0.02, accept: bool = False) -> DataFrame:
    """What a run is stopped for, or noted: ``guard, subject, problem``.

    ``now`` and ``before`` have one row, ``gathered, files``.  The newest
    download is too old; a download failed that did not fail before (on a
    first run a report that is not there is only noted); a dataset lost more
    rows than allowed; there are fewer files.  ``accept`` turns all but the
    first into notes.
    """
    stop = F.lit(not accept)
    old = F.datediff(today, F.to_date("gathered")) >= most_days
    rows = now.where(F.col("gathered").isNull() | old).select(F.lit("stale").alias("guard"), F.coalesce(F.col("gathered").cast("string"), F.lit("no fetch dates")).alias("subject"), F.lit(True).alias("problem"))
    if known is None:
        fresh = failures.withColumn("_fresh", ~F.col("reason").startswith("404") & ~F.col("reason").startswith("HTML"))
    else:
        fresh = failures.join(known.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left").withColumn("_fresh", F.col("_known").isNull())
    rows = rows.unionByName(fresh.select(F.lit("download").alias("guard"), F.col("url").alias("subject"), (F.col("_fresh") & stop).alias("problem")))
    if counts_before is not None:
        lost = guards(counts, counts_before, drop).where("alarm")
        rows = rows.unionByName(lost.select(F.lit("dataset").alias("guard"), F.col("dataset").alias("subject"), stop.alias("problem")))
    if before is not None:
        fewer = now.select("files").join(before.select(F.col("files").alias("was")), F.col("files") < F.col("was"))  # one row each
        rows = rows.unionByName(fewer.select(F.lit("files").alias("guard"), F.col("files").cast("string").alias("subject"), stop.alias("problem")))
    return rows


def statement_checks(figures: DataFrame, terms: list[tuple]) -> DataFrame:
    """Figures of printed statements against each other, within a document, across documents and across years.

    ``figures`` has ``year, doc, measure, amount``; a term is ``(check, side,
    sign, doc, measure, shift, tolerance)``.  A check compares the sums of the
    signed terms of its sides ``a`` and ``b``; a term of shift 1 is looked up
    in the next year's document.  A side that lacks a figure is null and
    fails; a check none of whose figures exist in a year is not made.
    """
    need = {(check, side): sum(t[:2] == (check, side) for t in terms) for check, side, *_ in terms}
    rows = [(*t, need[t[0], "a"], need[t[0], "b"]) for t in terms]
    rules = figures.sparkSession.createDataFrame(rows, "check string, side string, sign int, doc string, measure string, shift int, tolerance double, need_a long, need_b long")
    met = figures.where("amount IS NOT NULL").join(rules, ["doc", "measure"]).withColumn("year", F.col("year") - F.col("shift"))
    total = lambda s: F.sum(F.when(F.col("side") == s, F.col("sign") * F.col("amount")))
    sums = met.groupBy("year", "check", "tolerance", "need_a", "need_b").agg(*(total(s).alias(s) for s in "ab"), *(F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ab"))
    whole = lambda s: F.when(F.col(f"n_{s}") == F.col(f"need_{s}"), F.col(s).cast("double")).alias(s)
    return sums.select("year", "check", whole("a"), whole("b"), "tolerance").withColumn("ok", F.coalesce(F.abs(F.col("a") - F.col("b")) <= F.col("tolerance"), F.lit(False))).drop("tolerance")


def three_ways(detail: DataFrame, printed: DataFrame, listed: DataFrame, keys: list[str], tolerance: float = 0.005) -> DataFrame:
    """Sums of parsed lines beside the total that their report prints and the one its listing shows.

    ``lines_ok`` compares lines with the report, ``listing_ok`` the listing with the
    report; a figure that is not stated is not compared and gives null.
    """
    sums = detail.groupBy(*keys).agg(F.sum("amount").alias("lines"))
    side = lambda df, name: df.select(*keys, F.col("amount").alias(name))
    both = sums.join(side(printed, "printed"), keys, "full_outer").join(side(listed, "listed"), keys, "full_outer")
    agree = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), within(F.col(a), F.col(b), tolerance))
    return both.withColumns({"lines_ok": agree("lines", "printed"), "listing_ok": agree("listed", "printed")})
