"""Grant agreements from their amendment rows: keys rewritten, renamed recipients folded, one value each.

Rows are grouped by organisation, agreement number and recipient.  Rows
without a number stand for themselves, by reference, unless the
organisation re-issued an amendment under a new reference: then all rows
of the same recipient, start, program and title are one agreement.  Of the
groups of one number, those that go on what the home group began are
absorbed by it; home is the only original, or the first where none is.

Rows are shuffled once, into one partial aggregate a group; finding homes
and absorbing works on groups, and the partial aggregates of what was
absorbed are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a program that are compared.
PROGRAM_LETTERS = 15


def letters(x: Column) -> Column:
    """Lower-case ASCII letters and digits of what stands before the first bar."""
    return F.regexp_replace(F.lower(F.split(F.coalesce(x, F.lit("")), r"\|")[0]), "[^a-z0-9]", "")


def rewritten(rows: DataFrame) -> DataFrame:
    """Rows with ``_agreement``: the number, or what stands for one."""
    number = F.trim(F.coalesce("number", F.lit("")))
    title = F.regexp_replace(letters(F.col("title")), "dba$", "")
    content = F.sha1(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x1e")) for c in (F.col("recipient"), F.col("start"), letters(F.col("program")), title))))
    marked = rows.withColumns({"_number": number, "_content": F.when(number == "", content)})
    reissued = marked.where("_number = '' AND amendment > 0").select("org", "_content").distinct().withColumn("_reissued", F.lit(True))
    keyed = marked.join(reissued, ["org", "_content"], "left")
    key = F.when(F.col("_number") != "", F.concat(F.lit("n:"), "_number")).when(F.col("_reissued"), F.concat(F.lit("c:"), "_content")).otherwise(F.concat(F.lit("r:"), "ref"))
    return keyed.withColumn("_agreement", key).drop("_number", "_content", "_reissued")


def agreements(rows: DataFrame, reporting_changes: tuple[str, ...]) -> DataFrame:
    """``org, agreement_number, recipient, ref, amendment, n_rows, how, amount, start, business_number``, a row an agreement.

    ``rows``: ``seq`` (the order of the file), ``org, number, recipient, amendment,
    amended_on, ref, start, program, title, value, business_number``.
    Organisations in ``reporting_changes`` report changes, which are added up;
    the others report running totals, of which the latest counts.  A negative
    value of another organisation raises: how it reports is not known.
    """
    changes = F.col("org").isin(*reporting_changes)
    checked = F.when((F.col("value") < 0) & ~changes, F.raise_error(F.concat(F.lit("negative grant values from "), F.col("org"), F.lit(": check how amendments are reported")))).otherwise(F.col("value"))
    order = F.struct(F.col("amendment"), F.coalesce("amended_on", F.lit("")).alias("amended_on"), F.col("ref"), F.col("seq"))
    stated = F.nullif(F.trim(F.coalesce("business_number", F.lit(""))), F.lit(""))
    groups = rewritten(rows).withColumns({"value": checked, "_order": order}).groupBy("org", "_agreement", "recipient").agg(
        F.max(F.struct("_order", "value", F.col("recipient").alias("shown"))).alias("last"),
        F.sum("value").alias("sum"),
        F.count("*").alias("n_rows"),
        F.min(F.coalesce("start", F.lit(""))).alias("start"),
        F.max(F.when(stated.isNotNull(), F.struct("_order", stated.alias("v")))).alias("stated"),
        F.min("seq").alias("seq"),
        F.min(F.when(F.col("amendment") > 0, 1).otherwise(0)).alias("late"),  # 0 if some row is an original
        F.collect_set(F.coalesce("start", F.lit(""))).alias("starts"),
        F.collect_set(F.substring(letters(F.col("program")), 1, PROGRAM_LETTERS)).alias("programs"),
    )
    homes = groups.where("_agreement LIKE 'n:%'").groupBy("org", "_agreement").agg(F.min(F.struct("late", "seq", "recipient", "starts", "programs")).alias("home"), F.sum(1 - F.col("late")).alias("originals"))
    found = groups.join(homes.where("originals <= 1").select("org", "_agreement", "home"), ["org", "_agreement"], "left")
    blank = F.lit("")
    goes_on = (
        F.arrays_overlap("starts", "home.starts") | F.arrays_overlap("programs", "home.programs")
        | F.array_contains("programs", blank) | F.array_contains("home.programs", blank)
    )
    into = F.when(F.col("home").isNotNull() & F.coalesce(goes_on, F.lit(False)), F.col("home.recipient")).otherwise(F.col("recipient"))
    merged = found.withColumn("_into", into).groupBy("org", "_agreement", "_into").agg(
        F.max("last").alias("last"), F.sum("sum").alias("sum"), F.sum("n_rows").alias("n_rows"), F.min("start").alias("start"), F.max("stated")["v"].alias("business_number")
    )
    how = F.when(changes, F.format_string("sum of %d amendment rows (department reports changes)", "n_rows")).otherwise(F.format_string("latest of %d rows (department reports running totals)", "n_rows"))
    number = F.when(F.col("_agreement").startswith("n:"), F.substring("_agreement", 3, 1 << 20)).otherwise("")
    return merged.select(
        "org", number.alias("agreement_number"), F.col("last.shown").alias("recipient"), F.col("last._order.ref").alias("ref"), F.col("last._order.amendment").alias("amendment"),
        "n_rows", how.alias("how"), F.when(changes, F.coalesce("sum", F.lit(0))).otherwise(F.col("last.value")).alias("amount"), "start", F.coalesce("business_number", F.lit("")).alias("business_number"),
    )
