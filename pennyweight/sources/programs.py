"""Program reports: lines with their department, account and program, and totals that must come out.

A line's meaning is in its own text; what it belongs to was said above it.
Lines are classified by one projection, and the context is carried down
each report by windows over its lines: the last department, account,
program, and whatever was opened or closed last.  Every window is over
(part of) a report, so lines are dealt out once at most.  An object printed without
amounts stays open and takes the sums of the details below it, until
another object, a total or a program closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money

# How amounts, programs, objects and totals are printed.
AMOUNT = r"(\(?-?[\d,]+\)?|-)"
THREE = rf"\s{{2,}}{AMOUNT}\s+{AMOUNT}\s+{AMOUNT}\s*$"
PROGRAM = r"^\s{1,14}(\d{1,2}\.\d{1,2}\.\d{2})\.?\s+(\S.*?)\s*$"
OBJECT = r"^\s+(\d{2})\.\s*(\S.*?)\s*$"
OBJECT_HEAD = r"^\s+(\d{2})\.\s*([A-Z][A-Za-z ,&'’\-]+?):?\s*$"
TOTAL = r"^\s+Total:\s+(.+)$"
DEPARTMENT = r"^[A-Z][A-Z ,&]{4,}$"
ACCOUNTS = ("CURRENT", "CAPITAL")
#: Spaces before a detail, at least.
INDENT = 12
_AMOUNTS = ("col1", "col2", "col3")


def classified(lines: DataFrame) -> DataFrame:
    """Lines (``path, line, value``) with ``kind``, ``code``, ``label`` and amounts."""
    value = F.col("value")
    part = lambda pattern, k, of=value: F.regexp_extract(of, pattern, k)
    # a step reads what the step before it found, so that each pattern is tried once on a line
    tailed = lines.select("path", "line", "value", part(THREE, 0).alias("_tail"))
    label, name, three = F.col("_label"), F.col("_name"), F.col("_tail") != ""
    cut_off = tailed.withColumn("_label", F.when(three, F.substr(value, F.lit(1), F.length(value) - F.length("_tail"))).otherwise(value))
    named = cut_off.withColumns({"_name": F.trim("_label"), "_amounts": F.when(three, F.split("_tail", r"\s+"))})
    closing = F.upper(name).rlike("^(TOTAL|AMOUNT TO BE VOTED|STATUTORY)")
    with_amounts = (
        F.when(label.rlike(TOTAL), "total")
        .when(label.rlike(OBJECT), F.when(F.lower(part(OBJECT, 2, label)).startswith("revenue"), "revenue").otherwise("object"))
        .when((F.length(label) - F.length(F.ltrim(label)) >= INDENT) & ~closing & (name != ""), "detail")
        .otherwise("closing")
    )
    without = (
        F.when(name == "", "blank")
        .when(name.isin(*ACCOUNTS), "account")
        .when(value.rlike(PROGRAM), "program")
        .when(value.rlike(OBJECT_HEAD), "head")
        .when(value.rlike(DEPARTMENT), "department")
        .when(value.rlike(r"^\s+(-\s*\S|[A-Z][A-Z0-9 ,'’&\-/().]+$)"), "wrap")
        .otherwise("text")
    )
    kind = F.col("kind")
    known = named.withColumn("kind", F.when(three, with_amounts).otherwise(without))
    code = F.when(kind == "program", part(PROGRAM, 1)).when(kind.isin("object", "revenue"), part(OBJECT, 1, label)).when(kind == "head", part(OBJECT_HEAD, 1))
    shown = F.when(kind == "program", part(PROGRAM, 2)).when(kind.isin("object", "revenue"), part(OBJECT, 2, label)).when(kind == "head", F.trim(part(OBJECT_HEAD, 2))).otherwise(name)
    # before the first amount stand spaces, so it is the second piece
    amounts = {c: money.document_number(F.col("_amounts")[k]) for k, c in enumerate(_AMOUNTS, 1)}
    return known.select("path", "line", "value", "kind", code.alias("code"), shown.alias("label"), *(v.alias(c) for c, v in amounts.items()))


def program_rows(lines: DataFrame) -> DataFrame:
    """``path, line, line_type, object_code, object, department, account, program_code, program`` and three amounts."""
    of = W.partitionBy("path").orderBy("line")
    upto = of.rowsBetween(W.unboundedPreceding, 0)
    before = of.rowsBetween(W.unboundedPreceding, -1)
    kind = F.col("kind")
    last = lambda test, x, over=upto: F.last(F.when(test, x), ignorenulls=True).over(over)
    opening = kind.isin("program", "object", "revenue", "head", "total", "closing")
    marked = classified(lines).drop("value").withColumns(
        {
            "department": last(kind == "department", F.initcap("label")),
            "account": last(kind == "account", F.col("label")),
            "_program": last(kind.isin("program", "department"), F.struct(F.col("line").alias("at"), "code", "label")),
            # the names of programs run on while nothing but their own lines is met
            "_runs": (kind == "wrap") & (last(kind != "wrap", kind, before) == "program"),
            "_open": last(opening, F.struct(F.col("line").alias("at"), "kind", "code")),
        }
    )
    kept = kind.isin("object", "revenue", "head", "detail", "total")
    inside = marked.where(F.col("_program.code").isNotNull() & (kept | F.col("_runs"))).withColumn("_at", F.col("_program.at"))
    running = F.collect_list(F.when(F.col("_runs"), F.struct("line", "label"))).over(W.partitionBy("path", "_at"))
    more = F.when(F.size("_running") > 0, F.array_join(F.transform(F.sort_array("_running"), lambda x: F.regexp_replace(x["label"], r"^-\s*", "")), " "))
    under = (kind == "detail") & (F.col("_open.kind") == "head")
    block = W.partitionBy("path", "_open.at")
    sums = {c: F.when(kind == "head", F.coalesce(F.sum(F.when(under, F.col(c))).over(block), F.lit(0.0))).otherwise(F.col(c)) for c in _AMOUNTS}
    joined = inside.withColumn("_running", running).where(kept).withColumn("_more", more).drop("_running").withColumns(sums)
    line_type = F.when(kind == "head", "object").when(kind == "total", "program_total").otherwise(kind)
    object_code = F.when(kind == "total", "").when(kind == "detail", F.when(F.col("_open.kind") == "head", F.col("_open.code")).otherwise("02")).otherwise(F.col("code"))
    name = F.when(kind == "total", "Total (net of revenue)").otherwise(F.regexp_replace("label", r"\s+", " "))
    return joined.select(
        "path", "line", line_type.alias("line_type"), object_code.alias("object_code"), name.alias("object"), "department", "account", F.col("_program.code").alias("program_code"),
        F.initcap(F.concat_ws(" ", F.col("_program.label"), "_more")).alias("program"), *_AMOUNTS,
    )


def program_checks(rows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Each program's objects, less its revenue, beside the total printed below them."""
    of = ["path", "department", "account", "program_code", "program"]
    part = lambda kinds, c: F.sum(F.when(F.col("line_type").isin(*kinds), F.col(c)))
    net = {c: F.coalesce(part(("object", "revenue"), c), F.lit(0.0)) for c in _AMOUNTS}
    out = rows.groupBy(*of).agg(*(v.alias(f"parsed_{c}") for c, v in net.items()), *(part(("program_total",), c).alias(f"printed_{c}") for c in _AMOUNTS), F.count_if(F.col("line_type") == "detail").alias("details"))
    ok = F.lit(True)
    for c in _AMOUNTS:
        ok = ok & F.coalesce(F.abs(F.col(f"parsed_{c}") - F.col(f"printed_{c}")) <= tolerance, F.lit(False))
    return out.withColumn("ok", ok)


def printed(column: Column) -> Column:
    """An amount as reports print it: thousands apart, negatives in brackets, a dash for none."""
    shown = F.format_number(F.abs(column), 0)
    return F.when(column == 0, "-").when(column < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
