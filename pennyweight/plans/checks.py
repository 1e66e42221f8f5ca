"""Checks and reconciliation (V-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from ..operators import checking as C
from .ledger import items, with_items
from .registry import query, table

_DEC = "CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,2))"
_V01 = f"SELECT 'order total' AS \"check\", CAST(o_orderkey AS VARCHAR) AS what, CAST(a AS DOUBLE) AS a, o_totalprice AS b, coalesce(abs(CAST(a AS DOUBLE) - o_totalprice) <= 50000, false) AS ok FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


def _order_checks(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("a"))
    both = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return C.check_rows(both, "order total", F.col("o_orderkey").cast("string"), F.col("a"), F.col("o_totalprice"), 50000)


@query("v01_tolerance_rows", _V01)
def v01(spark, sf):
    return _order_checks(spark, sf)


@query("v02_across_documents", with_items("SELECT place, fiscal_year, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, coalesce(abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) <= 1000000, false) AS ok FROM (SELECT place, fiscal_year, sum(amount) FILTER (dataset = 'award') AS a, sum(amount) FILTER (dataset = 'contract') AS b FROM items GROUP BY ALL)"))
def v02(spark, sf):
    part = lambda d: F.sum(F.when(F.col("dataset") == d, F.col("amount"))).cast("double")
    both = items(spark, sf, "dataset", "place", "amount", "fiscal_year").groupBy("place", "fiscal_year").agg(part("award").alias("a"), part("contract").alias("b"))
    return both.withColumn("ok", C.within(F.col("a"), F.col("b"), 1_000_000))


@query("v03_detail_and_summary", with_items("SELECT coalesce(d.place, s.place) AS place, CAST(d.v AS DOUBLE) AS parsed, CAST(s.v AS DOUBLE) AS printed, coalesce(abs(d.v - s.v) <= 1500, false) AS ok FROM (SELECT place, sum(amount) AS v FROM items GROUP BY 1) d FULL JOIN (SELECT place, sum(amount) AS v FROM items WHERE l_linenumber < 6 OR supplier_key > 5 GROUP BY 1) s ON d.place = s.place"))
def v03(spark, sf):
    rows = items(spark, sf, "place", "supplier_key", "amount", "l_linenumber")
    printed = rows.where("l_linenumber < 6 OR supplier_key > 5").groupBy("place").agg(F.sum("amount").alias("amount"))
    out = C.detail_against_summary(rows, printed, ["place"], 1500)
    return out.select("place", F.col("parsed").cast("double").alias("parsed"), F.col("printed").cast("double").alias("printed"), "ok")


@query("v04_over_a_cent", with_items("SELECT supplier_key, CAST(sum(amount) - sum(price) AS DOUBLE) AS difference FROM items GROUP BY supplier_key HAVING abs(sum(amount) - sum(price)) > 0.01"))
def v04(spark, sf):
    out = items(spark, sf, "supplier_key", "amount", "price").groupBy("supplier_key").agg((F.sum("amount") - F.sum("price")).alias("d")).where(F.abs("d") > 0.01)
    return out.select("supplier_key", F.col("d").cast("double").alias("difference"))


@query("v06_parts_equal_total", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE abs(l_extendedprice - l_extendedprice * (1 - l_discount)) > 300")
def v06(spark, sf):
    return table(spark, sf, "lineitem").where(F.abs(F.col("l_extendedprice") - F.col("l_extendedprice") * (1 - F.col("l_discount"))) > 300).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("v07_shards_add_up", with_items("SELECT count(*) AS records, CAST(sum(amount) AS DOUBLE) AS value FROM items"))
def v07(spark, sf):
    rows = items(spark, sf, "supplier_key", "amount")
    parts = rows.groupBy("supplier_key").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    C.must_balance(parts, rows, "amount")
    return parts.agg(F.sum("n").alias("records"), F.sum("amount").cast("double").alias("value"))


@query("v08_guards", with_items("SELECT b.dataset, b.n AS before, a.n AS now, coalesce(coalesce(a.n, 0) < b.n * 0.98, false) AS alarm FROM (SELECT dataset, count(*) AS n FROM items GROUP BY 1) b LEFT JOIN (SELECT dataset, count(*) AS n FROM items WHERE dataset <> 'award' OR l_linenumber <> 1 GROUP BY 1) a ON a.dataset = b.dataset"))
def v08(spark, sf):
    count = lambda df: df.groupBy("dataset").agg(F.count("*").alias("n"))
    rows = items(spark, sf, "dataset", "l_linenumber")
    return C.guards(count(rows.where("dataset <> 'award' OR l_linenumber <> 1")), count(rows))


@query("v08_all_guards", """
SELECT 'stale' AS guard, '1998-11-01' AS subject, true AS problem UNION ALL SELECT 'download', 'u' || n_nationkey, n_nationkey % 5 > 0 FROM nation WHERE n_nationkey < 10
UNION ALL SELECT 'files', CAST(count(*) - 1 AS VARCHAR), true FROM nation UNION ALL SELECT 'dataset', 'award', true FROM (SELECT 1) WHERE (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <> 1) < 0.98 * (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A')""")
def v08b(spark, sf):
    """All four guards: a download of long ago, failures of which every fifth is known, a dataset without its first lines, a file less."""
    nations = table(spark, sf, "nation")
    state = lambda less: nations.agg(F.lit("1998-11-01").alias("gathered"), (F.count("*") - less).alias("files"))
    failed = nations.where("n_nationkey < 10").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("url"), F.lit("404").alias("reason"), "n_nationkey")
    rows = items(spark, sf, "dataset", "l_linenumber")
    count = lambda df: df.groupBy("dataset").agg(F.count("*").alias("n"))
    return C.run_guards(state(1), state(0), count(rows.where("dataset <> 'award' OR l_linenumber <> 1")), count(rows), failed, failed.where("n_nationkey % 5 = 0"), F.lit("1998-12-01").cast("date"))


@query("v09_tally", f"SELECT 'order' AS family, count(*) FILTER (ok) AS passed, count(*) AS made FROM ({_V01})")
def v09(spark, sf):
    return C.tally(_order_checks(spark, sf), ["order", "budget"])


#: Families of checks: within a report, budget and report, departments and report, this year and the next one's restatement.
_TERMS = [
    ("report-net", "a", 1, "report", "gross", 0, 0.01),
    ("report-net", "a", -1, "report", "related", 0, 0.01),
    ("report-net", "b", 1, "report", "net", 0, 0.01),
    ("report-cash", "a", 1, "report", "revenue", 0, 0.01),
    ("report-cash", "a", -1, "report", "net", 0, 0.01),
    ("report-cash", "b", 1, "report", "cash", 0, 0.01),
    ("original-revenue", "a", 1, "report", "revenue", 0, 0.0),
    ("original-revenue", "b", 1, "budget", "revenue", 0, 0.0),
    ("estimates-departments", "a", 1, "departments", "gross", 0, 500.0),
    ("estimates-departments", "b", 1, "budget", "gross", 0, 500.0),
    ("restated-net", "a", 1, "report", "net", 0, 0.0),
    ("restated-net", "b", 1, "report", "prior", 1, 0.0),
]
#: Figures of each document by year (and the year before, restated in odd years); the report misstates cash in one year of five, and the budget lacks revenue in one of seven.
_FIGURES = {
    ("report", "gross"): "sum(price)",
    ("report", "related"): "sum(CASE WHEN dataset = 'notice' THEN price END)",
    ("report", "net"): "sum(CASE WHEN dataset <> 'notice' THEN price END)",
    ("report", "revenue"): "sum(CASE WHEN currency = 'CAD' THEN price END)",
    ("report", "cash"): "sum(CASE WHEN currency = 'CAD' THEN price ELSE 0 END) - sum(CASE WHEN dataset <> 'notice' THEN price ELSE 0 END) + CASE WHEN year % 5 = 0 THEN 1000 ELSE 0 END",
    ("budget", "revenue"): "CASE WHEN year % 7 <> 0 THEN sum(CASE WHEN currency = 'CAD' THEN price END) END",
    ("budget", "gross"): "sum(price) + 400",
    ("departments", "gross"): "sum(CASE WHEN l_linenumber < 7 OR year % 3 > 0 THEN price END)",
}
_FIGURE_SQL = " UNION ALL ".join(f"SELECT year, '{d}' AS doc, '{m}' AS measure, CAST({x} AS DECIMAL(28,2)) AS amount FROM lines GROUP BY year" for (d, m), x in _FIGURES.items())
_FIGURE_SQL += f" UNION ALL SELECT year + 1, 'report', 'prior', {_FIGURES['report', 'net']} + year % 2 FROM lines GROUP BY year"
_TERM_SQL = ", ".join(f"('{c}', '{s}', {g}, '{d}', '{m}', {h}, {t})" for c, s, g, d, m, h, t in _TERMS)
_V02B = with_items(f"""
, lines AS (SELECT CAST(substr(fiscal_year, 1, 4) AS BIGINT) AS year, dataset, currency, l_linenumber, price FROM items),
figures AS ({_FIGURE_SQL}),
terms AS (SELECT * FROM (VALUES {_TERM_SQL}) t("check", side, sign, doc, measure, shift, tolerance)),
years AS (SELECT DISTINCT year - shift AS year, "check", any_value(tolerance) AS tolerance FROM figures JOIN terms USING (doc, measure) WHERE amount IS NOT NULL GROUP BY ALL),
sides AS (SELECT y.year, y."check", y.tolerance, t.side, CASE WHEN count(f.amount) = count(*) THEN sum(t.sign * f.amount) END AS v
  FROM years y JOIN terms t ON t."check" = y."check" LEFT JOIN figures f ON f.doc = t.doc AND f.measure = t.measure AND f.year = y.year + t.shift GROUP BY ALL)
SELECT year, "check", CAST(max(v) FILTER (side = 'a') AS DOUBLE) AS a, CAST(max(v) FILTER (side = 'b') AS DOUBLE) AS b,
  coalesce(abs(CAST(max(v) FILTER (side = 'a') AS DOUBLE) - CAST(max(v) FILTER (side = 'b') AS DOUBLE)) <= max(tolerance), false) AS ok
FROM sides GROUP BY year, "check"
""")


@query("v02_statement_families", _V02B)
def v02b(spark, sf):
    lines = items(spark, sf, "dataset", "currency", "price", "fiscal_year", "l_linenumber").withColumn("year", F.substring("fiscal_year", 1, 4).cast("long"))
    wide = lines.groupBy("year").agg(*(F.expr(f"CAST({x} AS DECIMAL(28,2))").alias(f"{d}_{m}") for (d, m), x in _FIGURES.items()))
    figure = lambda year, d, m, amount: F.struct(year.alias("year"), F.lit(d).alias("doc"), F.lit(m).alias("measure"), amount.cast("decimal(28,2)").alias("amount"))
    year = F.col("year")
    stated = [figure(year, d, m, F.col(f"{d}_{m}")) for d, m in _FIGURES]
    restated = figure(year + 1, "report", "prior", F.col("report_net") + year % 2)
    return C.statement_checks(wide.select(F.inline(F.array(*stated, restated))), _TERMS)


@query("v05_three_ways", """
WITH l AS (SELECT l_orderkey AS claim, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS lines FROM lineitem GROUP BY 1),
p AS (SELECT claim, lines + CASE WHEN claim % 11 = 0 THEN 1 ELSE 0 END AS printed FROM l WHERE claim % 7 <> 0),
w AS (SELECT claim, lines - CASE WHEN claim % 13 = 0 THEN 5 ELSE 0 END AS listed FROM l WHERE claim % 5 <> 0 UNION ALL SELECT -1, 10)
SELECT claim, CAST(lines AS DOUBLE) AS lines, CAST(printed AS DOUBLE) AS printed, CAST(listed AS DOUBLE) AS listed, lines = printed AS lines_ok, listed = printed AS listing_ok FROM l FULL JOIN p USING (claim) FULL JOIN w USING (claim)""")
def v05(spark, sf):
    """Parsed lines, printed total and listed total of every claim; some totals planted wrong, some missing."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    sums, k = lines.groupBy("claim").agg(F.sum("amount").alias("amount")), F.col("claim")
    printed = sums.where(k % 7 != 0).withColumn("amount", F.col("amount") + F.when(k % 11 == 0, 1).otherwise(0))
    listed = sums.where(k % 5 != 0).withColumn("amount", F.col("amount") - F.when(k % 13 == 0, 5).otherwise(0)).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(10)))
    found = C.three_ways(lines, printed, listed, ["claim"])
    return found.select("claim", *(F.col(c).cast("double").alias(c) for c in ("lines", "printed", "listed")), "lines_ok", "listing_ok")


@query("b05_budget_pairs", with_items("""
, f AS (SELECT fiscal_year, currency AS basis, CASE WHEN l_linenumber < 4 THEN 'spending' ELSE 'revenue' END AS measure, CASE dataset WHEN 'award' THEN 'budget' ELSE dataset END AS doc, amount, l_linenumber AS page FROM items WHERE amount IS NOT NULL AND NOT (dataset = 'contract' AND l_linenumber = 5)),
s AS (SELECT fiscal_year, basis, measure, doc, sum(amount) AS a, min('https://example.org/' || doc || '#page=' || page) AS link FROM f GROUP BY ALL),
m AS (SELECT fiscal_year, basis, measure, max(a) FILTER (doc = 'budget') AS b, coalesce(max(a) FILTER (doc = 'contract'), max(a) FILTER (doc = 'notice')) AS c, max(link) FILTER (doc = 'budget') AS bl, coalesce(max(link) FILTER (doc = 'contract'), max(link) FILTER (doc = 'notice')) AS cl FROM s GROUP BY ALL)
SELECT fiscal_year, basis, CAST(max(b) FILTER (measure = 'spending') AS DOUBLE) AS budget, CAST(max(c) FILTER (measure = 'spending') AS DOUBLE) AS actual, CAST(max(c - b) FILTER (measure = 'revenue') AS DOUBLE) AS revenue_difference,
  CASE WHEN max(c) IS NOT NULL THEN 'published' ELSE 'not yet published' END AS status, min(bl) AS budget_source, min(cl) AS actual_source FROM m GROUP BY ALL"""))
def b05(spark, sf):
    """Pairs of budget and actual by year and basis, with differences, status and the pages they come from."""
    rows = items(spark, sf, "dataset", "currency", "amount", "fiscal_year", "l_linenumber").where("amount IS NOT NULL AND NOT (dataset = 'contract' AND l_linenumber = 5)")
    doc = F.when(F.col("dataset") == "award", "budget").otherwise(F.col("dataset"))
    facts = rows.select("fiscal_year", F.col("currency").alias("basis"), F.when(F.col("l_linenumber") < 4, "spending").otherwise("revenue").alias("measure"), doc.alias("doc"), "amount", F.concat(F.lit("https://example.org/"), doc).alias("source"), F.col("l_linenumber").alias("page"))
    out = answers.budget_pairs(facts, ["fiscal_year"], ["spending", "revenue"], ["budget", "contract", "notice"])
    return out.select("fiscal_year", "basis", F.col("spending.budget").cast("double").alias("budget"), F.col("spending.actual").cast("double").alias("actual"), F.col("revenue.difference").cast("double").alias("revenue_difference"), "status", "budget_source", "actual_source")
