"""Aggregations over the ledger (A-series)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import families, once, totals
from .ledger import OVERLAP, items, with_items
from .registry import query, table

MEASURES = "count(*) AS records, count(*) FILTER (amount IS NULL) AS missing, count(*) FILTER (amount = 0) AS zero, CAST(sum(amount) AS DOUBLE) AS value"


def _dbl(c: str):
    return F.col(c).cast("double").alias(c)


@query("a01_dataset_totals", with_items("SELECT dataset, count(*) AS n, CAST(sum(CASE WHEN currency = 'CAD' THEN amount END) AS DOUBLE) AS cad FROM items GROUP BY dataset"))
def a01(spark, sf):
    return items(spark, sf, "dataset", "currency", "amount").groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.when(F.col("currency") == "CAD", F.col("amount"))).cast("double").alias("cad"))


@query("a02_foreign_currency", with_items("SELECT dataset, currency, count(*) AS n, count(amount) AS stated, CAST(sum(amount) AS DOUBLE) AS value FROM items WHERE currency <> 'CAD' GROUP BY ALL"))
def a02(spark, sf):
    return items(spark, sf, "dataset", "currency", "amount").where("currency <> 'CAD'").groupBy("dataset", "currency").agg(F.count("*").alias("n"), F.count("amount").alias("stated"), F.sum("amount").cast("double").alias("value"))


@query("a03_conditional_share", with_items("SELECT place, CAST(sum(CASE WHEN method <> 'Open call' THEN amount END) AS DOUBLE) AS exceptions, round(CAST(sum(CASE WHEN method <> 'Open call' THEN amount END) AS DOUBLE) / CAST(nullif(sum(amount), 0) AS DOUBLE), 6) AS share FROM items WHERE dataset <> 'notice' GROUP BY place"))
def a03(spark, sf):
    part = F.sum(F.when(F.col("method") != "Open call", F.col("amount"))).cast("double")
    rows = items(spark, sf, "dataset", "place", "amount", "method").where("dataset <> 'notice'").groupBy("place").agg(part.alias("exceptions"), F.sum("amount").cast("double").alias("whole"))
    return rows.select("place", "exceptions", F.round(F.try_divide("exceptions", "whole"), 6).alias("share"))


@query("a04_missing_and_zero", with_items("SELECT place, count(*) FILTER (amount IS NULL) AS missing, count(*) FILTER (amount = 0) AS zero FROM items GROUP BY place"))
def a04(spark, sf):
    return items(spark, sf, "place", "amount").groupBy("place").agg(F.count_if(F.col("amount").isNull()).alias("missing"), F.count_if(F.col("amount") == 0).alias("zero"))


_GRAIN = "dataset, currency, place, supplier_key, method, fiscal_year"


@query("a05_finest_grain", with_items(f"SELECT {_GRAIN}, {MEASURES} FROM items GROUP BY {_GRAIN}"))
def a05(spark, sf):
    return items(spark, sf, *_GRAIN.split(", "), "amount").groupBy(*_GRAIN.split(", ")).agg(*totals.measures())


@query("a06_group_totals", with_items(f"SELECT dataset, currency, place, fiscal_year, {MEASURES}, dataset <> 'notice' AS included FROM items GROUP BY dataset, currency, place, fiscal_year"))
def a06(spark, sf):
    return totals.group_totals(items(spark, sf, "dataset", "currency", "place", "fiscal_year", "amount"), "place", "fiscal_year", overlap=OVERLAP)


@query("a07_breakdown_periods", with_items(f"SELECT dataset, currency, method, {MEASURES}, count(DISTINCT fiscal_year) AS periods, string_agg(DISTINCT fiscal_year, ',' ORDER BY fiscal_year) AS period_list FROM items GROUP BY dataset, currency, method"))
def a07(spark, sf):
    seen = F.sort_array(F.collect_set("fiscal_year"))
    return items(spark, sf, "dataset", "currency", "method", "fiscal_year", "amount").groupBy("dataset", "currency", "method").agg(*totals.measures(), F.size(seen).cast("long").alias("periods"), F.array_join(seen, ",").alias("period_list"))


_A08 = """
SELECT * FROM (
  SELECT supplier_key, min(supplier) AS supplier, count(*) AS records,
         CAST(sum(CASE WHEN dataset <> 'notice' AND currency = 'CAD' THEN amount END) AS DOUBLE) AS counted,
         CAST(sum(CASE WHEN dataset = 'notice' AND currency = 'CAD' THEN amount END) AS DOUBLE) AS overlap,
         count(DISTINCT buyer_key) AS buyers
  FROM items GROUP BY supplier_key
) JOIN (
  SELECT supplier_key, string_agg(fiscal_year || ':' || n, ',' ORDER BY fiscal_year) AS by_year
  FROM (SELECT supplier_key, fiscal_year, count(*) AS n FROM items GROUP BY ALL) GROUP BY supplier_key
) USING (supplier_key)
"""


@query("a08_supplier_summary", with_items(_A08))
def a08(spark, sf):
    rows = items(spark, sf, "dataset", "currency", "buyer_key", "supplier_key", "supplier", "amount", "fiscal_year")
    cad = lambda test: F.sum(F.when(test & (F.col("currency") == "CAD"), F.col("amount"))).cast("double")
    base = rows.groupBy("supplier_key").agg(
        F.min("supplier").alias("supplier"), F.count("*").alias("records"), cad(F.col("dataset") != "notice").alias("counted"), cad(F.col("dataset") == "notice").alias("overlap"), F.countDistinct("buyer_key").alias("buyers")
    )
    years = rows.groupBy("supplier_key", "fiscal_year").agg(F.count("*").alias("n")).groupBy("supplier_key")
    years = years.agg(F.array_join(F.sort_array(F.collect_list(F.concat("fiscal_year", F.lit(":"), F.col("n").cast("string")))), ",").alias("by_year"))
    return base.join(years, "supplier_key")


@query("a09_body_by_method", with_items("SELECT buyer_key, method, dataset, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS value FROM items WHERE currency = 'CAD' GROUP BY ALL"))
def a09(spark, sf):
    return items(spark, sf, "dataset", "currency", "buyer_key", "amount", "method").where("currency = 'CAD'").groupBy("buyer_key", "method", "dataset").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("value"))


@query("a10_distinct_list", with_items("SELECT buyer_key, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM items GROUP BY buyer_key"))
def a10(spark, sf):
    return items(spark, sf, "dataset", "buyer_key").groupBy("buyer_key").agg(F.array_join(F.sort_array(F.collect_set("dataset")), ",").alias("datasets"))


@query("a11_count_distinct", with_items("SELECT place, count(DISTINCT supplier_key) AS suppliers, count(DISTINCT buyer_key) AS buyers FROM items GROUP BY place"))
def a11(spark, sf):
    return items(spark, sf, "buyer_key", "place", "supplier_key").groupBy("place").agg(F.countDistinct("supplier_key").alias("suppliers"), F.countDistinct("buyer_key").alias("buyers"))


@query("a12_having_distinct", with_items("SELECT buyer_key, count(DISTINCT supplier_key) AS suppliers FROM items GROUP BY buyer_key HAVING count(DISTINCT supplier_key) > 20"))
def a12(spark, sf):
    return items(spark, sf, "buyer_key", "supplier_key").groupBy("buyer_key").agg(F.countDistinct("supplier_key").alias("suppliers")).where("suppliers > 20")


@query("a13_row_of_minimum", with_items("SELECT supplier_key, min(award_date) AS first_date, arg_min(id, (award_date, id)) AS first_id FROM items GROUP BY supplier_key"))
def a13(spark, sf):
    return items(spark, sf, "id", "supplier_key", "award_date").groupBy("supplier_key").agg(F.min("award_date").alias("first_date"), F.min_by("id", F.struct("award_date", "id")).alias("first_id"))


@query("a14_mean_by_title", with_items("SELECT category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, round(CAST(sum(amount) AS DOUBLE) / count(amount), 6) AS mean FROM items GROUP BY category"))
def a14(spark, sf):
    rows = items(spark, sf, "category", "amount").groupBy("category").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.count("amount").alias("stated"))
    return rows.select("category", "n", "total", F.round(F.col("total") / F.col("stated"), 6).alias("mean"))


@query("a15_most_common_name", with_items("SELECT buyer_key, category FROM (SELECT buyer_key, category, row_number() OVER (PARTITION BY buyer_key ORDER BY count(*) DESC, category) AS r FROM items GROUP BY buyer_key, category) WHERE r = 1"))
def a15(spark, sf):
    return totals.most_common(items(spark, sf, "buyer_key", "category"), "buyer_key", "category")


@query("a16_upper_median", with_items("SELECT place, CAST(amount AS DOUBLE) AS amount FROM (SELECT place, amount, row_number() OVER (PARTITION BY place ORDER BY amount) AS r, count(*) OVER (PARTITION BY place) AS n FROM items WHERE amount IS NOT NULL) WHERE r = n // 2 + 1"))
def a16(spark, sf):
    return totals.upper_median(items(spark, sf, "place", "amount"), "amount", "place").select("place", F.col("amount").cast("double").alias("amount"))


@query("a17_concentration", with_items("""
SELECT buyer_key, supplier_key, CAST(a AS DOUBLE) AS part_total, n AS part_count, CAST(t AS DOUBLE) AS total FROM (
  SELECT *, sum(a) OVER (PARTITION BY buyer_key) AS t, row_number() OVER (PARTITION BY buyer_key ORDER BY a DESC, supplier_key) AS r
  FROM (SELECT buyer_key, supplier_key, sum(amount) AS a, count(*) AS n FROM items WHERE amount <> 0 GROUP BY ALL)) WHERE r = 1"""))
def a17(spark, sf):
    out = totals.concentration(items(spark, sf, "buyer_key", "supplier_key", "amount"), ["buyer_key"], "supplier_key")
    return out.select("buyer_key", "supplier_key", F.col("part_total").cast("double").alias("part_total"), "part_count", F.col("total").cast("double").alias("total"))


@query("a18_near_limit_histogram", with_items("SELECT CAST(l AS INTEGER) AS limit_value, count(*) FILTER (amount >= 0.95 * l AND amount < l) AS below, count(*) FILTER (amount >= l AND amount < 1.05 * l) AS above FROM items, (VALUES (34700), (50000), (25000)) t(l) GROUP BY l"))
def a18(spark, sf):
    rows = items(spark, sf, "amount").where("amount IS NOT NULL").select("amount", F.explode(F.array(*map(F.lit, (34700, 50000, 25000)))).alias("limit_value"))
    a, at = F.col("amount"), F.col("limit_value")
    inside = lambda low, high: F.count_if((a >= at * F.lit(low).cast("decimal(4,2)")) & (a < at * F.lit(high).cast("decimal(4,2)")))
    return rows.groupBy("limit_value").agg(inside(0.95, 1).alias("below"), inside(1, 1.05).alias("above"))


_LATEST = "l_shipdate, l_partkey, l_linenumber, l_quantity, l_extendedprice"


@query("a19_latest_or_sum", f"""
SELECT l_orderkey, l_suppkey, CAST(CASE WHEN l_suppkey % 2 = 0 THEN sum(price) ELSE arg_max(price, ({_LATEST})) END AS DOUBLE) AS amount, count(*) AS amendments
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem) GROUP BY l_orderkey, l_suppkey""")
def a19(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = once.latest_or_sum(rows, ["l_orderkey", "l_suppkey"], [F.col(c) for c in _LATEST.split(", ")], "price", F.col("l_suppkey") % 2 == 0)
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("a20_last_stated", f"SELECT l_orderkey, arg_max(l_returnflag, ({_LATEST})) FILTER (l_returnflag <> 'N') AS flag FROM lineitem GROUP BY l_orderkey")
def a20(spark, sf):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(once.last_stated(flag, *(F.col(c) for c in _LATEST.split(", "))).alias("flag"))


@query("a21_stratified_sample", with_items("SELECT dataset, id FROM (SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY amount IS NULL DESC, md5(id || '42'), id) AS r FROM items) WHERE r <= 25"))
def a21(spark, sf):
    order = W.partitionBy("dataset").orderBy(F.desc("first"), F.md5(F.concat("id", F.lit("42"))), "id")
    rows = items(spark, sf, "id", "dataset", "amount").select("dataset", "id", F.col("amount").isNull().alias("first"))
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 25").select("dataset", "id")


@query("a22_average_of_present", with_items("SELECT fiscal_year, count(DISTINCT buyer_key) AS present, round(CAST(sum(amount) AS DOUBLE) / count(DISTINCT buyer_key), 4) AS mean FROM items WHERE currency = 'CAD' GROUP BY fiscal_year"))
def a22(spark, sf):
    by = items(spark, sf, "currency", "buyer_key", "amount", "fiscal_year").where("currency = 'CAD'").groupBy("fiscal_year", "buyer_key").agg(F.sum("amount").alias("a"))
    return by.groupBy("fiscal_year").agg(F.count("*").alias("present"), F.round(F.sum("a").cast("double") / F.count("*"), 4).alias("mean"))


@query("a23_document_frequency", "SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM documents) WHERE length(word) >= 3 AND NOT regexp_matches(word, '[0-9]') GROUP BY word")
def a23(spark, sf):
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))
    rows = table(spark, sf, "documents").select(F.explode(words).alias("word"))
    return rows.where((F.length("word") >= 3) & ~F.col("word").rlike("[0-9]")).groupBy("word").agg(F.count("*").alias("df"))


@query("a24_nested_years", with_items("SELECT place, string_agg(fiscal_year || '=' || m, ';' ORDER BY fiscal_year) AS years FROM (SELECT place, fiscal_year, string_agg(method || ':' || n, ',' ORDER BY method) AS m FROM (SELECT place, fiscal_year, method, count(*) AS n FROM items GROUP BY ALL) GROUP BY ALL) GROUP BY place"))
def a24(spark, sf):
    inner = items(spark, sf, "place", "method", "fiscal_year").groupBy("place", "fiscal_year", "method").agg(F.count("*").alias("n")).groupBy("place", "fiscal_year")
    inner = inner.agg(F.sort_array(F.collect_list(F.struct("method", "n"))).alias("methods"))
    nested = inner.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("fiscal_year", "methods"))).alias("years"))
    line = lambda y: F.concat(y["fiscal_year"], F.lit("="), F.array_join(F.transform(y["methods"], lambda m: F.concat(m["method"], F.lit(":"), m["n"].cast("string"))), ","))
    return nested.select("place", F.array_join(F.transform("years", line), ";").alias("years"))


#: What the families are made of: before, every amount as printed; after, only what is in CAD.
_FAMILY_ITEMS = """f AS (SELECT id, amount, currency, dataset, coalesce(CAST(year(award_date) AS VARCHAR), fiscal_year) AS year, CAST(year(award_date) AS VARCHAR) AS award_year,
  CAST(buyer_key AS VARCHAR) AS buyer, CASE WHEN supplier_key % 11 = 0 THEN '' ELSE CAST(supplier_key AS VARCHAR) END AS supplier, method, CASE WHEN dataset = 'notice' THEN 'excluded' ELSE 'included' END AS label,
  l_quantity, dataset <> 'award' OR l_quantity < 40 AS buys, dataset <> 'award' AS tenders, supplier_key % 11 <> 0 AS supplied, dataset = 'contract' AS federal FROM items)"""
_FLAGGED = "SELECT 'sole-source' AS flag, id FROM f WHERE method = 'Sole source' UNION ALL SELECT 'large-order', id FROM f WHERE l_quantity >= 45"


def _family_sql() -> str:
    parts = []
    for name, (keys, held) in families.FAMILIES.items():
        key = " || ' / ' || ".join(f"coalesce(nullif({k}, ''), 'not stated')" for k in keys) or "''"
        where = " AND ".join("label = 'included'" if h == "label" else h for h in held) or "true"
        parts.append(f"SELECT '{name}' AS family, {key} AS key, amount, currency FROM f WHERE {where}")
    parts.append(f"SELECT 'pattern', flag, amount, currency FROM ({_FLAGGED}) x JOIN f USING (id)")
    parts.append("SELECT 'provincial-actuals', fiscal_year, price, currency FROM items WHERE l_linenumber = 1")
    return " UNION ALL ".join(parts)


@query("a25_key_families", with_items(f"""
, {_FAMILY_ITEMS}, t AS (
  SELECT family, key, coalesce(sum(amount), 0) AS before, coalesce(sum(CASE WHEN currency = 'CAD' THEN amount END), 0) AS after FROM ({_family_sql()}) GROUP BY family, key
)
SELECT family, key, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, CAST(after - before AS DOUBLE) AS change FROM t WHERE before <> after"""))
def a25(spark, sf):
    """All fourteen families of two ledgers: amounts as printed, and in CAD only; what changed."""
    names = ("id", "amount", "currency", "dataset", "award_date", "fiscal_year", "buyer_key", "supplier_key", "method", "l_quantity")
    items(spark, sf, *names).createOrReplaceTempView("_family_items")
    rows = spark.sql(f"WITH {_FAMILY_ITEMS.replace('FROM items', 'FROM _family_items').replace('VARCHAR', 'STRING')} SELECT * FROM f")
    both = lambda c: {"before": F.col(c), "after": F.when(F.col("currency") == "CAD", F.col(c))}
    flags = F.array_compact(F.array(F.when(F.col("method") == "Sole source", "sole-source"), F.when(F.col("l_quantity") >= 45, "large-order")))
    spent = items(spark, sf, "currency", "fiscal_year", "l_linenumber", "price").where("l_linenumber = 1")
    totals_ = families.family_totals(rows.withColumns({**both("amount"), "flags": flags}), spent.withColumns(both("price")), ["before", "after"])
    found = families.changed_totals(totals_)
    return found.select("family", "key", *(F.col(c).cast("double").alias(c) for c in ("before", "after", "change")))


@query("a26_printings", with_items("SELECT supplier_key, count(*) AS n, count(DISTINCT dataset) AS datasets, count(DISTINCT place) AS places, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies FROM items GROUP BY supplier_key"))
def a26(spark, sf):
    return items(spark, sf, "dataset", "currency", "place", "supplier_key").groupBy("supplier_key").agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("datasets"), F.countDistinct("place").alias("places"), F.array_join(F.sort_array(F.collect_set("currency")), ",").alias("currencies"))


@query("a27_program_totals", with_items("SELECT category, min(description) AS name, CAST(sum(amount) AS DOUBLE) AS value, min(award_date) AS first_date FROM items WHERE dataset = 'contract' GROUP BY category"))
def a27(spark, sf):
    return items(spark, sf, "dataset", "description", "category", "amount", "award_date").where("dataset = 'contract'").groupBy("category").agg(F.min("description").alias("name"), F.sum("amount").cast("double").alias("value"), F.min("award_date").alias("first_date"))


@query("a28_pivot_methods", with_items("SELECT place, CAST(sum(amount) FILTER (method = 'Emergency') AS DOUBLE) AS emergency, CAST(sum(amount) FILTER (method = 'Open call') AS DOUBLE) AS open_call, CAST(sum(amount) FILTER (method = 'Sole source') AS DOUBLE) AS sole_source FROM items GROUP BY place"))
def a28(spark, sf):
    wide = items(spark, sf, "place", "amount", "method").groupBy("place").pivot("method", ["Emergency", "Open call", "Sole source"]).agg(F.sum("amount"))
    return wide.select("place", *(F.col(f"`{m}`").cast("double").alias(m.lower().replace(" ", "_")) for m in ("Emergency", "Open call", "Sole source")))


@query("a29_sum_by_year", with_items("SELECT fiscal_year, CAST(sum(amount) AS DOUBLE) AS value FROM items GROUP BY fiscal_year"))
def a29(spark, sf):
    return items(spark, sf, "amount", "fiscal_year").groupBy("fiscal_year").agg(F.sum("amount").cast("double").alias("value"))


@query("a30_body_sources", with_items("SELECT buyer_key, count(DISTINCT (dataset, currency)) AS sources, count(*) AS n FROM items GROUP BY buyer_key"))
def a30(spark, sf):
    return items(spark, sf, "dataset", "currency", "buyer_key").groupBy("buyer_key").agg(F.size(F.collect_set(F.struct("dataset", "currency"))).cast("long").alias("sources"), F.count("*").alias("n"))


@query("a31_currency_report", with_items("SELECT currency, count(*) AS records, count(*) FILTER (amount IS NULL) AS missing, CAST(sum(amount) AS DOUBLE) AS value FROM items WHERE dataset = 'notice' GROUP BY currency"))
def a31(spark, sf):
    return items(spark, sf, "dataset", "currency", "amount").where("dataset = 'notice'").groupBy("currency").agg(F.count("*").alias("records"), F.count_if(F.col("amount").isNull()).alias("missing"), F.sum("amount").cast("double").alias("value"))


@query("a32_values_for_predicate", with_items(f"SELECT dataset, currency, {MEASURES}, dataset <> 'notice' AS included FROM items WHERE method = 'Emergency' GROUP BY dataset, currency"))
def a32(spark, sf):
    return totals.group_totals(items(spark, sf, "dataset", "currency", "amount", "method").where("method = 'Emergency'"), overlap=OVERLAP)


@query("f14_json_field_totals", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))
