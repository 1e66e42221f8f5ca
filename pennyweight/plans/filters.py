"""Filters and predicates (F-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from .ledger import items, with_items
from .registry import query, table


@query("f01_region_selection", with_items("SELECT id FROM items WHERE place IN ('CANADA', 'FRANCE', '') OR supplier_key % 3 = 0"))
def f01(spark, sf):
    return items(spark, sf, "id", "place", "supplier_key").where(F.col("place").isin("CANADA", "FRANCE", "") | (F.col("supplier_key") % 3 == 0)).select("id")


@query("f02_placeholders_after_totals", with_items("SELECT place, count(*) AS raw, count(*) FILTER (amount IS NOT NULL) AS kept FROM items GROUP BY place HAVING count(*) FILTER (amount IS NOT NULL) > 0"))
def f02(spark, sf):
    return items(spark, sf, "place", "amount").groupBy("place").agg(F.count("*").alias("raw"), F.count("amount").alias("kept")).where("kept > 0")


@query("f05_equality_non_empty", with_items("SELECT id, supplier FROM items WHERE currency = 'CAD' AND supplier <> '' AND method = 'Emergency'"))
def f05(spark, sf):
    return items(spark, sf, "id", "currency", "supplier", "method").where("currency = 'CAD' AND supplier <> '' AND method = 'Emergency'").select("id", "supplier")


@query("f06_disabled_datasets", with_items("SELECT dataset, count(*) AS n FROM items WHERE dataset NOT IN ('notice') GROUP BY dataset"))
def f06(spark, sf):
    return items(spark, sf, "dataset").where(~F.col("dataset").isin("notice")).groupBy("dataset").agg(F.count("*").alias("n"))


@query("f07_facets", with_items("SELECT id FROM items WHERE dataset = 'award' AND CAST(award_date AS VARCHAR) LIKE '1996%' AND contains(fiscal_year, '96')"))
def f07(spark, sf):
    return items(spark, sf, "id", "dataset", "award_date", "fiscal_year").where((F.col("dataset") == "award") & (F.year("award_date") == 1996) & F.contains("fiscal_year", F.lit("96"))).select("id")


@query("f08_band", with_items("SELECT id, CAST(amount AS DOUBLE) AS amount FROM items WHERE amount >= 0.95 * 34700 AND amount < 34700"))
def f08(spark, sf):
    low = F.lit(34700).cast("decimal(18,2)")
    return items(spark, sf, "id", "amount").where((F.col("amount") >= F.lit("32965.00").cast("decimal(18,2)")) & (F.col("amount") < low)).select("id", F.col("amount").cast("double").alias("amount"))


@query("f09_between_dates", with_items("SELECT id FROM items WHERE award_date BETWEEN DATE '1995-04-01' AND DATE '1995-06-30'"))
def f09(spark, sf):
    return items(spark, sf, "id", "award_date").where(F.col("award_date").between("1995-04-01", "1995-06-30")).select("id")


@query("f10_like_any_case", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%'")
def f10(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%RED%")).select("p_partkey")


@query("f11_indexable", with_items("SELECT supplier_key FROM items GROUP BY supplier_key HAVING count(*) >= 50 AND sum(amount) >= 1000000"))
def f11(spark, sf):
    return items(spark, sf, "supplier_key", "amount").groupBy("supplier_key").agg(F.count("*").alias("n"), F.sum("amount").alias("v")).where("n >= 50 AND v >= 1000000").select("supplier_key")


@query("f12_clean_parameters", "SELECT DISTINCT o_orderpriority AS given, CASE WHEN regexp_full_match(lower(o_orderpriority), '[a-z0-9_-]{1,40}') THEN lower(o_orderpriority) ELSE '' END AS clean FROM orders")
def f12(spark, sf):
    given = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("given")).distinct()
    return given.withColumn("clean", F.when(F.lower("given").rlike("^[a-z0-9_-]{1,40}$"), F.lower("given")).otherwise(""))


@query("f13_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def f13(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_orderkey")
    return table(spark, sf, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("f14_not_in_list", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def f14(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("n15_vague_predicate", "SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) <= 2 AND NOT regexp_matches(p_name, '[0-9]') AND length(p_name) < 18 OR lower(p_name) IN ('services', 'goods')")
def vague(spark, sf):
    return table(spark, sf, "part").where(codes.vague(F.col("p_name"))).select("p_partkey")
