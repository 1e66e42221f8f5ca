"""Evidence, splitting, blocks and the remaining rows of each series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, dates, evidence, names
from ..operators import answers, searching, splitting, totals
from .ledger import OVERLAP, items, with_items
from .registry import query, table


@query("n18_method", "SELECT o_orderkey, CASE WHEN k = 0 THEN 'Sole source' WHEN k = 1 THEN 'Emergency' WHEN k = 2 THEN 'For resale' WHEN k = 3 THEN 'Pre-qualified supplier' WHEN k = 4 THEN 'Security' WHEN k = 5 THEN 'Rates set by regulator' WHEN k = 6 THEN 'Exception (other)' WHEN o_orderstatus = 'F' THEN 'Limited call' WHEN o_orderstatus = 'O' THEN 'Open call' WHEN o_custkey % 2 = 0 THEN 'Exception (clause not given)' ELSE 'Not stated' END AS method FROM (SELECT *, o_orderkey % 9 AS k FROM orders)")
def n18(spark, sf):
    clauses = ("6(a)(v)", "urgent repair", "for resale", "6(a)(vi) prequalified", "6 (a) (ii)", "6(b) PUB", "unknown clause", "N/A", "")
    clause = F.element_at(F.array(*map(F.lit, clauses)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "F", "Limited Call for Bids").when(F.col("o_orderstatus") == "O", "Open call").otherwise("")
    section = F.when(F.col("o_custkey") % 2 == 0, "Exception").otherwise("Award")
    return table(spark, sf, "orders").select("o_orderkey", evidence.procurement_method(clause, kind, section).alias("method"))


@query("n28_reviews", with_items("SELECT id, CASE WHEN l_linenumber = 1 AND supplier_key = 1 THEN 'reviewed' ELSE 'unreviewed' END AS review_state, CASE WHEN l_linenumber = 1 AND supplier_key = 1 THEN 'local' ELSE 'unknown' END AS scope, CASE WHEN amount IS NULL THEN 'not stated' WHEN amount = 0 THEN 'published zero' ELSE 'published value' END AS coverage FROM items"))
def n28c(spark, sf):
    rows = items(spark, sf, "id", "supplier_key", "description", "amount", "l_linenumber").select("id", "description", "amount", "supplier_key", "l_linenumber")
    reviews = rows.where("l_linenumber = 1 AND supplier_key = 1").select("id", "description", F.lit("local").alias("status"), F.lit("The record names a place").alias("statement")).dropDuplicates(["id"])
    return evidence.with_reviews(rows, reviews, "description").select("id", "review_state", "scope", evidence.coverage(F.col("amount")).alias("coverage"))


@query("n35_match_department", "SELECT p_partkey, name FROM part LEFT JOIN (SELECT p_type AS t, arg_max(n, (length(n), n)) AS name FROM (SELECT DISTINCT p_type FROM part), (VALUES ('Brass'), ('Standard Brass'), ('Small Tin')) k(n) WHERE list_has_all(string_split(lower(p_type), ' '), string_split(lower(n), ' ')) GROUP BY 1) ON p_type = t")
def n35(spark, sf):
    known = spark.createDataFrame([("Brass",), ("Standard Brass",), ("Small Tin",)], "name string")
    return evidence.words_contained(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", known, "name").select("p_partkey", "name")


@query("n36_longest_prefix", "SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD B%' THEN 'standard b' WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'SMALL%' THEN 'small' END AS name FROM part")
def n36(spark, sf):
    known = spark.createDataFrame([("STANDARD", "standard"), ("STANDARD B", "standard b"), ("SMALL", "small")], "prefix string, name string")
    return evidence.longest_prefix(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", known).select("p_partkey", "name")


@query("n43_period_text", with_items("SELECT supplier_key, place, CASE WHEN n <= 3 THEN l ELSE n || ' reported periods' END AS periods FROM (SELECT supplier_key, place, count(DISTINCT fiscal_year) AS n, string_agg(DISTINCT fiscal_year, '; ' ORDER BY fiscal_year) AS l FROM items GROUP BY ALL)"))
def n43b(spark, sf):
    by = items(spark, sf, "place", "supplier_key", "fiscal_year").groupBy("supplier_key", "place").agg(F.sort_array(F.collect_set("fiscal_year")).alias("p"))
    return by.select("supplier_key", "place", evidence.period_text(F.col("p")).alias("periods"))


@query("s02_stale", "SELECT event_id, ts < TIMESTAMP '2024-06-01' - INTERVAL 8 DAY AS stale FROM events")
def s02(spark, sf):
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", dates.stale(F.col("ts"), now, 8).alias("stale"))


@query("j02_using_dimension", with_items("SELECT buyer_key, min(buyer) AS buyer, min(c_mktsegment) AS segment, count(*) AS n FROM items JOIN customer ON buyer_key = c_custkey GROUP BY buyer_key"))
def j02(spark, sf):
    buyers = table(spark, sf, "customer").select(F.col("c_custkey").alias("buyer_key"), F.col("c_mktsegment").alias("segment"))
    return items(spark, sf, "buyer_key", "buyer").join(buyers, "buyer_key").groupBy("buyer_key").agg(F.min("buyer").alias("buyer"), F.min("segment").alias("segment"), F.count("*").alias("n"))


@query("j20_slug_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j20(spark, sf):
    key = codes.slug(F.concat(F.col("n_regionkey").cast("string"), F.lit(" & Region")))
    other = codes.slug(F.concat(F.col("r_regionkey").cast("string"), F.lit(" AND  region!")))
    left = table(spark, sf, "nation").withColumn("slug", key)
    return left.join(table(spark, sf, "region").withColumn("slug", other), "slug").select("n_name", "r_name")


@query("j23_issue_to_missing_year", "SELECT g.s AS supplier_key, g.y AS year FROM (SELECT s, y FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem), (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem)) g ANTI JOIN (SELECT DISTINCT l_suppkey AS s, year(l_shipdate) AS y FROM lineitem WHERE l_linenumber = 7) p ON g.s = p.s AND g.y = p.y")
def j23(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier_key"), F.year("l_shipdate").cast("long").alias("year"), (F.col("l_linenumber") == 7).alias("stated"))
    by = rows.groupBy("supplier_key", "year").agg(F.nullif(F.bool_or("stated"), F.lit(False)).alias("stated"))
    return totals.densify(by, "supplier_key", "year").where("stated IS NULL").select("supplier_key", "year")


@query("l04_windowed_pages", with_items("SELECT id FROM items WHERE supplier_key IN (SELECT supplier_key FROM items WHERE description LIKE '%a%' GROUP BY 1 ORDER BY sum(amount) DESC NULLS LAST, supplier_key LIMIT 5) AND description LIKE '%a%' ORDER BY items.amount DESC NULLS LAST, id LIMIT 25 OFFSET 25"))
def l04(spark, sf):
    rows = items(spark, sf, "id", "supplier_key", "description", "amount").where(F.contains("description", F.lit("a")))
    top = rows.groupBy("supplier_key").agg(F.sum("amount").alias("v")).orderBy(F.col("v").desc_nulls_last(), "supplier_key").limit(5)
    kept = rows.join(top.select("supplier_key"), "supplier_key", "left_semi")
    return kept.orderBy(F.col("amount").desc_nulls_last(), "id").offset(25).limit(25).select("id")


@query("l08_null_order", with_items("SELECT id FROM items ORDER BY items.amount ASC NULLS FIRST, id LIMIT 50"))
def l08(spark, sf):
    return items(spark, sf, "id", "amount").orderBy(F.col("amount").asc_nulls_first(), "id").limit(50).select("id")


@query("b01_budget_and_actual", with_items("SELECT fiscal_year, basis, CAST(b AS DOUBLE) AS budget, CAST(a AS DOUBLE) AS actual FROM (SELECT fiscal_year, currency AS basis, sum(amount) FILTER (dataset = 'award') AS b, coalesce(sum(amount) FILTER (dataset = 'contract'), sum(amount) FILTER (dataset = 'notice')) AS a FROM items GROUP BY ALL)"))
def b01(spark, sf):
    doc = F.when(F.col("dataset") == "award", "budget").otherwise(F.col("dataset"))
    facts = items(spark, sf, "dataset", "currency", "amount", "fiscal_year").select("fiscal_year", F.col("currency").alias("basis"), doc.alias("doc"), "amount")
    out = answers.budget_against_actual(facts, ["fiscal_year"], ["budget", "contract", "notice"])
    return out.select("fiscal_year", "basis", F.col("budget").cast("double").alias("budget"), F.col("actual").cast("double").alias("actual"))


@query("b06_narrowed_totals", with_items("SELECT dataset, currency, place, count(*) AS records, CAST(sum(amount) AS DOUBLE) AS value FROM items WHERE dataset = 'notice' GROUP BY ALL"))
def b06(spark, sf):
    out = totals.group_totals(items(spark, sf, "dataset", "currency", "place", "amount").where("dataset = 'notice'"), "place", overlap=OVERLAP)
    return out.where("NOT included").select("dataset", "currency", "place", "records", "value")


@query("m07_list_flags", with_items("SELECT method AS flag, count(*) AS items FROM items WHERE method <> 'Open call' GROUP BY method"))
def m07(spark, sf):
    return items(spark, sf, "method").where("method <> 'Open call'").groupBy(F.col("method").alias("flag")).agg(F.count("*").alias("items"))


@query("m10_search_and_fetch", with_items("SELECT id, supplier, CASE WHEN currency = 'CAD' THEN CAST(amount AS DOUBLE) END AS amount_cad FROM items WHERE regexp_matches(description, '(^| )b') AND supplier_key = 1"))
def m10(spark, sf):
    rows = items(spark, sf, "id", "currency", "buyer", "supplier_key", "supplier", "description", "amount", "award_date").where("supplier_key = 1")
    posted = searching.postings(rows, "id", "description").withColumnRenamed("id", "doc_id")
    hits = searching.matching(posted, ["b"])
    return answers.citation(rows.join(hits.withColumnRenamed("doc_id", "id"), "id", "left_semi")).select("id", F.col("cite.supplier").alias("supplier"), F.col("cite.amount_cad").alias("amount_cad"))


