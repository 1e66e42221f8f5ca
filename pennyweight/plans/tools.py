"""The query interface over the ledger (M- and B-series)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import conform, pages, searching, totals
from .ledger import OVERLAP, items, with_items
from .registry import query, table


def _posted(rows):
    return searching.postings(rows, "id", "description").withColumnRenamed("id", "doc_id")


def _cad(c, name=None):
    return F.col(c).cast("double").alias(name or c)


@query("m01_search_records", with_items("SELECT id, CAST(amount AS DOUBLE) AS amount FROM items WHERE list_bool_or(list_transform(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda w: starts_with(w, 're'))) ORDER BY items.amount DESC NULLS LAST, id LIMIT 25 OFFSET 25"))
def m01(spark, sf):
    rows = items(spark, sf, "id", "description", "amount")
    return A.search_records(spark, rows, _posted(rows), "re", page=2).select("id", _cad("amount"))


@query("m02_get_record", with_items("SELECT id, supplier, description FROM items WHERE id = (SELECT max(id) FROM items)"))
def m02(spark, sf):
    rows = items(spark, sf, "id", "supplier", "description")
    last = rows.agg(F.max("id").alias("id")).first()["id"]
    return A.get_record(rows, last).select("id", "supplier", "description")


_MEAS = "count(*) AS records, count(*) FILTER (amount IS NULL) AS missing, count(*) FILTER (amount = 0) AS zero, CAST(sum(amount) AS DOUBLE) AS value, true AS included"


@query("m03_get_supplier", with_items(f"SELECT dataset, currency, supplier, fiscal_year, {_MEAS} FROM items WHERE supplier = (SELECT s_name FROM supplier WHERE s_suppkey = 1) GROUP BY ALL"))
def m03(spark, sf):
    name = table(spark, sf, "supplier").where("s_suppkey = 1").first()["s_name"]
    return A.get_supplier(items(spark, sf, "dataset", "currency", "supplier", "amount", "fiscal_year"), name.upper())


@query("m04_get_department", with_items("SELECT fiscal_year, place, method, CAST(sum(amount) AS DOUBLE) AS amount FROM items WHERE place = (SELECT min(n_name) FROM nation) AND fiscal_year = (SELECT max(fiscal_year) FROM items WHERE place = (SELECT min(n_name) FROM nation) AND dataset <> 'notice') GROUP BY ALL"))
def m04(spark, sf):
    name = table(spark, sf, "nation").agg(F.min("n_name").alias("n")).first()["n"]
    programs = items(spark, sf, "dataset", "place", "amount", "method", "fiscal_year").select("fiscal_year", F.col("place").alias("department"), "method", "amount", F.when(F.col("dataset") == "notice", "estimate").otherwise("actual").alias("kind"))
    found = A.get_department(programs, name.lower())
    return found.groupBy("fiscal_year", F.col("department").alias("place"), "method").agg(F.sum("amount").cast("double").alias("amount"))


@query("m05_get_budget", with_items("SELECT place, basis, CAST(b AS DOUBLE) AS budget, CAST(a AS DOUBLE) AS actual, CAST(a - b AS DOUBLE) AS difference FROM (SELECT place, currency AS basis, sum(amount) FILTER (dataset = 'award') AS b, coalesce(sum(amount) FILTER (dataset = 'contract'), sum(amount) FILTER (dataset = 'notice')) AS a FROM items GROUP BY ALL)"))
def m05(spark, sf):
    doc = F.when(F.col("dataset") == "award", "budget").otherwise(F.col("dataset"))
    facts = items(spark, sf, "dataset", "currency", "place", "amount").select("place", F.col("currency").alias("basis"), doc.alias("doc"), "amount")
    out = A.budget_against_actual(facts, ["place"], ["budget", "contract", "notice"])
    return out.select("place", "basis", *(_cad(c) for c in ("budget", "actual", "difference")))


@query("m06_member_averages", with_items("SELECT buyer_key, fiscal_year, CAST(a AS DOUBLE) AS amount, count(*) OVER () AS members FROM (SELECT buyer_key, fiscal_year, sum(amount) AS a FROM items WHERE fiscal_year = (SELECT max(fiscal_year) FROM items WHERE fiscal_year < (SELECT max(fiscal_year) FROM items)) GROUP BY ALL)"))
def m06(spark, sf):
    rows = items(spark, sf, "buyer_key", "amount", "fiscal_year").select(F.col("buyer_key").alias("member"), "fiscal_year", "amount")
    return A.member_averages(rows).select(F.col("member").alias("buyer_key"), "fiscal_year", _cad("amount"), "members")


@query("m08_get_flag", with_items("SELECT id, CAST(amount AS DOUBLE) AS value FROM items WHERE method = 'Emergency' ORDER BY amount DESC NULLS LAST, id LIMIT 25"))
def m08(spark, sf):
    flags = items(spark, sf, "id", "amount", "method").where("method = 'Emergency'").select("id", F.lit("emergency").alias("flag"), F.col("amount").alias("value"))
    return A.flag_examples(flags, "emergency").select("id", _cad("value"))


@query("m09_human_scale", with_items("SELECT place, round(v / 510000, 6) AS per_person, round(v / 220000, 6) AS per_household FROM (SELECT place, CAST(sum(amount) AS DOUBLE) AS v FROM items GROUP BY place)"))
def m09(spark, sf):
    sums = items(spark, sf, "place", "amount").groupBy("place").agg(F.sum("amount").alias("amount"))
    return A.human_scale(sums, 510_000, 220_000, 52_000).select("place", F.round("per_person", 6).alias("per_person"), F.round("per_household", 6).alias("per_household"))


@query("m12_get_pay", "SELECT a.employer, b.year, people, round(mean_pay, 6) AS mean_pay FROM (SELECT DISTINCT l_suppkey AS employer FROM lineitem) a CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) b LEFT JOIN (SELECT l_suppkey AS employer, year(l_shipdate) AS year, count(*) AS people, avg(l_quantity) AS mean_pay FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) p ON p.employer = a.employer AND p.year = b.year")
def m12(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("employer"), F.year("l_shipdate").cast("long").alias("year"), F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("pay"))
    by = rows.groupBy("employer", "year").agg(F.nullif(F.count("pay"), F.lit(0)).alias("people"), F.avg("pay").alias("mean_pay"))
    return totals.densify(by, "employer", "year").select("employer", "year", "people", F.round("mean_pay", 6).alias("mean_pay"))


@query("m13_get_body", with_items(f"SELECT dataset, currency, place, fiscal_year, {_MEAS} FROM items WHERE place = (SELECT max(n_name) FROM nation) GROUP BY ALL"))
def m13(spark, sf):
    name = table(spark, sf, "nation").agg(F.max("n_name").alias("n")).first()["n"]
    return A.get_body(items(spark, sf, "dataset", "currency", "place", "amount", "fiscal_year"), name)


@query("m14_tax_receipt", with_items("SELECT place, round(v / sum(v) OVER (), 6) AS share, round(v / sum(v) OVER () * 5000, 4) AS paid FROM (SELECT place, CAST(sum(amount) AS DOUBLE) AS v FROM items GROUP BY place)"))
def m14(spark, sf):
    sums = items(spark, sf, "place", "amount").groupBy("place").agg(F.sum("amount").cast("double").alias("amount"))
    return A.tax_receipt(sums, 5000).select("place", F.round("share", 6).alias("share"), F.round("paid", 4).alias("paid"))


@query("m15_get_totals", with_items("""
SELECT dataset, currency, place, records, value, CAST(rank AS BIGINT) AS rank, total_groups, truncated FROM (
  SELECT dataset, currency, place, count(*) AS records, CAST(sum(amount) AS DOUBLE) AS value,
         row_number() OVER (PARTITION BY dataset, currency ORDER BY CAST(sum(amount) AS DOUBLE) DESC NULLS LAST, place) AS rank,
         count(*) OVER (PARTITION BY dataset, currency) AS total_groups, count(*) OVER (PARTITION BY dataset, currency) > 5 AS truncated
  FROM items WHERE year(award_date) = 1995 OR fiscal_year = '1995' GROUP BY dataset, currency, place) WHERE rank <= 5"""))
def m15(spark, sf):
    out = A.get_totals(items(spark, sf, "dataset", "currency", "place", "amount", "award_date", "fiscal_year"), "place", year="1995", k=5, overlap=OVERLAP)
    return out.select("dataset", "currency", "place", "records", "value", F.col("rank").cast("long").alias("rank"), "total_groups", "truncated")


@query("b02_rounded_difference", with_items("SELECT place, CAST(floor((a - b) / 1000 + 0.5) * 1000 AS BIGINT) AS difference FROM (SELECT place, CAST(sum(amount) FILTER (dataset = 'award') AS DOUBLE) AS a, CAST(sum(amount) FILTER (dataset = 'contract') AS DOUBLE) AS b FROM items GROUP BY place)"))
def b02(spark, sf):
    part = lambda d: F.sum(F.when(F.col("dataset") == d, F.col("amount"))).cast("double")
    rows = items(spark, sf, "dataset", "place", "amount").groupBy("place").agg((part("award") - part("contract")).alias("d"))
    return rows.select("place", A.to_thousands(F.col("d")).cast("long").alias("difference"))


@query("b03_department_pivot", with_items("SELECT place, CAST(sum(amount) FILTER (dataset = 'award') AS DOUBLE) AS award, CAST(sum(amount) FILTER (dataset = 'contract') AS DOUBLE) AS contract, CAST(sum(amount) FILTER (dataset = 'notice') AS DOUBLE) AS notice FROM items GROUP BY place"))
def b03(spark, sf):
    wide = items(spark, sf, "dataset", "place", "amount").groupBy("place").pivot("dataset", ["award", "contract", "notice"]).agg(F.sum("amount"))
    return wide.select("place", *(_cad(c) for c in ("award", "contract", "notice")))


@query("b04_receipt_examples", with_items("SELECT place, id FROM (SELECT place, id, row_number() OVER (PARTITION BY place ORDER BY amount DESC NULLS LAST, id) AS r FROM items WHERE currency = 'CAD') WHERE r <= 2"))
def b04(spark, sf):
    order = W.partitionBy("place").orderBy(F.col("amount").desc_nulls_last(), "id")
    return items(spark, sf, "id", "currency", "place", "amount").where("currency = 'CAD'").withColumn("r", F.row_number().over(order)).where("r <= 2").select("place", "id")


@query("n56_citation", with_items("SELECT id, list_last(string_split(id, '-')) AS short, CASE WHEN currency = 'CAD' THEN CAST(amount AS DOUBLE) END AS amount_cad FROM items WHERE dataset = 'award'"))
def n56(spark, sf):
    return A.citation(items(spark, sf, "id", "dataset", "currency", "buyer", "supplier", "amount", "award_date").where("dataset = 'award'")).select("id", "short", F.col("cite.amount_cad").alias("amount_cad"))


_ID = "'{d}-' || substr(sha1(concat_ws('|', {r})), 1, 12)"
_SOURCES = {
    "contract": ("lineitem", "l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT)", "'Body ' || l_orderkey % 50", "'S' || l_suppkey", "NULL", "CAST(l_extendedprice AS DECIMAL(18,2))", "CASE l_linestatus WHEN 'F' THEN 'CAD' ELSE 'USD' END", "CAST(l_shipdate AS DATE)", [("discount", "l_discount * 0"), ("flag", "nullif(l_returnflag, 'N')")]),
    "grant": ("orders", "o_orderkey", "'Fund'", "'C' || o_custkey", "NULL", "CAST(o_totalprice AS DECIMAL(18,2))", "'CAD'", "CAST(o_orderdate AS DATE)", [("priority", "CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE o_orderpriority END")]),
    "pay": ("customer", "c_custkey", "c_mktsegment", "NULL", "c_name", "CAST(c_acctbal AS DECIMAL(18,2))", "'CAD'", "NULL", [("nation", "c_nationkey")]),
    "claim": ("events", "event_id", "'House'", "NULL", "'Member ' || user_id", "CAST(value AS DECIMAL(18,2))", "'CAD'", "CAST(ts AS DATE)", [("kind", "event_type"), ("note", "CASE WHEN user_id % 2 = 0 THEN props ELSE '' END")]),
    "award": ("part", "p_partkey", "p_brand", "'P' || p_size", "NULL", "CAST(p_retailprice AS DECIMAL(18,2))", "'CAD'", "NULL", [("size", "p_size - p_size")]),
}
_CONFORMED = " UNION ALL ".join(
    f"SELECT {_ID.format(d=d, r=r)} AS id, '{d}' AS dataset, {b} AS buyer, {s} AS supplier, {p} AS person, CAST({a} AS DOUBLE) AS amount, {c} AS currency, {day} AS date, "
    f"concat_ws(';', {', '.join(f'CASE WHEN CAST({v} AS VARCHAR) <> {chr(39) * 2} THEN {chr(39)}{k}={chr(39)} || CAST({v} AS VARCHAR) END' for k, v in more)}) AS extra FROM {t}"
    for d, (t, r, b, s, p, a, c, day, more) in _SOURCES.items()
)


@query("n47_conformed_sources", _CONFORMED)
def n47(spark, sf):
    """Five sources on one schema, each a declaration of where its fields come from."""
    day = lambda c: F.to_date(c)
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    lines = table(spark, sf, "lineitem").withColumn("_quantity", F.col("l_quantity").cast("long"))
    parts = [
        conform.conform(lines, "contract", {"buyer": F.concat(F.lit("Body "), (F.col("l_orderkey") % 50).cast("string")), "supplier": text("S", "l_suppkey"), "amount": "l_extendedprice", "currency": F.when(F.col("l_linestatus") == "F", "CAD").otherwise("USD"), "date": day("l_shipdate")},
                        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "_quantity"], {"discount": F.col("l_discount") * 0, "flag": F.nullif("l_returnflag", F.lit("N"))}),
        conform.conform(table(spark, sf, "orders"), "grant", {"buyer": F.lit("Fund"), "supplier": text("C", "o_custkey"), "amount": "o_totalprice", "currency": F.lit("CAD"), "date": day("o_orderdate")}, ["o_orderkey"], {"priority": F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))}),
        conform.conform(table(spark, sf, "customer"), "pay", {"buyer": "c_mktsegment", "person": "c_name", "amount": "c_acctbal", "currency": F.lit("CAD")}, ["c_custkey"], {"nation": "c_nationkey"}),
        conform.conform(table(spark, sf, "events"), "claim", {"buyer": F.lit("House"), "person": text("Member ", "user_id"), "amount": "value", "currency": F.lit("CAD"), "date": day("ts")}, ["event_id"], {"kind": "event_type", "note": F.when(F.col("user_id") % 2 == 0, F.col("props")).otherwise("")}),
        conform.conform(table(spark, sf, "part"), "award", {"buyer": "p_brand", "supplier": text("P", "p_size"), "amount": "p_retailprice", "currency": F.lit("CAD")}, ["p_partkey"], {"size": F.col("p_size") - F.col("p_size")}),
    ]
    said = F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return conform.ledger(*parts).select("id", "dataset", "buyer", "supplier", "person", F.col("amount").cast("double").alias("amount"), "currency", "date", said.alias("extra"))


_NAMED = "n AS (SELECT *, CASE WHEN supplier_key % 4 = 0 AND l_linenumber % 2 = 0 THEN supplier || ' Ltd' ELSE supplier END AS printed, CASE WHEN supplier_key % 4 = 0 AND l_linenumber % 2 = 0 THEN supplier || ' ltd' ELSE CAST(supplier_key AS VARCHAR) END AS name_key, CASE WHEN currency = 'CAD' THEN coalesce(amount, 0) ELSE 0 END AS a FROM items)"
_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"


@query("a08_supplier_pages", with_items(f"""
, {_NAMED},
base AS (SELECT supplier_key, CAST(sum(CASE WHEN dataset <> 'notice' THEN a ELSE 0 END) AS DOUBLE) AS total, CAST(sum(CASE WHEN dataset = 'notice' THEN a ELSE 0 END) AS DOUBLE) AS overlap, count(*) AS n FROM n GROUP BY 1),
shown AS (SELECT supplier_key, arg_min(printed, (-c, printed)) AS name FROM (SELECT supplier_key, printed, count(*) AS c FROM n GROUP BY ALL) GROUP BY 1),
src AS (SELECT supplier_key, string_agg(dataset || ':' || c || ':' || {_MONEY.format('v')}, ',' ORDER BY dataset) AS by_source FROM (SELECT supplier_key, dataset, count(*) AS c, sum(a) AS v FROM n GROUP BY ALL) GROUP BY 1),
yrs AS (SELECT supplier_key, string_agg(y || ':' || {_MONEY.format('v')}, ',' ORDER BY y) AS by_year FROM (SELECT supplier_key, year(award_date) AS y, sum(a) AS v FROM n WHERE dataset <> 'notice' GROUP BY ALL) GROUP BY 1),
buy AS (SELECT supplier_key, count(*) AS buyers, arg_min(buyer, (-v, buyer)) AS first_buyer FROM (SELECT supplier_key, buyer, sum(a) AS v FROM n GROUP BY ALL) GROUP BY 1),
cmb AS (SELECT supplier_key, string_agg(name_key || ':' || c || ':' || {_MONEY.format('v')}, ',' ORDER BY c DESC, name_key) AS combined FROM (SELECT supplier_key, name_key, count(*) AS c, sum(CASE WHEN dataset <> 'notice' THEN a ELSE 0 END) AS v FROM n GROUP BY ALL) GROUP BY 1 HAVING count(*) > 1),
flg AS (SELECT supplier_key, string_agg(method || ':' || c, ',' ORDER BY method) AS flags FROM (SELECT supplier_key, method, count(*) AS c FROM n WHERE method <> 'Open call' GROUP BY ALL) GROUP BY 1),
tops AS (SELECT supplier_key, string_agg(id, ',' ORDER BY r) AS top FROM (SELECT supplier_key, id, row_number() OVER (PARTITION BY supplier_key ORDER BY coalesce(amount, 0) DESC, id) AS r FROM n) WHERE r <= 40 GROUP BY 1)
SELECT * FROM base JOIN shown USING (supplier_key) JOIN src USING (supplier_key) LEFT JOIN yrs USING (supplier_key) JOIN buy USING (supplier_key) LEFT JOIN cmb USING (supplier_key) LEFT JOIN flg USING (supplier_key) JOIN tops USING (supplier_key)
"""))
def a08b(spark, sf):
    """Everything that a supplier's page shows, from one reading of the ledger."""
    rows = _named(spark, sf)
    flags = rows.where("method <> 'Open call'").select(F.col("method").alias("flag"), "id")
    found = pages.supplier_pages(rows, flags, OVERLAP)
    listed = lambda c, *fields: F.array_join(F.transform(c, lambda r: F.concat_ws(":", *(r[f].cast("decimal(18,2)").cast("string") if f == "a" else r[f].cast("string") for f in fields))), ",")
    return found.select(
        "supplier_key", "name", F.col("total").cast("double").alias("total"), F.col("overlap").cast("double").alias("overlap"), "n", listed("by_source", "dataset", "n", "a").alias("by_source"), listed("by_year", "year", "a").alias("by_year"),
        F.size("buyers").cast("long").alias("buyers"), F.col("buyers")[0]["buyer"].alias("first_buyer"), listed("combined", "name_key", "n", "a").alias("combined"), listed("flags", "flag", "n").alias("flags"), listed("top", "id").alias("top"),
    )


def _named(spark, sf):
    rows = items(spark, sf, "id", "dataset", "currency", "buyer", "supplier_key", "supplier", "amount", "award_date", "method", "l_linenumber")
    joined = (F.col("supplier_key") % 4 == 0) & (F.col("l_linenumber") % 2 == 0)
    return rows.select(
        "id", "dataset", "currency", "buyer", "supplier_key", "amount", "method", F.year("award_date").alias("year"),
        F.when(joined, F.concat("supplier", F.lit(" Ltd"))).otherwise(F.col("supplier")).alias("supplier"), F.when(joined, F.concat("supplier", F.lit(" ltd"))).otherwise(F.col("supplier_key").cast("string")).alias("name_key"),
    )


@query("m03_redirects", with_items(f", {_NAMED} SELECT substr(sha1(name_key), 1, 10) AS alias, min(supplier_key) AS supplier_key FROM n WHERE name_key <> CAST(supplier_key AS VARCHAR) GROUP BY name_key HAVING count(DISTINCT supplier_key) = 1"))
def m03b(spark, sf):
    """Where the address of a name that was joined into a supplier leads."""
    return pages.redirects(_named(spark, sf))


@query("m03_close_names", "SELECT s_name AS name, CASE WHEN s_name = 'Supplier#000000000' THEN 0 ELSE 1 END AS how FROM supplier WHERE damerau_levenshtein(lower(s_name), 'supplier#000000000') <= 2 ORDER BY how, s_name LIMIT 5")
def m03c(spark, sf):
    """What a name may mean: the supplier of all its words, then names a slip or two away."""
    known = table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return pages.close_names(known, known.agg(F.min("name")).first()[0])
