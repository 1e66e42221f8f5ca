"""Scalar normalisation over columns of the tables (N-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import closeness, codes, dates, ids, money, names
from .registry import query, table

#: The same printed amounts in both engines: signs, brackets, dashes and blanks.
_PRINTED = "CASE WHEN c_custkey % 9 = 0 THEN '-' WHEN c_custkey % 9 = 1 THEN '' WHEN c_custkey % 9 = 2 THEN '($' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) || ')' WHEN c_custkey % 9 = 3 THEN 'n/a' ELSE '$ 1,' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) END"
_READ = "CASE WHEN c_custkey % 9 IN (0, 1, 3) THEN NULL WHEN c_custkey % 9 = 2 THEN -CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS DOUBLE) ELSE CAST('1' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) AS DOUBLE) END"


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_values = lambda rows: ", ".join(f"({', '.join(_quoted(x) for x in r)})" for r in rows)


def _printed():
    return F.expr(_PRINTED.replace("VARCHAR", "STRING"))


@query("n01_tidy_space", "SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def n01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("n"))


_NAME_CASES = (
    ("Bishop’s Falls Motors Ltd.", "bishops falls motors"), ("Smith & Co", "smith"), ("Harbour Co-operative Limited", "harbour cooperative"), ("Dairy Farmers Board (DFB)", "dairy farmers board"),
    ("Minister of Finance (PEI)", "minister of finance pei"), ("12345 NL Inc", "12345 newfoundland and labrador"), ("Société Générale Ltée", "societe generale"), ("Oak Limited Partnership", "oak lp"),
    ("Oak L.P.", "oak lp"), ("Acme (formerly Old Acme)", "acme"), ("Long Harbour Development Company Limi", "long harbour development"), ("The A & B Shop", "a and b shop"),
)


@query("n02_entity_key", f"SELECT -1 AS s_suppkey, * FROM (VALUES {_values(_NAME_CASES)}) t(printed, name_key) UNION ALL SELECT s_suppkey, s_name || ' Ltd. o/a Somewhere Inc', replace(lower(s_name), '#', ' ') FROM supplier")
def n02(spark, sf):
    spelt = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.concat("s_name", F.lit(" Ltd. o/a Somewhere Inc")).alias("printed"))
    cases = spark.createDataFrame([(-1, x) for x, _ in _NAME_CASES], "s_suppkey long, printed string")
    return names.with_keys(cases.union(spelt), "printed")


@query("n04_name_forms", "SELECT s_suppkey, s_name AS form FROM supplier UNION ALL SELECT s_suppkey, 'Société ' || s_name FROM supplier")
def n04(spark, sf):
    spelt = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit("|Société "), "s_name").alias("printed"))
    return spelt.select("s_suppkey", F.explode(names.name_forms_udf("printed", F.lit(True))).alias("form"))


@query("n06_hash_ids", "SELECT p_partkey, substr(sha1(p_name), 1, 10) AS h10, CAST('0x' || substr(sha1(p_name), 1, 15) AS BIGINT) AS h60, CAST(CAST('0x' || substr(sha1(p_name), 1, 4) AS BIGINT) % 512 AS BIGINT) AS shard FROM part")
def n06(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", ids.text_hash(n).alias("h10"), ids.row_number_id(n).alias("h60"), ids.shard(n).alias("shard"))


@query("n07_money", f"SELECT c_custkey, {_READ} AS amount FROM customer")
def n07(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", money.money(_printed()).alias("amount"))


@query("n08_cell", "SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'None' WHEN event_id % 4 = 1 THEN '' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS v FROM events")
def n08(spark, sf):
    text = F.when(F.col("event_id") % 4 == 0, "None").when(F.col("event_id") % 4 == 1, "").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", money.cell(text).alias("v"))


_FY = "year({d} - INTERVAL 3 MONTH) || '-' || lpad(CAST((year({d} - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0')"


@query("n09_fiscal_year", f"SELECT o_orderkey, {_FY.format(d='CAST(o_orderdate AS DATE)')} AS fy, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {_FY.format(d='CAST(o_orderdate AS DATE)')} END AS of_text FROM orders")
def n09(spark, sf):
    day = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy")).otherwise(F.date_format(day, "yyyy-MM"))
    return table(spark, sf, "orders").select("o_orderkey", dates.fiscal_year(day).alias("fy"), dates.fiscal_year_of_text(text).alias("of_text"))


@query("n10_item_id", "SELECT o_orderkey, 'x-' || substr(sha1(o_orderkey || '|' || CASE WHEN o_custkey % 2 = 0 THEN 'None' ELSE CAST(o_custkey AS VARCHAR) END), 1, 12) AS id FROM orders")
def n10(spark, sf):
    maybe = F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", ids.item_id(F.lit("x"), F.col("o_orderkey"), maybe).alias("id"))


@query("n11_duplicate_ids", "SELECT p_partkey, p_name || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def n11(spark, sf):
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    rows = table(spark, sf, "part").select("p_partkey", "p_name", r.alias("r"))
    return rows.select("p_partkey", F.concat("p_name", F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("name"))


_BODY_CASES = {
    "NL Hydro": "Newfoundland and Labrador Hydro", "Public Procurement Agnecy": "Public Procurement Agency", "Newfoundland & Labrador Health Services": "NL Health Services",
    "Eastern  Regional Health Authority": "Eastern Health (regional health authority)", "OCIO": "Office of the Chief Information Officer", "City of St. John's": "City of St. John's",
    "Department of Education": "Department of Education", "Education & Early Childhood": "Department of Education and Early Childhood Development", "NLESD": "Newfoundland and Labrador English School District",
    "LIL LP": "Labrador Island Link LP", " Town of  Placentia ": "Town of Placentia", "": "Public body not named",
}
@query("n13_ordered_rules", f"SELECT * FROM (VALUES {_values(_BODY_CASES.items())}) t(printed, body) UNION ALL SELECT n_name || ' Hydro' AS printed, 'Newfoundland and Labrador Hydro' AS body FROM nation")
def n13(spark, sf):
    printed = spark.createDataFrame([(x,) for x in _BODY_CASES], "printed string").union(table(spark, sf, "nation").select(F.concat("n_name", F.lit(" Hydro"))))
    return printed.withColumn("body", codes.canonical_body(F.col("printed")))


_TYPE_CASES = {"Town of Gander": "local", "NL Health Services": "local", "Newfoundland and Labrador Hydro": "crown", "NL Liquor Corporation": "crown", "Department of Finance": "department", "Memorial University": "local", "": "department"}


@query("n31_body_type", f"SELECT * FROM (VALUES {_values(_TYPE_CASES.items())}) t(body, body_type) UNION ALL SELECT 'City of ' || n_name AS body, 'local' AS body_type FROM nation")
def n31(spark, sf):
    rows = spark.createDataFrame([(x,) for x in _TYPE_CASES], "body string").union(table(spark, sf, "nation").select(F.concat(F.lit("City of "), "n_name")))
    return rows.withColumn("body_type", codes.body_type(F.col("body")))


_BUYER_CASES = (("Department of Fisheries & Land", "Department of Fisheries and Land", "fisheries and land"), ("The Office of the Auditor", "The Office of the Auditor", "auditor"), ("Dept. of Works  Ltd.", "Dept. of Works Ltd.", "works"), ("Town of Gander", "Town of Gander", "town of gander"))


@query("n12_buyers", f"SELECT * FROM (VALUES {_values(_BUYER_CASES)}) t(printed, name, key) UNION ALL SELECT 'Department of ' || n_name AS printed, 'Department of ' || n_name AS name, replace(lower(n_name), '_', ' ') AS key FROM nation")
def n12(spark, sf):
    rows = spark.createDataFrame([(x,) for x, *_ in _BUYER_CASES], "printed string").union(table(spark, sf, "nation").select(F.concat(F.lit("Department of "), "n_name")))
    return rows.select("printed", names.buyer_name_udf("printed").alias("name"), names.buyer_key_udf("printed").alias("key"))


#: Towns as customers' records might print them.
_CITY = "CASE c_custkey % 7 WHEN 0 THEN c_mktsegment || ', NL' WHEN 1 THEN initcap(c_mktsegment) || ', Newfoundland and Labrador' WHEN 2 THEN 'St. ' || c_mktsegment WHEN 3 THEN 'NL' WHEN 4 THEN 'N/A' WHEN 5 THEN 'Labrador' ELSE c_mktsegment || ' Labrador' END"
_CITY_KEY = "trim(regexp_replace(regexp_replace(lower(city), '[^a-z0-9]+', ' ', 'g'), '(^| )(newfoundland and labrador|newfoundland|labrador|nl)$', ''))"


@query("n25_locality", f"SELECT c_custkey, city, CASE WHEN {_CITY_KEY} NOT IN ('', 'n a') THEN {_CITY_KEY} END AS locality FROM (SELECT c_custkey, {_CITY.replace('initcap(c_mktsegment)', 'upper(c_mktsegment[1]) || lower(c_mktsegment[2:])')} AS city FROM customer)")
def n25(spark, sf):
    cities = table(spark, sf, "customer").select("c_custkey", F.expr(_CITY).alias("city"))
    keyed = names.with_keys(cities, "city")
    return keyed.select("c_custkey", "city", closeness.town(F.col("name_key")).alias("locality"))


@query("n48_english_letters", "SELECT doc_id, length(regexp_replace(lower(split_part(text, '|', 1)), '[^a-z0-9]', '', 'g')) AS n FROM documents")
def n48(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(codes.english_letters(F.col("text"))).cast("long").alias("n"))


@query("n57_name_order", "SELECT c_custkey, 'Member ' || c_custkey || ' Dinn' AS shown, 'Jo ' || c_name AS minister FROM customer")
def n57(spark, sf):
    key = F.col("c_custkey").cast("string")
    printed = F.concat(F.lit("Dinn, Member "), key)
    titled = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Honourable Jo ").otherwise("Dr. Jo "), "c_name")
    last_first = codes.name_order(printed)
    return table(spark, sf, "customer").select("c_custkey", last_first.alias("shown"), codes.without_title(titled).alias("minister"))


_AMOUNTS = (
    ("$1,200.50", 1200.5, "CAD", None),
    ("USD 300", 300.0, "CAD", None),
    ("300 USD", None, "USD", 300.0),
    ("$81.911.25", 81911.25, "CAD", None),
    ("50 per hour", None, "text", None),
    ("$100 USD ($135 CAD)", 135.0, "CAD", None),
    ("($20.00)", 20.0, "CAD", None),
    ("Approx $500", 500.0, "CAD", None),
    ("$500 CAD each", 500.0, "CAD", None),
    ("$1.20 / KM", None, "text", None),
    ("$336,000 to $600,000", None, "text", None),
    ("", None, "", None),
)
_or_null = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


@query("n14_parse_amount", "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_or_null, r))})" for r in _AMOUNTS) + ") t(printed, cad, currency, original) UNION ALL SELECT DISTINCT '$' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.50 CAD' AS printed, l_quantity + 0.5 AS cad, 'CAD' AS currency, NULL AS original FROM lineitem")
def n14(spark, sf):
    planted = table(spark, sf, "lineitem").select(F.concat(F.lit("$"), F.col("l_quantity").cast("long").cast("string"), F.lit(".50 CAD"))).distinct()
    rows = spark.createDataFrame([(r[0],) for r in _AMOUNTS], "printed string").union(planted)
    return rows.select("printed", money.parse_amount(F.col("printed")).alias("a")).select("printed", "a.*")


@query("n15_read_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT * FROM (VALUES (-1, DATE '2024-01-05'), (-2, DATE '2024-01-05'), (-3, DATE '2024-02-13'), (-4, NULL), (-5, DATE '2024-09-03'), (-6, DATE '2024-01-05'), (-7, NULL)) t(k, d)")
def n15(spark, sf):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.upper(F.date_format(d, "dd-MMM-yyyy"))).when(k == 2, F.date_format(d, "M/d/yyyy"))
        .when(k == 3, F.date_format(d, "MMMM d, yyyy")).when(k == 4, F.date_format(d, "d-MMMM-yyyy")).otherwise(F.date_format(d, "d-MMM-yyyy"))
    )
    odd = spark.createDataFrame([(-1, "January 5, 2024"), (-2, "1/5/24"), (-3, "13/2/2024 (revised)"), (-4, "2024-02-30"), (-5, "3-SEPT-24"), (-6, "Jan. 5 2024"), (-7, "soon")], "o_orderkey long, text string")
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text")).union(odd).select("o_orderkey", dates.read_date(F.col("text")).alias("day"))


@query("n20_code_names", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def n20(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codes.code_name(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@query("n21_currency_code", "SELECT p_partkey, CASE WHEN regexp_full_match(trim(x), '[A-Z]{3}') THEN trim(x) ELSE 'unstated' END AS code FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' CAD ' WHEN p_partkey % 3 = 1 THEN 'cad' ELSE upper(substr(p_name, 1, 3)) END AS x FROM part)")
def n21(spark, sf):
    k = F.col("p_partkey") % 3
    x = F.when(k == 0, " CAD ").when(k == 1, "cad").otherwise(F.upper(F.substring("p_name", 1, 3)))
    return table(spark, sf, "part").select("p_partkey", money.currency_code(x).alias("code"))


@query("n26_place_of", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Works, Ltd. ' || c_custkey END AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'Town ' || c_nationkey || ', Newfoundland and Labrador' END AS place FROM customer")
def n26(spark, sf):
    """Only the last two commas count, and other provinces give nothing."""
    province = F.when(F.col("c_nationkey") % 2 == 0, "Newfoundland and Labrador").otherwise("Ontario")
    address = F.concat(F.lit("Works, Ltd. "), F.col("c_custkey").cast("string"), F.lit(", Town "), F.col("c_nationkey").cast("string"), F.lit(", "), province)
    return table(spark, sf, "customer").select("c_custkey", codes.place_of(address).alias("p")).select("c_custkey", "p.*")


@query("n27_reasons", "SELECT c_custkey, nullif(concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'in debt' END, CASE WHEN c_nationkey < 5 THEN 'early' END), '') AS reasons FROM customer")
def n27(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", codes.reasons((F.col("c_acctbal") < 0, "in debt"), (F.col("c_nationkey") < 5, "early")).alias("reasons"))


@query("n30_description_key", "SELECT doc_id, length(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))) AS n FROM documents")
def n30(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(codes.description_key(F.col("text"))).cast("long").alias("n"))


@query("n37_clip", "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 80), '\\s+\\S*$', '') || '…' END AS clipped FROM documents")
def n37(spark, sf):
    return table(spark, sf, "documents").select("doc_id", codes.clip(F.col("text"), 80).alias("clipped"))


@query("n39_slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(replace(lower(p_name || ' & Søns Équipe'), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug FROM (SELECT p_partkey, p_name FROM part)".replace("Søns Équipe", "Co"))
def n39(spark, sf):
    return table(spark, sf, "part").select("p_partkey", codes.slug(F.concat("p_name", F.lit(" & Co"))).alias("slug"))


_TAX = "greatest(greatest(least(b, 50000) - 0, 0) * 0.1 + greatest(least(b, 1e18) - 50000, 0) * 0.2 - 10000 * 0.1 - greatest(500 - greatest(b - 20000, 0) * 0.05, 0), 0)"


@query("n42_income_tax", f"SELECT c_custkey, round({_TAX}, 4) AS tax FROM (SELECT c_custkey, abs(c_acctbal) * 10 AS b FROM customer)")
def n42(spark, sf):
    tax = money.income_tax(F.abs("c_acctbal") * 10, [(0, 0.1), (50000, 0.2)], 10000, (500, 20000, 0.05))
    return table(spark, sf, "customer").select("c_custkey", F.round(tax, 4).alias("tax"))


#: Fixed values of one tax year, as in the SQL below.
_PENSION = {"exempt": 3500, "first": 68500, "second": 73200, "base": 0.0495, "enhanced": 0.01, "upper": 0.04}
_INSURANCE = {"most": 63200, "rate": 0.0166}
_CENTS = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_PAYROLL = f"""
WITH p AS (SELECT c_custkey, abs(c_acctbal) * 12 AS b FROM customer),
q AS (SELECT *, least(greatest(b - 3500, 0), 65000) AS lower, least(greatest(b - 68500, 0), 4700) AS upper FROM p),
r AS (SELECT *, {_CENTS("lower * 0.0495::DOUBLE")} AS base, {_CENTS("lower * 0.01::DOUBLE")} + {_CENTS("upper * 0.04::DOUBLE")} AS deduction, {_CENTS("least(b, 63200) * 0.0166::DOUBLE")} AS premium FROM q),
s AS (SELECT *, greatest(b - deduction, 0) AS net FROM r)
SELECT c_custkey, base, deduction, premium, floor(greatest(
    least(net, 43198) * 0.087::DOUBLE + greatest(net - 43198, 0) * 0.145::DOUBLE - (base + premium + 10818) * 0.087::DOUBLE
    - greatest(1000 - greatest(net - 23000, 0) * 0.16::DOUBLE, 0), 0) * 100 + 0.5) / 100 AS tax
FROM s
"""


@query("n42_payroll_and_tax", _PAYROLL)
def n42b(spark, sf):
    income = F.abs("c_acctbal") * 12
    tax = money.employee_tax(income, [(0, 0.087), (43198, 0.145)], 10818, (1000, 23000, 0.16), _PENSION, _INSURANCE)
    rows = table(spark, sf, "customer").select("c_custkey", money.payroll(income, _PENSION, _INSURANCE).alias("p"), (F.floor(tax * 100 + 0.5) / 100).alias("tax"))
    return rows.select("c_custkey", "p.*", "tax")


@query("n49_document_number", f"SELECT c_custkey, CASE WHEN c_custkey % 9 IN (0, 1) THEN 0 ELSE {_READ} END AS amount FROM customer")
def n49(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", money.document_number(_printed()).alias("amount"))


@query("n50_digit_runs", "SELECT p_partkey, len(regexp_extract_all(p_brand, '\\d+')) AS runs, regexp_replace(p_name, '\\bof\\b|\\s', '', 'g') AS compact FROM part")
def n50(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(codes.digit_runs(F.col("p_brand"))).cast("long").alias("runs"), codes.compact(F.col("p_name")).alias("compact"))


@query("n51_years", "SELECT o_custkey, min(year(o_orderdate)) AS first, max(year(o_orderdate)) + 1 AS last FROM orders GROUP BY o_custkey")
def n51(spark, sf):
    day = F.to_date("o_orderdate")
    by = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(day).alias("d"), F.collect_set(F.concat(F.year(day).cast("string"), F.lit("-00"))).alias("f"))
    out = by.select("o_custkey", dates.year_span(F.col("d"), F.col("f")).alias("y")).select("o_custkey", "y.*")
    return out.select("o_custkey", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))



