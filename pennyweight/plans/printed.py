"""Rules for printed cells, on texts planted in columns of the tables (N-series and some others).

Each query prints texts from the rows of a table, in several spellings by
the row's number, and reads them back.  ``text`` is SQL that both engines
take; the twin states the rule itself or, where the text was made from a
known value, that value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, dates, evidence, money, names, tables
from ..operators import searching, splitting
from .ledger import items, with_items
from .registry import query, table


def _printed(spark, sf: str, from_: str, key: str, **texts: str) -> DataFrame:
    return table(spark, sf, from_).select(key, *(F.expr(t.replace("VARCHAR", "STRING")).alias(c) for c, t in texts.items()))


def _sql(from_: str, key: str, select: str, **texts: str) -> str:
    return f"SELECT {key}, {select} FROM (SELECT {key}, {', '.join(f'{t} AS {c}' for c, t in texts.items())} FROM {from_})"


_NAME = "CASE c_custkey % 4 WHEN 0 THEN 'Association pour les ' || c_name WHEN 1 THEN 'Association for ' || c_name WHEN 2 THEN 'Ville de ' || c_mktsegment || ' Ltd.' ELSE c_name || ' and Sons' END"
_FRENCH = ", ".join(f"'{w}'" for w in names.FRENCH)


@query("n05_french", _sql("customer", "c_custkey", f"name, list_has_any(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), [{_FRENCH}]) AS french", name=_NAME))
def n05(spark, sf):
    keyed = names.with_keys(_printed(spark, sf, "customer", "c_custkey", name=_NAME), "name")
    return keyed.select("c_custkey", "name", F.arrays_overlap(F.split("name_key", " "), F.array(*map(F.lit, names.FRENCH))).alias("french"))


@query("n16_report_period", "SELECT o_orderkey, CASE WHEN k < 3 THEN d END AS start, CASE WHEN k < 3 THEN d + 14 END AS \"end\" FROM (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(date_trunc('month', o_orderdate + INTERVAL 240 MONTH) AS DATE) + CASE WHEN day(CAST(o_orderdate AS DATE)) > 15 THEN 15 ELSE 0 END AS d FROM orders)")
def n16(spark, sf):
    """Headers of half-month reports, with numbers or months in words; one order in four prints none."""
    k = F.col("o_orderkey") % 4
    later = F.add_months(F.to_date("o_orderdate"), 240)
    day = F.date_add(F.trunc(later, "month"), F.when(F.dayofmonth(later) > 15, 15).otherwise(0))
    between = lambda how, sep: F.concat(F.date_format(day, how), F.lit(sep), F.date_format(F.date_add(day, 14), how))
    header = F.when(k == 0, F.concat(F.lit("PERIOD: "), between("MM/dd/yyyy", " - "))).when(k == 1, F.concat(F.lit("PERIOD: "), between("MMMM d, yyyy", " - "))).when(k == 2, F.concat(F.lit("BIDS - "), between("MMMM, d'th', yyyy", " to "))).otherwise("no header")
    rows = table(spark, sf, "orders").select("o_orderkey", evidence.report_period(header, F.lit("none.pdf")).alias("p"))
    return rows.select("o_orderkey", "p.*")


@query("n17_half_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN make_date(y, 12, 1) ELSE make_date(y, 6, 1) END AS start, CASE WHEN o_orderkey % 2 = 0 THEN make_date(y + 1, 5, 31) ELSE make_date(y, 11, 30) END AS \"end\" FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def n17(spark, sf):
    y = F.year("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("December 1, %d to May 31, %d", y, y + 1)).otherwise(F.format_string("June %d - November %d", y, y))
    return table(spark, sf, "orders").select("o_orderkey", dates.half_year(text).alias("p")).select("o_orderkey", "p.*")


_LINE = "CASE o_orderkey % 5 WHEN 0 THEN 'Contract Awards, clerk ' || o_clerk WHEN 1 THEN 'Awards without an open call ' || o_custkey WHEN 2 THEN 'Emergency exceptions' WHEN 3 THEN 'contract award exceptions' ELSE 'Acme ' || o_orderpriority END".replace("o_clerk", "o_custkey")


@query("n19_sections", _sql("orders", "o_orderkey", "line, CASE WHEN line ILIKE '%emergency%' THEN 'Emergency' WHEN line ILIKE '%without an open call%' OR line ILIKE '%exception%' THEN 'Exception' WHEN line ILIKE '%contract award%' THEN 'Award' END AS section", line=_LINE))
def n19(spark, sf):
    return _printed(spark, sf, "orders", "o_orderkey", line=_LINE).withColumn("section", evidence.section_heading(F.col("line")))


_ROOT = "CASE WHEN c_custkey % 50 = 0 THEN '777777777' WHEN c_custkey % 50 = 1 THEN '1000' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(100100000 + c_custkey * 7919 % 800000000 AS VARCHAR) END"
_NUMBER = f"CASE c_custkey % 6 WHEN 0 THEN {_ROOT} WHEN 1 THEN substr({_ROOT}, 1, 5) || ' ' || substr({_ROOT}, 6) WHEN 2 THEN {_ROOT} || 'RR0001' WHEN 3 THEN {_ROOT} || ' rr 0002' WHEN 4 THEN {_ROOT} || 'XX0001' ELSE {_ROOT} || '1' END"


@query("n22_business_number", f"""
SELECT c_custkey, CASE WHEN regexp_full_match(x, '\\d{{9}}([A-Z]{{2}}\\d{{4}})?') AND substr(x, 10, 2) <> 'XX' AND len(list_distinct(string_split(substr(x, 1, 9), ''))) > 1 AND NOT starts_with(x, '1000')
  AND list_sum(list_transform(range(9), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(x, i + 1, 1) AS INT) WHEN CAST(substr(x, i + 1, 1) AS INT) > 4 THEN CAST(substr(x, i + 1, 1) AS INT) * 2 - 9 ELSE CAST(substr(x, i + 1, 1) AS INT) * 2 END)) % 10 = 0 THEN x END AS number
FROM (SELECT c_custkey, regexp_replace(upper({_NUMBER}), '[^0-9A-Z]', '', 'g') AS x FROM customer)""")
def n22(spark, sf):
    return _printed(spark, sf, "customer", "c_custkey", printed=_NUMBER).select("c_custkey", codes.business_number(F.col("printed")).alias("number"))


_LETTER = "chr(CAST(65 + c_custkey * {} % 26 AS INT))"
_CODE = f"CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE {_LETTER.format(1)} END || CAST(c_custkey % 10 AS VARCHAR) || {_LETTER.format(7)} || CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '' WHEN 2 THEN '-' ELSE ' 1' END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '2' || {_LETTER.format(11)} || '3' END"
_WHOLE = "regexp_replace(upper(printed), '[^A-Z0-9]', '', 'g')"


@query("n23_postal", _sql("customer", "c_custkey", f"printed, CASE WHEN regexp_full_match({_WHOLE}, '[A-Z]\\d[A-Z]\\d[A-Z]\\d') THEN {_WHOLE} END AS postal", printed=_CODE))
def n23(spark, sf):
    return _printed(spark, sf, "customer", "c_custkey", printed=_CODE).withColumn("postal", codes.postal(F.col("printed")))


@query("n24_postal_region", _sql("customer", "c_custkey", f"printed, regexp_full_match(upper(trim(printed)), '{tables.POSTAL_CODE}') AND starts_with(upper(trim(printed)), 'A') AS here", printed=_CODE))
def n24(spark, sf):
    return _printed(spark, sf, "customer", "c_custkey", printed=_CODE).withColumn("here", codes.in_region(F.col("printed")))


_ADDRESS = {
    "country": "CASE c_custkey % 5 WHEN 0 THEN 'Canada' WHEN 1 THEN ' ca' WHEN 2 THEN '' WHEN 3 THEN 'CAN' ELSE c_mktsegment END",
    "province": "CASE c_nationkey % 5 WHEN 0 THEN 'NL' WHEN 1 THEN '' WHEN 2 THEN 'Newfoundland & Labr.' WHEN 3 THEN 'labrador' ELSE 'ON' END",
    "code": "CASE c_custkey % 4 WHEN 0 THEN 'A1B 2C3' WHEN 1 THEN '' WHEN 2 THEN 'K1A0B1' ELSE CAST(c_custkey AS VARCHAR) END",
    "city": "CASE c_custkey % 3 WHEN 0 THEN 'Gander' WHEN 1 THEN 'Halifax|Halifax' ELSE c_mktsegment END",
}
_LISTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


@query("n28_location_conflict", _sql("customer", "c_custkey", f"""
  lower(trim(country)) IN ({_LISTED(tables.COUNTRY)}) AND (lower(trim(province)) IN ({_LISTED(tables.PROVINCES)}) OR code LIKE 'A1B%') AS selected,
  nullif(concat_ws('; ', CASE WHEN lower(trim(country)) NOT IN ({_LISTED(tables.COUNTRY)}) THEN 'reported country is ' || country END,
    CASE WHEN code = 'K1A0B1' THEN 'reported postal code K1A0B1 is outside NL' WHEN code NOT IN ('', 'A1B 2C3') THEN 'reported postal code ' || code || ' is not a valid Canadian postal code' END,
    CASE WHEN lower(split_part(city, '|', 1)) IN ({_LISTED(tables.OUTSIDE_CITIES)}) THEN 'reported city is ' || city END,
    CASE WHEN province <> '' AND lower(trim(province)) NOT IN ({_LISTED(tables.PROVINCES)}) THEN 'reported province is ' || province END), '') AS conflict""", **_ADDRESS))
def n28(spark, sf):
    rows = _printed(spark, sf, "customer", "c_custkey", **_ADDRESS)
    parts = F.col("country"), F.col("province"), F.col("code")
    return rows.select("c_custkey", evidence.selected(*parts).alias("selected"), evidence.location_conflict(*parts, F.col("city")).alias("conflict"))


_REGIONS = "CASE o_custkey % 5 WHEN 0 THEN 'Newfoundland and Labrador' WHEN 1 THEN chr(10) || '*Terre-Neuve-et-Labrador' || chr(10) WHEN 2 THEN 'Newfoundland and Labrador' || chr(10) || 'Nova Scotia' WHEN 3 THEN o_orderpriority END"


@query("n28_delivery_scope", "SELECT o_orderkey, CASE WHEN o_custkey % 5 < 2 THEN 'local' WHEN o_custkey % 5 = 2 THEN 'broader' ELSE 'unknown' END AS scope FROM orders")
def n28b(spark, sf):
    return _printed(spark, sf, "orders", "o_orderkey", regions=_REGIONS).select("o_orderkey", evidence.delivery_scope(F.col("regions")).alias("scope"))


_PERSON = "CASE c_custkey % 6 WHEN 0 THEN 'Jane ' || c_mktsegment WHEN 1 THEN c_mktsegment || ', Jane' WHEN 2 THEN c_mktsegment || ' Ltd' WHEN 3 THEN 'Jane ' || c_mktsegment || ' & Sons Group' WHEN 4 THEN 'Jane' ELSE 'Jane van ' || c_mktsegment END"


@query("n32_person_names", _sql("customer", "c_custkey", "name, c_custkey % 6 IN (0, 1, 5) AS person", name=_PERSON))
def n32(spark, sf):
    return _printed(spark, sf, "customer", "c_custkey", name=_PERSON).withColumn("person", codes.looks_like_person(F.col("name")))


#: Amounts of all sizes: prices times powers of ten, some negative, some missing.
_SIZED = "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE o_orderkey % 5 WHEN 0 THEN 0.01 WHEN 1 THEN 1 WHEN 2 THEN 100 WHEN 3 THEN 10000 ELSE 100000 END END"
_PLAIN = "CASE WHEN x < 0 THEN '($' || format('{:,}', CAST(floor(abs(x) + 0.5) AS BIGINT)) || ')' ELSE '$' || format('{:,}', CAST(floor(x + 0.5) AS BIGINT)) END"
#: Decimals with halves away from zero.
_FIXED = lambda v, d: f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || printf('%.{d}f', floor(abs({v}) * {10**d} + 0.5) / {10**d})"
_NO_ZERO = lambda t: f"regexp_replace({t}, '\\.0$', '')"


@query("n40_money_text", f"""
SELECT o_orderkey, CASE WHEN x IS NULL THEN 'n/a' WHEN x < 0 THEN '($' || format('{{:,.2f}}', -x) || ')' ELSE '$' || format('{{:,.2f}}', x) END AS shown,
  CASE WHEN x IS NULL THEN 'n/a' WHEN abs(x) >= 1e9 THEN '$' || {_FIXED('(x / 1e9)', 1)} || ' billion' WHEN abs(x) >= 1e8 THEN '$' || {_FIXED('(x / 1e6)', 0)} || ' million'
       WHEN abs(x) >= 1e6 THEN '$' || {_NO_ZERO(_FIXED("(x / 1e6)", 1))} || ' million' ELSE {_PLAIN} END AS words
FROM (SELECT o_orderkey, {_SIZED} AS x FROM orders)""")
def n40(spark, sf):
    rows = _printed(spark, sf, "orders", "o_orderkey", x=_SIZED)
    return rows.select("o_orderkey", money.money_text(F.col("x"), cents=True).alias("shown"), money.money_words(F.col("x")).alias("words"))


@query("n40_short_amounts", f"""
SELECT o_orderkey, CASE WHEN x >= 1e9 THEN '$' || {_NO_ZERO(_FIXED("(x / 1e9)", 1))} || 'B' WHEN x >= 1e8 THEN '$' || {_FIXED('(x / 1e6)', 0)} || 'M' WHEN x >= 1e6 THEN '$' || {_NO_ZERO(_FIXED("(x / 1e6)", 1))} || 'M'
  WHEN x >= 1e5 THEN '$' || {_FIXED('(x / 1e3)', 0)} || 'K' WHEN x >= 1e3 THEN '$' || {_NO_ZERO(_FIXED("(x / 1e3)", 1))} || 'K' ELSE {_PLAIN} END AS short, format('{{:,}}', CAST(floor(x + 0.5) AS BIGINT)) AS num
FROM (SELECT o_orderkey, abs({_SIZED}) AS x FROM orders) WHERE x IS NOT NULL""")
def n40b(spark, sf):
    rows = _printed(spark, sf, "orders", "o_orderkey", x=f"abs({_SIZED})").where("x IS NOT NULL")
    return rows.select("o_orderkey", money.money_short(F.col("x")).alias("short"), money.whole_number(F.col("x")).alias("num"))


_WAGES = "abs(o_totalprice) * CASE o_orderkey % 5 WHEN 0 THEN 0.0001 WHEN 1 THEN 0.002 WHEN 2 THEN 0.02 WHEN 3 THEN 1 ELSE 100 END"


@query("n41_work_time", f"""
SELECT o_orderkey, CASE WHEN y >= 100 THEN format('{{:,}}', CAST(floor(y + 0.5) AS BIGINT)) || ' years' WHEN y >= 2 THEN {_NO_ZERO("printf('%.1f', y)")} || ' years' WHEN y * 52 >= 8 THEN CAST(floor(y * 52 + 0.5) AS BIGINT) || ' weeks'
  WHEN y * 260 >= 2 THEN CAST(floor(y * 260 + 0.5) AS BIGINT) || ' working days' WHEN y * 1950 >= 1 THEN CAST(floor(y * 1950 + 0.5) AS BIGINT) || ' working hour' || CASE WHEN floor(y * 1950 + 0.5) = 1 THEN '' ELSE 's' END
  ELSE greatest(CAST(floor(y * 1950 * 60 + 0.5) AS BIGINT), 1) || ' working minutes' END AS time
FROM (SELECT o_orderkey, {_WAGES} / 52000.0::DOUBLE AS y FROM orders)""")
def n41(spark, sf):
    return _printed(spark, sf, "orders", "o_orderkey", x=_WAGES).select("o_orderkey", money.work_time(F.col("x"), 52_000).alias("time"))


@query("n43_native_amounts", with_items("SELECT id, CASE WHEN amount IS NULL THEN 'Amount not stated (' || CASE WHEN c = 'unstated' THEN 'currency not stated' ELSE c END || ')' WHEN c = 'unstated' THEN format('{:,.2f}', CAST(amount AS DOUBLE)) || ' (currency not stated)' ELSE c || ' ' || format('{:,.2f}', CAST(amount AS DOUBLE)) END AS shown FROM (SELECT id, amount, CASE WHEN l_linenumber % 3 = 1 THEN 'unstated' ELSE currency END AS c FROM items)"))
def n43(spark, sf):
    rows = items(spark, sf, "id", "amount", "currency", "l_linenumber")
    currency = F.when(F.col("l_linenumber") % 3 == 1, "unstated").otherwise(F.col("currency"))
    return rows.select("id", evidence.native_amount(F.col("amount"), currency).alias("shown"))


_ISO = "substr(CAST(o_orderdate AS VARCHAR), 1, {})"
_DAY = f"CASE o_orderkey % 5 WHEN 0 THEN {_ISO.format(10)} WHEN 1 THEN {_ISO.format(7)} WHEN 2 THEN {_ISO.format(4)} WHEN 3 THEN '' ELSE {_ISO.format(10)} END"
_MONTHS = ", ".join(f"'{m}'" for m in dates.MONTHS)


@query("n44_date_text", f"""
SELECT o_orderkey, CASE WHEN len(p) = 1 THEN p[1] ELSE [{_MONTHS}][CAST(p[2] AS INT)] || ' ' || CASE WHEN len(p) > 2 THEN CAST(p[3] AS INT) || ', ' ELSE '' END || p[1] END AS shown
FROM (SELECT o_orderkey, string_split({_DAY}, '-') AS p FROM orders)""")
def n44(spark, sf):
    return _printed(spark, sf, "orders", "o_orderkey", text=_DAY).select("o_orderkey", dates.shown(F.col("text")).alias("shown"))


_TERMS = {"a": "CASE o_orderkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'not stated' WHEN 2 THEN o_custkey % 3 || ' years' ELSE '' END", "b": "CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n a' WHEN 2 THEN '2  YEARS' ELSE '1 years.' END"}
_MISSING = lambda c: f"CASE WHEN {c} IN ('N/A', 'not stated', '', 'n a') THEN '' ELSE trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) END"


@query("n46_same_detail", _sql("orders", "o_orderkey", f"{_MISSING('a')} = {_MISSING('b')} AS same", **_TERMS))
def n46(spark, sf):
    return _printed(spark, sf, "orders", "o_orderkey", **_TERMS).select("o_orderkey", codes.same_detail(F.col("a"), F.col("b")).alias("same"))


@query("n60_four_year_rules", with_items("SELECT id, CASE WHEN d <> '' THEN substr(d, 1, 4) WHEN regexp_full_match(right(fy, 4), '\\d{4}') THEN right(fy, 4) ELSE '' END AS tag, coalesce(nullif(substr(d, 1, 4), ''), nullif(fy, ''), 'not stated') AS totals, coalesce(nullif(substr(d, 1, 4), ''), nullif(regexp_extract(fy, '\\d{4}'), '')) AS supplier FROM (SELECT id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(award_date AS VARCHAR) ELSE '' END AS d, CASE l_linenumber % 3 WHEN 0 THEN fiscal_year WHEN 1 THEN 'calendar ' || substr(fiscal_year, 1, 4) ELSE '' END AS fy FROM items)"))
def n60(spark, sf):
    rows = items(spark, sf, "id", "award_date", "fiscal_year", "l_linenumber")
    k = F.col("l_linenumber")
    d = F.when(k % 2 == 0, F.col("award_date").cast("string")).otherwise("")
    fy = F.when(k % 3 == 0, F.col("fiscal_year")).when(k % 3 == 1, F.concat(F.lit("calendar "), F.substring("fiscal_year", 1, 4))).otherwise("")
    return rows.select("id", dates.tag_year(d, fy).alias("tag"), dates.totals_year(d, fy).alias("totals"), dates.supplier_year(d, fy).alias("supplier"))


_BODY = "s_name || CASE WHEN k = 0 THEN ' church' ELSE ' motors' END"
_CODES = ("'11111' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0')", "'22222' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0')")


@query("d13_split_names", f"""
SELECT s_suppkey, j, CASE WHEN k = 0 AND j IN (1, 3) THEN name || ' [bn ' || {_CODES[0]} || ']' WHEN k = 0 AND j = 2 THEN name || ' [bn ' || {_CODES[1]} || ']' ELSE name END AS node
FROM (SELECT s_suppkey, k, {_BODY} AS name, unnest(range(1, 5)) AS j FROM (SELECT *, s_suppkey % 2 AS k FROM supplier))""")
def d13(spark, sf):
    """Names of two bodies with disjoint places; a record without a number joins the piece of its place, or stays apart."""
    base = table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") % 2).select("s_suppkey", "k", F.expr(_BODY).alias("base"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("j"))
    first, second = (F.expr(c.replace("VARCHAR", "STRING")) for c in _CODES)
    j, two = F.col("j"), F.col("k") == 0
    code = F.when(j == 1, first).when((j == 2) & two, second)
    postal = F.when(j.isin(1, 3), "A1A1A1").when(j == 2, F.when(two, "B2B2B2").otherwise("C3C3C3"))
    town = F.when(j == 1, "gander").when((j == 2) & two, "corner brook")
    rows = base.select("s_suppkey", "j", "base", code.alias("code"), postal.alias("postal"), town.alias("locality"), F.lit(None).cast("string").alias("anchor"))
    return splitting.node_keys(rows).select("s_suppkey", "j", "node")


_STOPS = ", ".join(f"'{w}'" for w in searching.STOP)


@query("q04_query_words", f"""
SELECT item_id, CAST(i AS INTEGER) AS place, w[i + 1] AS word FROM (
  SELECT item_id, w, unnest(range(len(w))) AS i FROM (
    SELECT item_id, list_transform(list_sort(list_distinct(list_transform(x, lambda y: {{'p': list_position(x, y), 'y': y}})))[1:{searching.MOST_WORDS}], lambda z: z.y) AS w FROM (
      SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda y: length(y) >= 2 AND y NOT IN ({_STOPS})) AS x FROM benchmark WHERE regexp_full_match(text, '[\\x00-\\x7F]*'))))""")
def q04(spark, sf):
    """What every text of the benchmark would ask for as a query: its words in order."""
    plain = table(spark, sf, "benchmark").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return plain.select("item_id", F.posexplode(searching.asked(F.col("text"))).alias("place", "word"))
