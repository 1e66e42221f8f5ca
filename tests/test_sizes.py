"""How plans and work grow, on small tables: what failed by time or disk on large ones."""

import random
import re
import time
from decimal import Decimal
from itertools import combinations

from pyspark.sql import functions as F

from pennyweight.functions import names
from pennyweight.operators import families, identity, index, once, repeats, searching
from pennyweight.plans import catalogue, io, ledger
from pennyweight.sources import programs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_program_reports_try_each_pattern_once_and_shuffle_lines_once(spark):
    lines = [
        "DEPARTMENT OF WORKS", "CURRENT", "    1.1.01. ROADS AND BRIDGES", "      - NORTHERN", "        REGION", "", "      01. Salaries      10   10  -",
        "      10. Grants and Subsidies:", "                  Town of Gander      (1,000)   7  -", "      02. Revenue - Provincial      (5)   (5)  -", "      Total: Roads      (995)   12  -",
        "  1.1.02. WHARVES", "      11. Debt\t  3 4 5  ", "      Total: Wharves      3   4  5",
    ]
    given = spark.createDataFrame([(p, k, x) for p in ("a", "b") for k, x in enumerate(lines)], "path string, line int, value string")
    rows = programs.program_rows(given)
    made = plan(rows)
    # a line's amounts are found by one match; context and the names that run on come from one reading of the lines
    assert made.count(programs.THREE) == 1
    assert len(re.findall(r"Exchange hashpartitioning", made)) == 1 and "Join" not in made
    got = [tuple(r) for r in rows.where("path = 'b'").orderBy("line").select("line", "line_type", "object_code", "program", *programs._AMOUNTS).collect()]
    roads, wharves = "Roads And Bridges Northern Region", "Wharves"
    assert got == [
        (6, "object", "01", roads, 10.0, 10.0, 0.0), (7, "object", "10", roads, -1000.0, 7.0, 0.0), (8, "detail", "10", roads, -1000.0, 7.0, 0.0), (9, "revenue", "02", roads, -5.0, -5.0, 0.0),
        (10, "program_total", "", roads, -995.0, 12.0, 0.0), (12, "object", "11", wharves, 3.0, 4.0, 5.0), (13, "program_total", "", wharves, 3.0, 4.0, 5.0),
    ]
    assert rows.where(F.col("department") != "Department Of Works").count() == 0


def test_embedding_text_does_not_look_through_a_list_for_each_of_its_values(spark):
    values = [f"{'Wharf' if k % 3 else 'wharf'} {k // 2 % 700}" for k in range(16000)]
    given = spark.createDataFrame([("Works", values, ["works", " ", None, "In Gander", "in gander ", "in gander"])], "head string, a array<string>, b array<string>")
    text = searching.embedding_text([F.col("head"), F.lit(None)], [F.col("a"), F.col("b")], 1_000_000)
    began = time.monotonic()
    (got,) = given.repartition(1).select(text).first()
    took = time.monotonic() - began
    seen, want = {"works"}, ["Works"]
    for x in [*values, "In Gander", "in gander "]:
        if x.lower() not in seen:
            seen.add(x.lower())
            want.append(x.strip())
    assert got == ". ".join(want)
    assert took < 10


def test_names_a_slip_apart_are_found_without_comparing_those_that_begin_or_end_alike(spark):
    draw = random.Random(5)
    names_ = ["".join(draw.choices("abcdefgh", k=10)) + " fish market" for _ in range(600)]
    for _ in range(200):
        name = list(draw.choice(names_) if draw.random() < 0.7 else draw.choice(["".join(draw.choices("ab", k=n)) for n in (7, 8, 11, 12, 13)]))
        for _ in range(draw.randrange(1, 4)):
            k = draw.randrange(len(name) - 1)
            draw.choice([lambda k=k: name.insert(k, "z"), lambda k=k: name.pop(k), lambda k=k: name.__setitem__(slice(k, k + 2), name[k : k + 2][::-1]), lambda k=k: name.__setitem__(k, "e")])()
        names_.append("".join(name).strip())
    names_ += ["fish of market", "fishmarket", "unit 12 of the harbour", "unit 21 of the harbour", "unit 12 of the harbor", "x", "of", ""]
    keys = sorted({" ".join(n.split()) for n in names_})
    plain = {k: names.letters_only(k) for k in keys}
    want = {(a, b) for a, b in combinations(keys, 2) if min(len(plain[a]), len(plain[b])) >= 8 and abs(len(plain[a]) - len(plain[b])) <= 2 and names.slip_apart(a, b)}
    assert len(want) > 60 and any(a[:5] != b[:5] and a[-5:] != b[-5:] for a, b in want)
    given = spark.createDataFrame([(k,) for k in keys], "name string")
    keyed = given.select(F.col("name").alias("key"), F.col("name").alias("base"))
    assert identity.slipping_names(keyed).count() < 10 * len(want)  # of a quarter of a million that end alike
    assert {tuple(r) for r in identity.near_names(given, "name", largest=None).collect()} == want


def test_key_families_read_items_once_and_shuffle_a_short_key(spark):
    made = plan(catalogue.QUERIES["a25_key_families"](spark, SF))
    # items with their orders, and the first lines for the actuals; both ledgers come of the same sums
    assert made.count("FileScan parquet") == 3 and made.count("Join ") == 1, made
    assert not re.search("Expand|FullOuter", made)


def test_key_families_hold_by_their_conditions(spark):
    columns = "before decimal(18,2), after decimal(18,2), dataset string, year string, award_year string, buyer string, supplier string, method string, label string, buys boolean, tenders boolean, supplied boolean, federal boolean, flags array<string>"
    rows = [(3, None, "award", "2020", "2021", "b", "", None, "included", True, None, True, False, ["f", "g"]), (4, 4, "award", "2020", "2021", "b", "s", "m", "excluded", False, True, True, True, None)]
    items = spark.createDataFrame([tuple(Decimal(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows], columns)
    spent = spark.createDataFrame([("2020-21", Decimal(7), Decimal(1))], "fiscal_year string, before decimal(18,2), after decimal(18,2)")
    got = {(r["family"], r["key"]): (int(r["before"]), int(r["after"])) for r in families.family_totals(items, spent, ["before", "after"]).collect()}
    assert got == {
        ("source", "award"): (7, 4), ("source/year", "award / 2020"): (7, 4), ("body", "b"): (3, 0), ("body/source", "b / award"): (3, 0), ("body/year", "b / 2021"): (3, 0), ("body/supplier", "b / not stated"): (3, 0),
        ("body/method", "b / m"): (4, 4), ("supplier/source", "not stated / award"): (3, 0), ("supplier/source", "s / award"): (4, 4), ("supplier", "not stated / included"): (3, 0), ("supplier", "s / excluded"): (4, 4),
        ("supplier/body", "not stated / b / included"): (3, 0), ("supplier/body", "s / b / excluded"): (4, 4), ("supplier/year", "not stated / 2020"): (3, 0), ("home/former-combined-federal-record-values", ""): (4, 4),
        ("pattern", "f"): (3, 0), ("pattern", "g"): (3, 0), ("provincial-actuals", "2020-21"): (7, 1),
    }


def test_pairs_near_in_time_are_found_from_rows_shuffled_once(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["x", "y", None]), draw.choice([1, 1, 2]), k, draw.choice([-1, 0, 31, 32, 511, 512, 543, 544, 545, *(draw.randrange(-600, 1500) for _ in range(9)), None])) for k in range(700)]
    given = spark.createDataFrame(rows, "s string, t int, k long, n int").withColumn("day", F.expr("date_add(DATE'1970-01-01', n)")).repartition(3)
    found = once.near_in_time(given, ["s", "t"], "day", 31, "k")
    assert plan(found).count("Exchange hashpartitioning") == 1 and "Join" not in plan(found)
    got = [(r["s"], r["t"], r["a"], r["b"], (r["day_b"] - r["day_a"]).days) for r in found.collect()]
    want = [(s, t, k, l, m - n) for s, t, k, n in rows for s2, t2, l, m in rows if None not in (s, n, s2, m) and (s, t) == (s2, t2) and (n, k) < (m, l) and m - n <= 31]
    assert sorted(got) == sorted(want) and len(got) > 2000


def test_links_of_printings_come_of_one_shuffle_by_their_group(spark):
    given = spark.createDataFrame([(1, "a", 1, 1, "CAD", None, 1, "", "", "")], "id long, contract_no string, supplier_key long, amount int, currency string, award_date date, buyer_key int, description string, term string, renewal string")
    reviews = spark.createDataFrame([(1, 2, "repeat", "e")], "id_a long, id_b long, decision string, evidence string")
    assert plan(repeats.links(given, reviews)).count("Exchange hashpartitioning(_contract") == 1


def test_index_is_built_from_documents_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        made.add(1)
        return x

    rows = [("a", "to be or not To be", ["#t"]), ("b", "Été, to", []), ("c", None, None), ("d", " ", ["#t", "#u"])]
    docs = spark.createDataFrame(rows, "doc_id string, said string, tags array<string>").repartition(2).withColumn("body", told("said"))
    found = index.build(docs, f"file://{tmp_path}/index")
    assert made.value == len(rows)
    want = {("to", "a", 2), ("be", "a", 2), ("or", "a", 1), ("not", "a", 1), ("ete", "b", 1), ("to", "b", 1), ("#t", "a", 1), ("#t", "d", 1), ("#u", "d", 1)}
    assert {(r["term"], r["doc_id"], r["tf"]) for r in found.collect()} == want and found.count() == len(want)


def test_documents_are_packed_and_made_by_one_shuffle(spark):
    rows = [(f"i{k}", "one" if k % 3 else "each", k % 4, "w") for k in range(90)]
    items = spark.createDataFrame(rows, "id string, dataset string, g int, said string")
    docs = index.documents(index.packed(items, {"one": (("g",), 7), "each": ((), 1)}), [F.col("said")], {"dataset": F.col("dataset")}, F.array().cast("array<string>"))
    assert plan(docs).count("Exchange hashpartitioning") == 1
    sizes = sorted(r["n"] for r in docs.collect())
    assert sizes == [1] * 32 + [2] + [7] * 8 and docs.select("doc_id").distinct().count() == len(sizes)


def test_closed_sample_makes_the_ledger_once(spark, monkeypatch):
    made, whole = spark.sparkContext.accumulator(0), io.items(spark, SF, "id")

    @F.udf("string")
    def told(x):
        made.add(1)
        return x

    monkeypatch.setattr(io, "items", lambda *a: ledger.items(*a).withColumn("id", told("id")))
    found = catalogue.QUERIES["k10_closed_sample"](spark, SF)
    assert found.count() > 0 and made.value == whole.count()
