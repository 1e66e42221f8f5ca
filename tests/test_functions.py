"""Scalar rules and identity, by tables of cases."""

from datetime import date
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pennyweight.functions import closeness, codes, dates, money, names
from pennyweight.operators import answers, checking, identity, once, patterns, searching, totals
from pennyweight.sources import readers, sinks


@pytest.mark.parametrize(
    "printed, key",
    [
        ("Bishop’s Falls Motors Ltd.", "bishops falls motors"),
        ("Acme Inc. o/a Corner Shop", "acme"),
        ("Smith & Co", "smith"),
        ("Harbour Co-operative Limited", "harbour cooperative"),
        ("Dairy Farmers Board (DFB)", "dairy farmers board"),
        ("Minister of Finance (PEI)", "minister of finance pei"),
        ("12345 NL Inc", "12345 newfoundland and labrador"),
        ("Société Générale Ltée", "societe generale"),
        ("", ""),
        (None, ""),
    ],
)
def test_entity_key(printed, key):
    assert names.entity_key(printed) == key


def test_name_forms():
    assert names.name_forms("Green Farm|Ferme verte", True) == ["Green Farm", "Ferme verte"]
    assert names.name_forms("Vish Limited Vish Limitée") == ["Vish Limited"]
    assert names.name_forms("A Name|Another") == ["A Name|Another"]
    assert names.name_forms(None) == []


def plain_distance(a, b):
    """Optimal string alignment, the textbook table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_slips(a, b):
    assert names.slips(a, b) == min(plain_distance(a, b), 3)


def test_swap_is_one_slip():
    assert names.slips("memorail", "memorial") == 1


def test_missing_is_not_zero(spark):
    rows = spark.createDataFrame([("a", "CAD", None), ("a", "CAD", None), ("b", "CAD", 0.0)], "dataset string, currency string, amount double")
    got = {r["dataset"]: (r["records"], r["missing"], r["zero"], r["value"]) for r in totals.group_totals(rows).collect()}
    assert got == {"a": (2, 2, 0, None), "b": (1, 0, 1, 0.0)}


def test_two_dash_rules(spark):
    row = spark.createDataFrame([("-",)], "x string").select(money.money(F.col("x")).alias("m"), money.document_number(F.col("x")).alias("d")).first()
    assert row["m"] is None and row["d"] == 0.0


def test_contract_key(spark):
    cases = {"PO# 12": "12", "po12": "12", " 12 ": "12", "N/A": "", "TBC": "", None: "", "A-7/PO9": "A-7PO9"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", codes.contract_key(F.col("x")).alias("k")).collect()
    assert {r["x"]: r["k"] for r in rows} == cases


def test_read_date(spark):
    cases = {"2024-02-30": None, "3-APR-2024": date(2024, 4, 3), "03-Apr-24": date(2024, 4, 3), "13/2/2024": date(2024, 2, 13), "soon": None}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", dates.read_date(F.col("x")).alias("d")).collect()
    assert {r["x"]: r["d"] for r in rows} == cases


def greedy(days):
    out, anchor = [], None
    for d in sorted(days):
        if anchor is None or d - anchor > 7:
            anchor = d
        out.append((anchor, d))
    return set(out)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=15))
def test_anchored_clusters(spark, days):
    rows = spark.createDataFrame([(1, d) for d in days], "k int, n int").select("k", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("day"))
    start = date(2024, 1, 1).toordinal()
    got = {(r["anchor"].toordinal() - start, r["day"].toordinal() - start) for r in once.anchored_clusters(rows, ["k"], "day", 7, []).collect()}
    assert got == greedy(days)


def test_repeats_boundaries(spark):
    base = dict(contract_no="PO 7", supplier_key=1, amount=5.0, award_date=date(2024, 1, 1), buyer_key=2, description="Salt", term="N/A", renewal="", currency="CAD")
    rows = [dict(base, id="1"), dict(base, id="2", term="not stated", contract_no="7"), dict(base, id="3", amount=6.0), dict(base, id="4", currency="USD"), dict(base, id="5", award_date=None), dict(base, id="6", description="salt!"), dict(base, id="7", contract_no="TBD")]
    schema = "id string, contract_no string, supplier_key int, amount double, award_date date, buyer_key int, description string, term string, renewal string, currency string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r["id"]: r["counted_id"] for r in once.repeats(df, ["id"]).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "5", "6": "1", "7": "7"}


def test_reviews(spark):
    marked = spark.createDataFrame([("1", "1"), ("2", "2"), ("3", "3")], "id string, counted_id string")
    reviews = spark.createDataFrame([("1", "2", "repeat", "x"), ("1", "3", "keep", "y")], "id_a string, id_b string, decision string, evidence string")
    assert {r["id"]: r["counted_id"] for r in once.review(marked, reviews).collect()} == {"1": "1", "2": "1", "3": "3"}
    reviews = spark.createDataFrame([("1", "2", "correction", "x")], "id_a string, id_b string, decision string, evidence string")
    assert {r["id"]: r["counted_id"] for r in once.review(marked, reviews).collect()} == {"1": "2", "2": "2", "3": "3"}


@pytest.mark.parametrize("days, pairs", [(31, {("1", "2")}), (30, set())])
def test_within_days(spark, days, pairs):
    rows = spark.createDataFrame([("1", 7, date(2024, 1, 1)), ("2", 7, date(2024, 2, 1)), ("3", 8, date(2024, 1, 1))], "id string, k int, day date")
    assert {(r["a"], r["b"]) for r in once.near_in_time(rows, ["k"], "day", days, "id").collect()} == pairs


def member(key, code="", postal=(), n=1):
    profiles = [{"code": code, "postal": set(postal), "locality": set(), "anchors": set()}] if code else []
    return {"key": key, "n": n, "shown": 0.0, "profiles": profiles}


def test_conflicts_block_joins():
    a, b, c = member("a", "111111118", ["A1A1A1"], 3), member("b", n=2), member("c", "222222226", ["B1B1B1"])
    for edges in permutations([("a", "b", 0, "x"), ("b", "c", 1, "y")]):
        of, made, blocked = identity.replay([a, b, c], list(edges), {})
        assert of == {"a": "a", "b": "a", "c": "c"} and made == [("a", "b", 0, "x")]
        assert blocked == [("b", "c", 1, "conflicting identifiers and disjoint postal evidence")]


def test_places_of_one_code_are_pooled_before_they_disagree():
    rows = [member("a", "111111118", ["A1A1A1"]), member("b", "111111118", ["B1B1B1"]), member("c", "222222226", ["B1B1B1"])]
    of, _, blocked = identity.replay(rows, [("a", "b", 0, ""), ("b", "c", 1, "")], {})
    assert len(set(of.values())) == 1 and not blocked


def test_apart_pairs_hold_for_groups():
    of, _, blocked = identity.replay([member("a"), member("b"), member("c")], [("a", "b", 0, ""), ("b", "c", 1, "")], {frozenset("ac"): "reviewed"})
    assert of["a"] == of["b"] != of["c"] and blocked == [("b", "c", 1, "reviewed (c / a)")]


@pytest.mark.parametrize(
    "a, b, inside, unit",
    [
        ("nunatukavut", "nunatukavut community council", True, False),
        ("nunatukavut", "nunatukavut council", True, False),
        ("newfoundland and labrador", "newfoundland and labrador association", False, False),
        ("pentecostal tabernacle", "clarenville pentecostal tabernacle", False, False),
        ("memorial university", "memorial university faculty of arts", False, True),
        ("government of newfoundland and labrador", "government of newfoundland and labrador department of education", False, True),
        ("town of", "town of gander department of works", False, False),
        ("acme 1", "acme 2 group", False, False),
    ],
)
def test_close_names(spark, a, b, inside, unit):
    rows = spark.createDataFrame([(a, b), (b, a)], "a string, b string")
    found = rows.select(closeness.contained(F.col("a"), F.col("b")), closeness.unit_of(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in found] == [(inside, unit)] * 2


def test_towns(spark):
    cases = {"gander newfoundland and labrador": "gander", "st johns nl": "st johns", "labrador": None, "newfoundland and labrador": None, "n a": None, "": None, "labrador city": "labrador city", "corner brook": "corner brook"}
    rows = spark.createDataFrame([(k,) for k in cases], "key string")
    assert {r[0]: r[1] for r in rows.select("key", closeness.town(F.col("key"))).collect()} == cases


def test_who_opposes_whom():
    bag = lambda code, postal=(), town=(), anchors=(): {"code": code, "postal": set(postal), "locality": set(town), "anchors": set(anchors)}
    known = {p["code"]: p for p in (
        bag("111111118", ["A"], ["x"]), bag("222222226", ["B"], ["x"]), bag("333333334", ["A", "B"], ["y"]),
        bag("444444442RR0001", (), ["x"], ["one"]), bag("444444442RR0002", (), ["x"], ["two"]), bag("444444442", ["C"], ["z"], ["three"]), bag("", ["D"], ["w"]),
    )}
    got = identity.opposed(known)
    assert got["111111118"] == {"222222226": identity.DISAGREEMENTS["postal"], "333333334": identity.DISAGREEMENTS["locality"], "444444442": identity.DISAGREEMENTS["postal"]}
    assert got["444444442RR0001"] == {"444444442RR0002": identity.DISAGREEMENTS["anchors"], "333333334": identity.DISAGREEMENTS["locality"]}
    assert "444444442RR0001" not in got["444444442"] and "" not in got
    assert all(got[o][c] == w for c, others in got.items() for o, w in others.items())


def test_connected_chain(spark):
    edges = spark.createDataFrame([(f"{k:02}", f"{k + 1:02}") for k in range(30)], "a string, b string")
    assert {r["component"] for r in identity.connected(edges).collect()} == {"00"}


def test_names_resolve_or_are_ambiguous(spark):
    rows = spark.createDataFrame([("Town of A",), ("Town of B",), ("City",)], "place string")
    assert answers.resolve_name(rows, "place", "city") == "City"
    assert answers.resolve_name(rows, "place", "of b") == "Town of B"
    with pytest.raises(answers.Ambiguous):
        answers.resolve_name(rows, "place", "town")


def test_search_falls_back_to_spelling(spark):
    docs = spark.createDataFrame([(1, "memorial university"), (2, "road salt"), (3, "memorial")], "doc_id int, text string")
    posted = searching.postings(docs)
    hits, words = searching.find(spark, posted, "the memorail")
    assert words == ["memorial"] and {r["doc_id"] for r in hits.collect()} == {1, 3}


def test_sync_refuses_large_plans(spark):
    a = spark.createDataFrame([(1, "x")], "k int, h string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, h string")
    assert once.sync_plan(a, b, "k", "h", 3).count() == 3
    with pytest.raises(ValueError, match="at most 2"):
        once.sync_plan(a, b, "k", "h", 2)


def test_shards_must_balance(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    with pytest.raises(ValueError):
        checking.must_balance(a, a.limit(1), "x")


def test_year_end_guards_differ(spark):
    rows = [("b", 1, f"i{k}", date(2024, 3 if k < 10 else 5, 1), 1.0 if k < 10 else 0.1) for k in range(25)] + [("b", 1, "none", date(2024, 3, 2), None)]
    df = spark.createDataFrame(rows, "buyer string, buyer_key int, id string, award_date date, amount double")
    subjects, marked = patterns.year_end(df)
    assert subjects.count() == 1 and marked.count() == 11


def test_csv_lines_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfx,y\n1,"a\nb"\n2,c\n')
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/a.csv")
    got = [(r["csv_line"], r["x"], r["y"]) for r in readers.csv_with_lines(files, ["x", "y"]).collect()]
    assert got == [(2, "1", "a\nb"), (4, "2", "c")]


def test_workbook(spark, tmp_path):
    import zipfile

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>12.5</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Employee name</t></si><si><t>Base salary</t></si><si><t>Roe</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    rows = readers.workbook_rows(spark.read.format("binaryFile").load(f"file://{tmp_path}/w.xlsx"))
    got = readers.table_rows(rows, {"name": ["name"], "base": ["base", "salary"]}).collect()
    assert [(r["name"], r["base"]) for r in got] == [("Roe", "12.5")]


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("t.csv", "x\n1\n")
        z.writestr("note.txt", "no")
    files = readers.zipped_members(spark.read.format("binaryFile").load(f"file://{tmp_path}/z.zip"))
    assert [r["x"] for r in readers.csv_with_lines(files, ["x"]).collect()] == ["1"]


def test_report_lines(spark):
    lines = spark.createDataFrame([("p", k, v) for k, v in enumerate(["EXECUTIVE COUNCIL", "1.1.01. Office", "01. Salaries      1,200", "  10. Grants      -", "nothing"])], "path string, line int, value string")
    got = [tuple(r)[2:] for r in readers.program_lines(lines).orderBy("line").collect()]
    assert got == [("Executive Council", "1.1.01", "01", "Salaries", 1200.0), ("Executive Council", "1.1.01", "10", "Grants", 0.0)]
    allowance = spark.createDataFrame([("Office    1,000.00   250.00  750.00  25.0%",), ("Travel    --   10.00  --  --",)], "value string")
    assert [tuple(r) for r in readers.allowance_lines(allowance).collect()] == [("Office", 1000.0, 250.0, 750.0, 25.0), ("Travel", None, 10.0, None, None)]


def test_a_crash_leaves_the_last_whole_version(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    assert sinks.read_baseline(spark, path) is None
    for n in (1, 2, 3):
        sinks.commit_baseline(spark.range(n), path)
        assert sinks.read_baseline(spark, path).count() == n
    (tmp_path / "table" / "v000000000004").mkdir()  # begun, never finished
    assert sinks.read_baseline(spark, path).count() == 3
    assert sinks.commit_baseline(spark.range(9), path) == 4 and sinks.read_baseline(spark, path).count() == 9
    sinks.commit_baseline(spark.range(8), path, version=4)  # run again
    assert sinks.read_baseline(spark, path).count() == 8 and sinks.read_baseline(spark, path, below=4).count() == 3
