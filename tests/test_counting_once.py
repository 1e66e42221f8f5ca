"""Repeats and agreements against row-by-row replays."""

import random
from datetime import date, timedelta

import pytest

from pennyweight.operators import agreements, repeats

PRINTING = "id long, contract_no string, supplier_key long, amount double, currency string, award_date date, buyer_key long, description string, term string, renewal string"


def replayed(rows, reviews):
    """The links that reading the rows one by one gives."""
    told = {frozenset(r[:2]): r for r in reviews}
    standing, out = {}, {}
    for r in sorted(rows):
        number = (r[1] or "").strip()
        if not number or r[2] is None or r[3] is None or r[4] != "CAD":
            continue
        group = standing.setdefault((number, r[2], r[3]), [])
        for k, first in enumerate(group):
            review = told.get(frozenset((first[0], r[0])))
            same = None not in (r[5], r[6]) and r[7] and (r[5:8], {"N/A": ""}.get(r[8], r[8])) == (first[5:8], {"N/A": ""}.get(first[8], first[8]))
            decision = review[2] if review else "repeat" if same else "keep"
            if decision == "keep":
                continue
            if decision == "correction" and review[1] == r[0]:
                out[first[0]] = (r[0], "correction")
                group[k] = r
            else:
                out[r[0]] = (first[0], "repeat")
            break
        else:
            group.append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_are_those_of_reading_in_order(spark, seed):
    r = random.Random(seed)
    rows = [
        (k, r.choice(["7"] * 6 + ["8", "", None]), r.choice([1] * 6 + [2, None]), r.choice([5.0] * 6 + [None]), r.choice(["CAD"] * 5 + ["USD"]), r.choice([date(2024, 1, 1), date(2024, 1, 9), None]), r.choice([3, 3, None]), r.choice(["pens", "ink", ""]), r.choice(["", "N/A", "1y"]), "")
        for k in range(150)
    ]
    pairs = {frozenset(r.sample(range(150), 2)) for _ in range(400)}
    reviews = [(*r.sample(sorted(p), 2), r.choice(["repeat", "correction", "keep"]), f"why {k}") for k, p in enumerate(pairs)]
    frame = spark.createDataFrame(rows, PRINTING).repartition(4)
    told = spark.createDataFrame(reviews, "id_a long, id_b long, decision string, evidence string")
    want = replayed(rows, reviews)
    links = repeats.links(frame, told)
    assert {x["id"]: (x["to"], x["decision"]) for x in links.collect()} == want
    ends = {}
    for k in want:
        at = k
        while at in want:
            at = want[at][0]
        ends[k] = at
    assert {x["id"]: x["root"] for x in repeats.roots(links).collect()} == ends
    assert len(want) > 10


def test_long_chains_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1000)], "id long, to long")
    assert {x["root"] for x in repeats.roots(chain).collect()} == {1000}
    with pytest.raises(RuntimeError):
        repeats.roots(spark.createDataFrame([(0, 1), (1, 0)], "id long, to long"), 5)


GRANT = "seq long, org string, number string, recipient string, amendment int, amended_on string, ref string, start string, program string, title string, value double, business_number string"


def read_in_order(rows, changing):
    letters = lambda s: "".join(c for c in (s or "").split("|")[0].lower() if c.isascii() and c.isalnum())
    title = lambda s: letters(s).removesuffix("dba")
    content = lambda r: (r[1], r[3], r[7], letters(r[8]), title(r[9]))
    again = {content(r) for r in rows if not (r[2] or "").strip() and r[4] > 0}
    groups = {}
    for r in rows:
        number = (r[2] or "").strip()
        groups.setdefault((r[1], number, r[3]) if number else (r[1], "", *content(r)[1:]) if content(r) in again else (r[1], "ref", r[6], r[3]), []).append(r)
    numbers = {}
    for k in groups:
        if len(k) == 3:
            numbers.setdefault(k[:2], []).append(k)
    for keys in numbers.values():
        originals = [k for k in keys if any(r[4] == 0 for r in groups[k])]
        if len(keys) > 1 and len(originals) <= 1:
            home = (originals or keys)[0]
            starts, programs = {r[7] for r in groups[home]}, {letters(r[8])[:15] for r in groups[home]}
            for k in keys:
                if k != home and any(r[7] in starts or letters(r[8])[:15] in programs | {""} or "" in programs for r in groups[k]):
                    groups[home] += groups.pop(k)
    out = []
    for k, some in groups.items():
        some.sort(key=lambda r: (r[4], r[5] or "", r[6], r[0]))
        value = sum(r[10] or 0 for r in some) if k[0] in changing else some[-1][10]
        numbered = next((r[11] for r in reversed(some) if (r[11] or "").strip()), "")
        out.append((k[0], k[1] if len(k) == 3 else "", some[-1][3], some[-1][6], len(some), value, min(r[7] or "" for r in some), numbered))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_agreements_are_those_of_reading_in_order(spark, seed):
    r = random.Random(seed)
    rows = [
        (k, r.choice(["x", "y"]), r.choice(["1", " 2", "3 ", "4", "", None]), r.choice("abc"), r.choice([0, 1, 1, 2]), r.choice([None, "2024-01-01", "2024-02-01"]), f"R{k}", r.choice(["2020", "2021", "2022", None]),
         r.choice(["Harbour works and wharves A", "harbour WORKS and wharves B|fr", "Roads", "Schools", None]), r.choice(["T", "t dba", "U"]), r.choice([1.0, 2.5, None]), r.choice([None, "", "b1", "b2"]))
        for k in range(60)
    ]
    got = agreements.agreements(spark.createDataFrame(rows, GRANT).repartition(3), ("y",)).collect()
    mine = sorted(((x["org"], x["agreement_number"], x["recipient"], x["ref"], x["n_rows"], x["amount"], x["start"], x["business_number"]) for x in got), key=repr)
    assert mine == read_in_order(rows, ("y",))


def test_negative_values_of_who_reports_totals(spark):
    rows = [(1, "x", "1", "a", 0, None, "R1", "2020", "P", "T", -1.0, None)]
    frame = spark.createDataFrame(rows, GRANT)
    assert agreements.agreements(frame, ("x",)).first()["amount"] == -1
    with pytest.raises(Exception, match="negative grant values from x"):
        agreements.agreements(frame, ("y",)).collect()
