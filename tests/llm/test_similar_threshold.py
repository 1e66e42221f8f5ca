"""Near-duplicates at the very threshold, and crowds far from it."""

import random

import pytest
from pyspark.sql import functions as F

from pennyweight.llm import similar, simhash

from .test_operators import near_groups


def changed(words, places, mark):
    out = list(words)
    for k in places:
        out[k] = f"{mark}{k}"
    return " ".join(out)


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_about_the_threshold(spark):
    r = random.Random(3)
    rows, seen = [], []
    for k in range(150):
        n = r.choice([60, 100, 220])
        words = [f"{k}w{j}" for j in range(n)]
        rows.append((2 * k, " ".join(words)))
        # a word in the middle takes five shingles of n - 4 away from each side
        rows.append((2 * k + 1, changed(words, r.sample(range(n), max(1, round(n * r.uniform(0.015, 0.03)))), "x")))
        seen.append(jaccard(rows[-2][1], rows[-1][1]))
    words = [f"exact{j}" for j in range(49)]  # 45 shingles; five change: 40 of 50 are shared
    rows += [(1000, " ".join(words)), (1001, changed(words, [20], "y"))]
    assert jaccard(rows[-2][1], rows[-1][1]) == 0.8
    assert sum(0.8 <= s <= 0.85 for s in seen) > 20 and sum(0.75 <= s < 0.8 for s in seen) > 5
    kept = {x["doc_id"] for x in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == near_groups(rows) and 1001 not in kept


@pytest.mark.parametrize("edits", [12, 8])
def test_crowds_below_the_threshold_send_few_pairs(spark, edits):
    """The tables' pairs of a crowd far from 0.8 grow with its members, not with their square."""
    words, found = [f"w{k}" for k in range(300)], []
    for members in (150, 300):
        r = random.Random(8)
        rows = [(k, changed(words, r.sample(range(300), edits), f"m{k}x")) for k in range(members)]
        nodes = similar.distinct(spark.createDataFrame(rows, "doc_id long, text string"))
        known, _ = similar.prints(nodes)
        found.append(similar.by_tables(known, members).where(F.col("a") != F.col("b")).count())
    assert found[1] <= 3 * max(found[0], 100), found
