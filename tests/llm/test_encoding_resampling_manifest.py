"""BPE, importance resampling and the manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pennyweight.llm import bpe, importance, merkle, queries
from pennyweight.llm.encoding import default_vocabulary
from pennyweight.llm.ordering import numbered

from .test_operators import ROWS, SCHEMA

CLASHES = ("ids", "row", "rank", "score", "tree", "index", "digest", "size", "level", "block", "chunk", "weight", "_at", "_part", "_index")
AWKWARD = ["", " ", "  ", " a", "  a", "a ", "a  b", "  a  b\n\n c", " don't 's ’s x", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>b c", " <|endoftext|>\n", "日本 語  テキスト", "\x1c \x1cq", "՘ a՘b ࢏x", "a\x85 b", "ab" * 3000 + " x", "é" * 500, "\n" * 200, "  " * 300, "　x　 y"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(default_vocabulary())


def test_bpe_is_that_of_the_library(spark, reference):
    r = random.Random(4)
    signs = [" ", "  ", "\n", "a", "é", "ß", ".", ",", "'", "s", "1", "²", "🙂", "\t", "|", "<", "ll", "՘", "\x1c", "\x85", "　", "<|endoftext|>", "the ", "ing"]
    texts = AWKWARD + ["".join(r.choices(signs, k=r.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(50, 400))) for _ in range(60)]
    texts += [" ".join("".join(r.choices("abcdeé", k=5)) for _ in range(60_000))]  # a long text
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for x in bpe.decode(bpe.encode(frame)).collect():
        want = reference.encode(texts[x["doc_id"]], add_special_tokens=False).ids
        assert x["ids"] == want, texts[x["doc_id"]][:80]
        assert x["text"] == reference.decode(want, skip_special_tokens=False)


def test_array_and_heap_merge_alike():
    made, r = bpe.codec(default_vocabulary()), random.Random(5)
    words = [bytes(r.choices(b"aabcdent\xc3\xa9", k=r.randint(1, 64))) for _ in range(400)] + [b"a" * k for k in range(1, 65)]
    assert made.scan(words) == [made.heap(w) for w in words]


def test_decoding_any_identifiers(spark, reference):
    r = random.Random(6)
    rows = [(k, [r.randrange(50257) for _ in range(20)]) for k in range(50)]
    frame = spark.createDataFrame([*rows, (90, []), (91, None), (92, [-1, None, 60_000, 64])], "doc_id long, ids array<int>")
    got = {x["doc_id"]: x["text"] for x in bpe.decode(frame).collect()}
    assert got == {**{k: reference.decode(ids, skip_special_tokens=False) for k, ids in rows}, 90: "", 91: None, 92: reference.decode([64])}


def test_cache_that_is_full(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    made, r = bpe.Codec(default_vocabulary()), random.Random(7)
    texts = [" ".join("".join(r.choices("abc.\n", k=r.randint(1, 5))) for _ in range(50)) for _ in range(40)]
    for k in range(0, 40, 8):
        assert [np.frombuffer(x, "<i4").tolist() for x in made.encode(texts[k : k + 8])] == [reference.encode(t, add_special_tokens=False).ids for t in texts[k : k + 8]]
    assert len(made.known) <= 40 and len(made.pieces) <= 20


def words(text):
    lower = (text or "").translate({65 + i: 97 + i for i in range(26)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, percent, least, n, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs(t, n))
    t = Counter(bucket(f) for x in target for f in runs(x, n))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets))))) for b in range(buckets)}
    out = []
    for doc_id, text in rows:
        found = [gain[bucket(f)] for f in runs(text, n)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    drawn = able[: percent * len(able) // 100]
    return out, [(x[0], x[4]) for x in drawn]


@pytest.mark.parametrize("cut, n, buckets", [(1 << 16, 2, 10_000), (60, 2, 500), (60, 3, 70_000), (1, 1, 7)])
def test_resampling(spark, monkeypatch, cut, n, buckets):
    monkeypatch.setattr(importance, "CHUNK_BYTES", cut)
    monkeypatch.setattr(importance, "CHUNK_WORDS", 8192 if cut > 100 else 5)
    rows = [(k, t) for k, t, *_ in ROWS] + [(3, ROWS[3][1]), (3, "Twice THE same 1a Ünd ünd"), (None, "no id " * 30), (None, None), (2000, "w" * 300 + " " + "x" * 63 + " y" * 30)]
    target = [t for _, t, *_ in ROWS[:9] if t]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame(list(enumerate(target)), "doc_id long, text string")
    for clash in CLASHES:
        frame = frame.withColumn(clash, F.lit(1))
    got = importance.resample(frame, goal, least_words=10, n=n, buckets=buckets).collect()
    want, drawn = resampled(rows, target, 25, 10, n, buckets)
    assert sorted(map(repr, ((x["doc_id"], x["n_words"], x["n_features"], x["weight"], x["score"]) for x in got))) == sorted(map(repr, want))
    assert [(x["doc_id"], x["score"]) for x in sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])] == drawn


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(ROWS, SCHEMA)
    assert importance.resample(empty, some).collect() == []
    assert importance.resample(some, empty).count() == len(ROWS)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(nodes, arity):
    """The top of a tree, and the siblings of each leaf, as the contract words it."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(proofs):
            run = at[k] - at[k] % arity
            p.append((at[k] - run, nodes[run : at[k]] + nodes[at[k] + 1 : run + arity]))
            at[k] //= arity
        nodes = [H(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], proofs


def manifest(rows, arity):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in order:
        mine = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[lang] = (*tree([leaf(r) for r in mine], arity), mine)
    root, above = tree([inner[x][0] for x in order], arity)
    return sorted((r[0] or -1, leaf(r), tuple((s, tuple(o)) for s, o in p + up), sub, root) for x, up in zip(order, above, strict=True) for sub, proofs, mine in [inner[x]] for r, p in zip(mine, proofs, strict=True))


@pytest.mark.parametrize("arity, levels, langs, held", [(2, 12, 3, 100_000), (2, 2, 1, 2), (3, 1, 40, 5), (2, 3, 2, 1)])
def test_manifest(spark, monkeypatch, arity, levels, langs, held):
    monkeypatch.setattr(merkle, "HELD", held)
    rows = [(k, t, [None, "", "en", "dé", *map(str, range(50))][k % langs if k % 4 else 0], s, n) for k, t, _, s, n in ROWS]
    rows += [(7, "again", None, None, None), (7, "again", None, None, None), (None, None, "en", None, 1), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for clash in CLASHES:
        frame = frame.withColumn(clash, F.lit(1))
    found = merkle.manifest(frame.withColumn("steps", F.col("n_chars")), ("rank",), arity, levels)
    got = found.withColumn("folded", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
    mine = sorted((x["doc_id"] or -1, x["leaf"], tuple((s["slot"], tuple(s["others"])) for s in x["steps"]), x["subroot"], x["root"]) for x in got)
    assert mine == manifest(rows, arity)
    assert all(x["folded"] == x["root"] and x["rank"] == 1 for x in got)


def test_manifest_finds_what_was_changed(spark):
    rows = queries.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    for x in rows:
        assert x["verified"] == (x["folded_root"] == x["root"])
        assert x["verified"] == (zlib.crc32(str(x["doc_id"]).encode()) % 7 != 0)
    assert len({x["root"] for x in rows}) == 1


def test_manifest_of_one_row_and_none(spark):
    one = merkle.manifest(spark.createDataFrame(ROWS[:1], SCHEMA)).collect()
    assert [(x["leaf"], x["steps"], x["subroot"], x["root"]) for x in one] == [(leaf(ROWS[0]), [], leaf(ROWS[0]), leaf(ROWS[0]))]
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numbers_follow_the_order(spark):
    frame = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.hash("id").alias("h")).repartition(7)
    got = numbered(frame, ["g"], [F.col("h").desc(), F.col("id")], "n").collect()
    for g in range(3):
        mine = sorted((x for x in got if x["g"] == g), key=lambda x: x["n"])
        assert [x["n"] for x in mine] == list(range(len(mine)))
        assert [(-x["h"], x["id"]) for x in mine] == sorted((-x["h"], x["id"]) for x in mine)
