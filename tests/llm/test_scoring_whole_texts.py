"""Scores by a plain forward pass, and training whose memory goes by tokens."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import zstandard

from pennyweight.llm import scoring
from pennyweight.llm.gru import WINDOW, Model, Trainer

from .test_operators import ROWS, SCHEMA

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def block(docs):
    meta = np.array([(k, len(d), 0) for k, d in enumerate(docs)], "<i8")
    return {"meta": meta.tobytes(), "ids": zstandard.compress(np.concatenate(docs).astype("<u2").tobytes())}


def log_share(row, at):
    top = max(row)
    return row[at] - top - math.log(sum(math.exp(x - top) for x in row))


def forward(model, codes):
    """The model's equations, one token after another, in double precision."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    n, h, before, total = model.hidden, np.zeros(model.hidden), 0, 0.0
    for c in codes:
        x = p["x"][before] + p["b"]
        gates = 1 / (1 + np.exp(-(h @ p["u"] + x[: 2 * n])))
        z, r = gates[:n], gates[n:]
        new = np.tanh((r * h) @ p["v"] + x[2 * n :])
        h = z * h + (1 - z) * new
        k = c // model.per_class if c < model.n_words else model.heads + c - model.n_words
        total += log_share((h @ p["c"] + p["cb"]).tolist(), k)
        if c < model.n_words:
            total += log_share((h @ p["w"][k] + p["wb"][k]).tolist(), c - k * model.per_class)
        before = c
    return total


def test_scores_are_those_of_a_plain_forward_pass(spark, monkeypatch):
    kept, real = {}, scoring.train

    def train(coded, lexicon):
        kept["lexicon"], kept["flat"] = lexicon, real(coded, lexicon)
        return kept["flat"]

    monkeypatch.setattr(scoring, "train", train)
    rows = [r for r in ROWS if len(r[1] or "") < 3000]
    got = {r["doc_id"]: r["score"] for r in scoring.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    lexicon, model = kept["lexicon"], kept["lexicon"].model(kept["flat"])
    texts = {k: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))] for k, t, *_ in rows}
    counts = Counter(w for k, ws in texts.items() if not scoring.held_out(k) for w in ws)
    for k, words in texts.items():
        codes = [lexicon.head.get(w) or lexicon.ending.get(scoring._ending(w), scoring.HEAD) for w in words]
        rare = sum(math.log10(counts[w] + 0.5) - math.log10(lexicon.rest_mass[c - scoring.HEAD]) for w, c in zip(words, codes, strict=True) if c >= scoring.HEAD)
        assert got[k] == pytest.approx(forward(model, [*codes, 0]) / math.log(10) + rare, rel=1e-4, abs=1e-3)


def test_windows_are_those_of_dense_lanes():
    r = np.random.default_rng(4)
    docs = [r.integers(0, 69, n) for n in (900, 3, 33, 1, 64, 40, 31, 32, 200)]
    mine, dense = (Trainer(Model(64, 8, 5, hidden=8), 0.1, 16) for _ in range(2))
    seen = scoring._train_block(mine, block(docs))
    lanes, starts = scoring._lanes(block(docs), 1)
    sizes = np.array([len(x) for x in lanes])
    shape = (sizes[0], len(lanes))
    targets, before, fresh = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    for k, (ids, first) in enumerate(zip(lanes, starts, strict=True)):
        targets[: len(ids), k], fresh[: len(ids), k] = ids, first
        before[: len(ids), k] = np.where(first, 0, np.r_[0, ids[:-1]])
    h = np.zeros((len(lanes), 8), np.float32)
    for t in range(0, sizes[0], WINDOW):
        n = int((sizes > t).sum())
        part = np.s_[t : t + WINDOW, :n]
        h, _ = dense.window(before[part], targets[part], h[:n], fresh[part], (np.arange(sizes[0])[:, None] < sizes)[part])
    assert seen == sizes.sum() and np.array_equal(mine.model.flat(), dense.model.flat())


def test_memory_of_training_goes_by_tokens():
    r = random.Random(1)
    docs = [np.full(200_000, 3), *(np.full(r.randint(20, 60), 5) for _ in range(400))]
    row, trainer = block(docs), Trainer(Model(64, 8, 5, hidden=8))
    tracemalloc.start()
    seen = scoring._train_block(trainer, row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = sum(len(d) for k, d in enumerate(docs) if not scoring.held_out(k))
    assert seen == want and want > 200_000
    assert peak < 150 * want  # the longest text times 256 lanes would be over 2,000 bytes to a token
