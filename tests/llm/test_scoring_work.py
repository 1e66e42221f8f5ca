"""Words numbered by Arrow, and how much memory training asks of the system again and again."""

import random
import resource
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from pennyweight.llm import gru, scoring
from pennyweight.llm.blocks import Block
from pennyweight.llm.common import holding, pack_uint, unpack_uint


def made(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    return Block(0, np.arange(len(texts)), np.r_[0, np.cumsum(sizes)].astype(np.int64), np.frombuffer(b"".join(texts), np.uint8), None)


def test_numbers_are_those_of_words_in_the_order_in_which_they_come():
    r = random.Random(1)
    for _ in range(200):
        texts = [bytes(r.choices(b"aAbZ \t\n\x0b\x0c\r\x1c\x85\xc3\x9f\x00", k=r.choice([0, 0, 1, 2, 5, 30]))) for _ in range(r.randint(0, 6))]
        words, docs = scoring._numbered(made(texts))
        said = [t.lower().split() for t in texts]
        assert words == list(Counter(w for ws in said for w in ws)) and len(docs) == len(texts)
        assert [[words[k] for k in d] for d in docs] == said


def test_numbering_takes_no_list_of_all_words():
    class Text(bytes):
        def split(self, *a):
            raise AssertionError("a text was cut into a list")

    block = made([b"one two", b"Two three"])
    block.text = lambda k: Text(b"")
    assert scoring._numbered(block)[0] == [b"one", b"two", b"three"]


def test_training_asks_for_no_new_pages_window_after_window():
    r = np.random.default_rng(0)
    trainer = gru.Trainer(gru.Model(1120, 32, 0), 0.05, 8192)
    ids, h = r.integers(0, 1120, (33, 256)), np.zeros((256, 32), np.float32)
    with holding():
        for k in range(25):
            if k == 5:
                before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
            h, _ = trainer.window(ids[:-1], ids[1:], h)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 20 * 200


def test_sums_of_groups_with_even_and_odd_columns():
    r = np.random.default_rng(3)
    for columns, kind in ((96, np.float32), (9, np.float64), (6, np.float64)):
        rows = r.standard_normal((50, columns)).astype(kind)
        at = np.array([0, 1, 7, 30])
        got = gru._sums(rows, at)
        assert got.dtype == kind and np.allclose(got, [part.sum(axis=0) for part in np.split(rows, at[1:])], atol=1e-5)


def test_shards_sum_and_rank_words_as_counting_one_by_one_does(monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", 6)
    monkeypatch.setattr(scoring, "Counter", None, raising=False)  # not word by word
    r, want, rows = random.Random(2), Counter(), []
    for b in range(4):
        words = list({bytes(r.choices(b"abc\xff\x00", k=r.randint(1, 4))) for _ in range(60)})
        counts = [r.choice([0, 0, 1, 2, 900]) for _ in words]
        want.update(dict(zip(words, counts, strict=True)))
        rows.append({"shard": 4, "block": b, "words": b"\n".join(words), "counts": pack_uint(np.array(counts, np.uint64))})
    kinds = {"shard": pa.int64(), "block": pa.int64(), "words": pa.binary(), "counts": pa.binary()}
    got = scoring._tell((pa.scalar(4),), pa.Table.from_pylist(rows, pa.schema(kinds))).to_pylist()
    for g in got:
        if g["kind"] == "reply":
            words = next(x["words"] for x in rows if x["block"] == g["block"]).split(b"\n")
            assert unpack_uint(zstandard.decompress(g["answer"])).tolist() == [want[w] for w in words]
    known = {w: c for w, c in want.items() if c}
    assert [(g["n"], g["mass"]) for g in got if g["kind"] == "total"] == [(sum(known.values()), len(known))]
    assert [(g["word"], g["n"]) for g in got if g["kind"] == "word"] == sorted(known.items(), key=lambda x: (-x[1], x[0]))[:5]
    ends = Counter()
    for w, c in known.items():
        ends[w[-2:].rjust(2, b"\0")] += c
    assert {g["word"]: g["n"] for g in got if g["kind"] == "ending"} == ends
