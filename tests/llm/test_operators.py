"""The operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from pennyweight.llm import blocks, chat, common, mixing, packing, quality, queries, scoring, similar, simhash, suffixes, tokenfiles, topk, windows
from pennyweight.llm.encoding import default_vocabulary, encoder
from pennyweight.llm.graph import components
from pennyweight.llm.gru import Model, Trainer, log_likelihood

from ..compare import duck, same

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    """Texts that share passages, near copies, copies, empties, nulls and one very long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(150)]
    say = lambda k: " ".join(r.choices(vocabulary, k=k))
    passages = [say(r.randint(10, 40)) for _ in range(6)]
    texts = []
    for k in range(n):
        kind = k % 10
        if kind == 0:
            texts.append(None)
        elif kind == 1:
            texts.append("")
        elif kind == 2:
            texts.append(texts[r.randrange(len(texts))])
        elif kind == 3 and any(texts):
            words = r.choice([t for t in texts if t]).split(" ")
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            texts.append(f"{say(r.randint(1, 60))}\n{r.choice(passages)} {say(r.randint(0, 30))}\t{r.choice(passages)}")
    texts.append(say(8000))
    return [(k, t, "en", f"src{k % 3 if k % 5 else 0}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks and shards, so that messages cross."""
    real = blocks.write_blocks
    monkeypatch.setattr(blocks, "write_blocks", lambda d, keep=(), block_bytes=0: (lambda r: (r[0], r[1] * 200_000))(real(d, keep, 2_000)))
    monkeypatch.setattr(blocks, "SHARD_BYTES", max(1, sum(len(t or "") for _, t, *_ in ROWS) * 200_000 // 5))


def repeated(sequences, width):
    first = {}
    for key, s in sequences:
        for k in range(len(s) - width + 1):
            first.setdefault(s[k : k + width], key)
    for key, s in sequences:
        gone = bytearray(len(s))
        for k in range(len(s) - width + 1):
            if first[s[k : k + width]] < key:
                gone[k : k + width] = b"\1" * width
        yield key, s, gone


def test_windows(docs, small_blocks):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in windows.removals(docs).collect()}
    want = {k: (len(s), sum(g), b" ".join(w for w, x in zip(s, g, strict=True) if not x).decode()) for k, s, g in repeated([(k, tuple((t or "").encode().split())) for k, t, *_ in ROWS], 13)}
    assert got == want and sum(v[1] for v in want.values()) > 200


def test_suffixes(docs, small_blocks):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.removals(docs).collect()}
    want = {}
    for k, s, g in repeated([(k, (t or "").encode()) for k, t, *_ in ROWS], 50):
        want[k] = (len(s), sum(g), sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1])), bytes(b for b, x in zip(s, g, strict=True) if not x))
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_suffixes_of_periodic_texts_with_differing_middles(spark):
    r = random.Random(11)
    draw = lambda k: bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz", k=k))
    gram = min((draw(20) for _ in range(50_000)), key=lambda g: int(suffixes.gram_hashes(np.frombuffer(g, np.uint8), 20)[0]))
    row = lambda: gram + draw(5)
    head, tail = row() + row() + row(), row() + row() + gram
    texts = [head + b"".join(row() for _ in range(12)) + tail for _ in range(3)]
    texts.append(texts[0])  # a copy goes as before
    found = suffixes.removals(spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string"))
    want = {k: bytes(b for b, x in zip(s, g, strict=True) if not x) for k, s, g in repeated(list(enumerate(texts)), 50)}
    assert {r["doc_id"]: bytes(r["kept"]) for r in found.collect()} == want
    assert len(want[1]) > 100 and want[3] == b""


@pytest.mark.parametrize("seed", range(5))
def test_refine_orders_equal_strings_together(seed):
    r = np.random.default_rng(seed)
    body = r.integers(97, 99, 3000).astype(np.uint8)
    body[1000:1200] = body[200:400]
    starts = np.arange(len(body) - 49)
    bucket = suffixes.refine(body, starts, 50)
    seen = {}
    for s, b in zip(starts, bucket, strict=True):
        seen.setdefault(body[s : s + 50].tobytes(), set()).add(int(b))
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_simhash(docs):
    prints = {}
    for k, t, *_ in ROWS:
        w = (t or "").encode().lower().split()
        joined = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in joined]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {k: k for k in prints}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (prints[k], find(k)) for k in prints}


@pytest.mark.parametrize("crowded", [False, True])
def test_links_between_planted_fingerprints(spark, crowded):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(3 if crowded else 60)]
    fps = set(base)
    for b in base:
        for _ in range(2000 if crowded else 12):
            fps.add(b ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, 3))}))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(frame, len(fps), per_shard=5_000)
    got = {x["node"] % (1 << 64): x["component"] % (1 << 64) for x in components(edges).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    masks = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    for f in fps:
        for m in masks:
            if f ^ m in parent and find(f) != find(f ^ m):
                parent[find(f)] = find(f ^ m)
    groups, mine = {}, {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_probes_of_a_crowded_bucket_link_within_the_radius_only(spark):
    r = random.Random(6)
    # high halves far apart, so that links are those planted
    table = [k * 0x9E3779B1 % (1 << 32) << 32 for k in range(1, 6001)]
    apart = [f ^ 1 << r.randrange(32) ^ 0b11 << r.randrange(32, 63) for f in table[:50]]  # three bits
    near = [f ^ 1 << r.randrange(32) ^ 1 << r.randrange(32, 64) for f in table[50:100]]  # two bits
    fps = sorted({*table, *apart, *near})
    bits = np.array(fps, np.uint64)
    want = {(f, int(g)) for f in fps for g in bits[np.bitwise_count(bits ^ np.uint64(f)) <= 2] if g != f}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    label = {x["node"] % (1 << 64): x["component"] for x in components(simhash.links(frame, len(fps))).collect()}
    assert all(label.get(f, -1) == label.get(g, -2) for f, g in want)
    linked = {f for f, _ in want}
    assert set(label) == linked and sum(f in linked for f in apart) < 10


def near_groups(rows):
    bags = {k: set(simhash.shingle_hashes(t or "", 5).tolist()) for k, t in rows}
    parent = {k: k for k in bags}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in bags:
        for b in bags:
            both = len(bags[a] & bags[b])
            alike = both >= 0.8 * (len(bags[a]) + len(bags[b]) - both)
            if a < b and alike and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k for k in bags if find(k) == k}


def test_similar_keeps_one(spark, docs):
    r = random.Random(9)
    long_ = " ".join("".join(r.choices("abcdefg", k=5)) for _ in range(300)).split()
    copies = []
    for k in range(120):  # a crowd of near copies
        words = list(long_)
        words[r.randrange(300)] = f"x{k}"
        copies.append((1000 + k, " ".join(words), "en", "src", 0))
    frame = docs.unionByName(spark.createDataFrame(copies, SCHEMA))
    kept = similar.keep_one(frame)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == near_groups([(k, t) for k, t, *_ in ROWS + copies])


def test_similar_links_texts_without_ids(spark):
    words = [f"w{k}" for k in range(200)]
    near = lambda k: " ".join([*words[:k], f"x{k}", *words[k + 1 :]])
    rows = [(None, near(20)), (None, near(90)), (None, near(150)), (None, "quite another text of some words")]
    kept = lambda r: similar.keep_one(spark.createDataFrame(r, "doc_id long, text string")).collect()
    assert len(kept(rows)) == 2
    got = kept([*rows, (7, near(60)), (9, near(120))])  # documents without an id come last
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, rows[3][1]), (7, near(60))]


def test_tokens_and_packing(docs):
    enc = encoder(default_vocabulary())
    ids = {k: np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t, *_ in ROWS}
    want, at = [], 0
    for k in sorted(ids):
        want.append((k, at, len(ids[k]), zlib.crc32(ids[k].tobytes())))
        at += len(ids[k])
    got = sorted(tuple(r) for r in tokenfiles.read_tokens(tokenfiles.write_tokens(docs)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want
    pieces = packing.pack(docs, length=64, windows=4).collect()
    upto, rooms = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["start"] == upto[p["doc_id"]] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert len(part) == p["length"] > 0 and zlib.crc32(part.tobytes()) == p["ids_crc32"]
        upto[p["doc_id"]] += p["length"]
        rooms.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(upto[k] == len(v) for k, v in ids.items())
    padding = 0
    for room in rooms.values():
        end = 0
        for offset, length in sorted(room):
            assert offset == end
            end += length
        assert end <= 64
        padding += 64 - end if end & (end - 1) else 0
    assert padding < 0.06 * at


def test_pieces_are_those_of_whole_texts():
    enc = encoder(default_vocabulary())
    awkward = ["", "  a  b\n\n c", " don't 's ’s x", "a \n b\t c  ", "　 x　y", "<|endoftext|> hi", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>b c", "wo<|endoftext|>rd  <|endoftext|>\n", "日本 語  テキスト", "🙂 🙂🙂  x", "\r\n\r\n a", "a\x85 b", "\x1c \x1cq", "١٢ Ⅷ ½ x²", " ", "\n", "it's we'll 'd", "end. (so) [x] {y} a|b !", "word word. word, wordé é. 'quoted' é"]
    r = random.Random(2)
    signs = [" ", "  ", "\n", "a", "é", "ß", ".", ",", "'", "s", "1", "²", "🙂", "\t", "|", "<", "ll"]
    awkward += ["".join(r.choices(signs, k=r.randint(1, 30))) for _ in range(2000)]
    for _ in range(2):
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(awkward)]
        assert got == [e.ids for e in Tokenizer.from_file(default_vocabulary()).encode_batch(awkward, add_special_tokens=False)]


def test_quality_counts(docs):
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    for k, t, *_ in ROWS:
        w = WORDS.findall(t or "")
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(triples)
        covered = {i + j for i, x in enumerate(triples) if times[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == {k for k, r in got.items() if r["kept"]}


@pytest.mark.parametrize("shard_rows, query_rows", [(10_000, 4096), (37, 5), (150, 7)])
def test_top_k(spark, shard_rows, query_rows, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 16)
    r = np.random.default_rng(4)
    vectors = [(k, r.normal(size=8).astype(float).tolist()) for k in range(300)]
    vectors += [(k, vectors[0][1]) for k in range(300, 420)]  # one vector very often: ties go to the smaller id
    vectors += [(500, None), (501, [1.0, float("nan")]), (502, [float("inf")]), (503, [0.5]), (503, [0.5])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for x in topk.top_k(topk.usable(frame), "vec_id % 25 = 0", 5, shard_rows, query_rows).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    good = [(k, [math.floor(256 * c) for c in v]) for k, v in vectors if v and all(map(math.isfinite, v))]
    for q, v in good:
        if q % 25 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), k) for k, w in good if k != q)[:5]
            assert [got[q][i + 1] for i in range(5)] == [(k, -s) for s, k in scored]


def test_top_k_of_unbounded_integers(spark):
    r = random.Random(8)
    vectors = [(k, [r.uniform(-9, 9) for _ in range(4)]) for k in range(60)]
    vectors += [(100, [1e30, 1.0, 0.0, 0.0]), (101, [1e30, 1.0, 0.0, 0.0]), (102, [-1e30, 2.5, 1.0, 0.0]), (103, [1e308, 0.0, 0.0, 0.0]), (104, [3e7, -1.5, 0.0, 2.0]), (150, [2e300, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for x in topk.top_k(topk.usable(frame), "vec_id % 25 = 0 OR vec_id = 104", 5, 20, 2).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    whole = [(k, [math.floor(256 * c) if abs(c) < 1e15 else int(c) * 256 for c in v]) for k, v in vectors]
    for q, v in whole:
        if q % 25 == 0 or q == 104:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w in whole if k != q)[:5]
            assert [got[q][i + 1] for i in range(5)] == [(k, max(-(2**63), min(2**63 - 1, -s))) for s, k in scored]


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    tokens, of = {}, {}
    for k, t, _, source, _ in ROWS:
        tokens[k], of[k] = len(WORDS.findall(t or "")) + 1, source
    whole, used, times = Counter(), Counter(), Counter()
    for k, n in tokens.items():
        whole[of[k]] += n
    for r in rows:
        used[r["source"]] += r["_tokens"]
        times[r["doc_id"], r["_epoch"]] += 1
    assert set(times.values()) == {1} and {k for k, _ in times} == set(tokens)
    passes = {s: used[s] / whole[s] for s in whole}
    assert min(passes.values()) >= 1 and max(passes.values()) <= 2.0001
    weights = {s: v for s, v in whole.items()}
    assert sorted(passes, key=passes.get) == sorted(weights, key=lambda s: -weights[s]) or len(set(passes.values())) < len(passes)


def test_mixing_budget_and_entropy(docs):
    some = mixing.mix(docs, budget=2000, repetitions=None, entropy=0.9).collect()
    assert sum(r["_tokens"] for r in some) <= 2000
    assert len({(r["doc_id"], r["_epoch"]) for r in some}) == len(some)


def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = ["[INST", "[/INST]", "<s>", "</s>", "\\", "]", "[", "a", " ", "<", "\n", "INST", "/", "[INST ", "é"]
    for _ in range(5000):
        role = "".join(r.choices(bits, k=r.randint(0, 4))) if r.random() < 0.5 else "assistant"
        text = "".join(r.choices(bits, k=r.randint(0, 8)))
        first, _ = chat.render(role, text)
        second, _ = chat.render("assistant", text)
        assert [x[:2] for x in chat.parse(first + second)] == [(role, text), ("assistant", text)]
    with pytest.raises(ValueError):
        chat.parse("[INST user]open")
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, None, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.digests(chat.format_turns(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == sha(rows[1][3]) and got[1]["loss_chars"] == len(rows[1][3])
    assert got[1]["turns_sha256"] == sha("user\nhi\nassistant\n\nassistant\n</s>[INST] ok [/INST]\n")
    assert got[None]["turns_sha256"] == sha("\nx\n") and got[2]["n_turns"] == 1


def test_gradients():
    m = Model(4, 2, 3, hidden=3, seed=1)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64) * 3
    inputs, targets = np.array([[0, 5], [1, 2], [6, 3]]), np.array([[1, 2], [6, 3], [4, 0]])
    h0 = np.zeros((2, 3))

    def loss():
        h, out = h0, []
        for ids in inputs:
            h, *_ = m.step(ids, h)
            out.append(h)
        return -m.outputs(np.concatenate(out), targets.ravel())[0].mean()

    before = {k: v.copy() for k, v in m.p.items()}
    t = Trainer(m, 1.0)
    t.seen = {k: np.full_like(v, 1e-30) for k, v in m.p.items()}
    t.window(inputs, targets, h0)
    slopes = {k: np.sqrt(t.seen[k]) * np.sign(before[k] - m.p[k]) for k in m.p}
    m.p = before
    for k, v in m.p.items():
        for at in list(np.ndindex(v.shape))[:40]:
            keep = v[at]
            v[at] = keep + 1e-5
            up = loss()
            v[at] = keep - 1e-5
            down = loss()
            v[at] = keep
            assert slopes[k][at] == pytest.approx((up - down) / 2e-5, abs=2e-4), (k, at)


def test_likelihood_does_not_depend_on_company():
    m, r = Model(64, 32, 5, seed=2), np.random.default_rng(0)
    sequences = [r.integers(0, 69, n) for n in (1, 300, 7, 40)]
    together = log_likelihood(m, sequences, 0, cells=8)
    alone = [log_likelihood(m, [s], 0)[0] for s in sequences]
    assert np.allclose(together, alone, rtol=1e-4)
    one = [log_likelihood(m, [np.array([k])], 0)[0] for k in range(69)]
    assert sum(np.exp(one)) == pytest.approx(1, abs=1e-4)


def test_scoring(docs):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = {k: [*WORDS.findall((t or "").translate(lower)), None] for k, t, *_ in ROWS}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in scoring.score(docs).collect():
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert -20 * len(ws) < r["score"] < 0


def test_training_sees_every_token_of_training_documents():
    docs = [np.full(n, 1 + k) for k, n in enumerate((1, 5, 33, 127, 128, 129, 700, 40, 64, 2))]
    meta = np.array([(k, len(d), 0) for k, d in enumerate(docs)], "<i8")
    row = {"meta": meta.tobytes(), "ids": zstandard.compress(np.concatenate(docs).astype("<u2").tobytes())}
    trainer, seen, real = Trainer(Model(64, 8, 5, hidden=8)), Counter(), Model.outputs

    def outputs(states, targets, *more):
        seen.update(targets.tolist())
        return real(trainer.model, states, targets, *more)

    trainer.model.outputs = outputs
    want = {1 + k: len(d) for k, d in enumerate(docs) if not scoring.held_out(k)}
    assert scoring._train_block(trainer, row) == sum(want.values())
    assert seen == want


def test_masked_places_do_not_teach():
    r = np.random.default_rng(2)
    inputs, targets = r.integers(0, 69, (2, 6, 3))
    inside = np.arange(6)[:, None] < np.array([6, 6, 2])
    models = []
    for filler in (0, 7):
        trainer = Trainer(Model(64, 8, 5, hidden=8))
        ends = [np.where(inside, x, filler) for x in (inputs, targets)]
        trainer.window(*ends, np.zeros((3, 8), np.float32), inside=inside)
        models.append(trainer.model.flat())
    assert np.array_equal(*models)


def test_documents_in_one_lane_teach_as_they_do_in_lanes_of_their_own():
    r = np.random.default_rng(3)
    inputs, targets = r.integers(0, 69, (2, 12, 1))
    begins = np.zeros((12, 1), bool)
    begins[[0, 7]] = True
    apart = [np.zeros((7, 2), np.int64) for _ in range(2)]
    for whole, two in zip((inputs, targets), apart, strict=True):
        two[:, 0], two[:5, 1] = whole[:7, 0], whole[7:, 0]
    models = []
    for ends, more, n in (((inputs, targets), {"starts": begins}, 1), (apart, {"inside": np.arange(7)[:, None] < np.array([7, 5])}, 2)):
        trainer = Trainer(Model(64, 8, 5, hidden=8))
        trainer.window(*ends, np.ones((n, 8), np.float32) * (n == 1), **more)  # what was before a start does not matter
        models.append(trainer.model.flat())
    assert np.allclose(*models, atol=1e-5)


def test_model_beats_counts_on_held_out_documents(spark):
    rows = scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


OPERATORS = {
    "tokens": lambda d: tokenfiles.read_tokens(tokenfiles.write_tokens(d)),
    "scoring": scoring.score,
    "windows": windows.removals,
    "packing": packing.pack,
    "suffixes": suffixes.removals,
    "suffix text": suffixes.dedup_text,
    "quality": quality.assess,
    "mixing": mixing.mix,
    "simhash": simhash.near_duplicates,
    "similar": similar.keep_one,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    text = "one two three four five six seven " * 30
    rows = [(1, text, None), (1, text, None), (2, text, "s"), (None, text, "s"), (None, None, None), (3, "", "s"), (3, "x", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for clash in ("fp", "kept", "block", "n_words", "ref", "_t", "label", "tokens", "size", "s"):
        frame = frame.withColumn(clash, frame["source"])
    out = OPERATORS[name](frame)
    got = out.collect()
    assert len(out.columns) >= 3
    if name == "similar":
        assert sorted(r["text"] or "" for r in got) == sorted(["", "x", text])
    elif name not in ("packing", "mixing"):
        assert len(got) == len(rows)


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.usable(empty), "vec_id % 50 = 0").collect() == []
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    from pennyweight.llm.oracles import ORACLES

    df = queries.QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, duck(SF), ORACLES[name])
    else:
        assert df.count() > 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(common.materialise(stage(spark, seen[-1], SF)))
    for after in seen[1:-1]:
        assert after.columns == docs.columns
    passed = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    assert {r["doc_id"] for r in seen[2].collect()} == near_groups(passed)
    before = sorted((r["doc_id"], r["text"].encode()) for r in seen[2].collect())
    want = {k: bytes(b for b, x in zip(s, g, strict=True) if not x).decode(errors="ignore") for k, s, g in repeated(before, 50)}
    assert {r["doc_id"]: r["text"] for r in seen[3].collect()} == want
    assert {r["doc_id"] for r in seen[4].collect()} == set(want)
    pieces = seen[5].groupBy("doc_id").agg({"length": "sum"}).count()
    assert pieces == len(want)
