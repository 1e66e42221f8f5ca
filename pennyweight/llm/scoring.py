"""Scoring documents with a language model learnt from the training part of the corpus.

1.  Every block of documents is written as numbers of its distinct words,
    and sends these, with their counts in its training documents, to
    shards of the word space.  The shards
    add up and answer each block, and report totals, their most frequent
    words, and counts by word ending.
2.  The most frequent words are outputs of the model, and so are endings,
    which stand for all other words; the softmax factors both into classes
    of 32.  A word of an ending has the share ``c + 0.5`` of that ending's
    counts, with half a count for unknown words.
3.  Each task trains the recurrent model on its blocks, from a start
    trained on a few blocks, and the results are averaged by tokens.
    Training looks at every token of every training document, in windows;
    states are carried from window to window to the document's end.
4.  Every document is scored as a whole, state carried to its end.

Defined results: a null text has the end token only; a null ``doc_id`` has
the empty text for its checksum; repeated rows are documents of their own;
without training documents all counts are zero, and the model untrained;
an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import holding, input_bytes, materialise, pack_uint, unpack_uint
from .gru import WINDOW, Model, Trainer, log_likelihood

BLOCK_BYTES = 12 << 20
#: Head words, outputs to a class, and kinds of other words by their last two bytes (one more for the rest).
HEAD, PER_CLASS, ENDINGS = 1024, 32, 95
#: Documents that run side by side in training.
LANES = 256
#: Blocks for the common start, which looks at one of their documents in so many; the pass after it takes all.
START_BLOCKS, START_STRIDE = 2, 4
CHUNKS = 64

_NUMBERED = "block long, doc_ids binary, sizes binary, ends long, words binary, counts binary, ids binary"
_ASK = "shard long, block long, words binary, counts binary"
_TOLD = "kind string, block long, shard long, answer binary, word binary, n long, mass double"
_CODED = "block long, meta binary, base binary, fixed binary, ids binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _trains(block: B.Block) -> np.ndarray:
    return np.array([not held_out(None if k == B.NO_ID else int(k)) for k in block.doc_ids], bool)


def _numbered(block: B.Block) -> tuple[list[bytes], list[np.ndarray]]:
    """The block's distinct words, and its documents as numbers of them, in the order in which words first come."""
    body = block.body + ((block.body - np.uint8(65) < 26).view(np.uint8) << 5)  # A-Z in lower case
    inside = (body - np.uint8(9) > 4) & (body != 32)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    opens = block.starts[:-1][np.diff(block.starts) > 0]
    begins[opens] = inside[opens]  # no word goes on from one document to the next
    ends[:-1] &= ~inside[1:] | begins[1:]
    first = np.flatnonzero(begins)
    offsets = np.r_[0, np.cumsum(np.flatnonzero(ends) + 1 - first)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body[inside])]).dictionary_encode()
    return words.dictionary.to_pylist(), np.split(words.indices.to_numpy(), np.searchsorted(first, block.starts[1:-1])) if len(block.doc_ids) else []


def _shards_of(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 5) % shards for w in words), np.int64, len(words))


def _ending(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


def _endings(words: pa.Array) -> np.ndarray:
    """:func:`_ending` of each of some words, none of them empty."""
    offsets, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last = data[offsets[1:] - 1].astype(np.int64)
    return np.where(np.diff(offsets) > 1, data[offsets[1:] - 2].astype(np.int64) << 8, 0) | last


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block as its distinct words, their counts in its training documents, and its documents as numbers of words."""
    for block in B.each_block(batches):
        words, docs = _numbered(block)
        trained = [ids for ids, trains in zip(docs, _trains(block), strict=True) if trains]
        counts = np.bincount(np.concatenate(trained), minlength=len(words)) if trained else np.zeros(len(words), np.int64)
        ids = np.concatenate(docs).astype("<u4") if docs else np.zeros(0, "<u4")
        row = {
            "block": block.number,
            "doc_ids": block.doc_ids.astype("<i8").tobytes(),
            "sizes": np.array([len(d) for d in docs], "<i8").tobytes(),
            "ends": len(trained),
            "words": zstandard.compress(b"\n".join(words), 1),
            "counts": pack_uint(counts.astype(np.uint64)),
            "ids": zstandard.compress(ids.tobytes(), 1),
        }
        yield B.messages([row], _NUMBERED)


def _words(packed: bytes) -> list[bytes]:
    joined = zstandard.decompress(packed)
    return joined.split(b"\n") if joined else []


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                words, counts = _words(block["words"]), unpack_uint(block["counts"])
                rows = [{"shard": -1, "block": block["block"], "words": b"", "counts": pack_uint(np.array([block["ends"]], np.uint64))}]
                for shard, at in B.by_shard(_shards_of(words, shards), shards):
                    rows.append({"shard": shard, "block": block["block"], "words": b"\n".join([words[k] for k in at]), "counts": pack_uint(counts[at])})
                yield B.messages(rows, _ASK)

    return run


def _tell(key: tuple, table: pa.Table) -> pa.Table:
    rows, out = table.to_pylist(), []
    row = lambda **x: out.append({"kind": None, "block": None, "shard": key[0].as_py(), "answer": None, "word": None, "n": None, "mass": None} | x)
    if key[0].as_py() == -1:
        row(kind="ends", n=int(sum(unpack_uint(r["counts"])[0] for r in rows)))
    else:
        lists = pc.split_pattern(pa.array([r["words"] for r in rows], pa.large_binary()), b"\n")
        found = lists.flatten().dictionary_encode()
        words, which = found.dictionary, found.indices.to_numpy()
        # sums of integers, exact in doubles up to 2**53
        total = np.bincount(which, weights=np.concatenate([unpack_uint(r["counts"]) for r in rows]), minlength=len(words)).astype(np.int64)
        for r, mine in zip(rows, np.split(which, np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]), strict=True):
            row(kind="reply", block=r["block"], answer=zstandard.compress(pack_uint(total[mine].astype(np.uint64)), 1))
        known = np.flatnonzero(total)
        row(kind="total", n=int(total.sum()), mass=float(len(known)))
        least = np.partition(total[known], -(HEAD - 1))[-(HEAD - 1)] if len(known) >= HEAD else 1
        often = np.flatnonzero(total >= least)
        for n, w in heapq.nsmallest(HEAD - 1, zip((-total[often]).tolist(), words.take(pa.array(often)).to_pylist(), strict=True)):
            row(kind="word", word=w, n=-n)
        ends = _endings(words)[known]
        n, mass = (np.bincount(ends, weights=x) for x in (total[known], total[known] + 0.5))
        for e in np.flatnonzero(n).tolist():
            row(kind="ending", word=e.to_bytes(2, "big"), n=int(n[e]), mass=float(mass[e]))
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.Table.from_pylist(out, pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _TOLD.split(", "))]))


class Lexicon:
    """What all tasks know: totals, head words and the classes of endings; its size is fixed."""

    def __init__(self, told: DataFrame):
        sums = {r["kind"]: (r["n"] or 0, r["mass"] or 0.0) for r in told.where("kind IN ('ends', 'total')").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect()}
        self.end_count = int(sums.get("ends", (0, 0))[0])
        self.tokens = int(sums.get("total", (0, 0))[0]) + self.end_count
        self.types = int(sums.get("total", (0, 0.0))[1]) + (self.end_count > 0)
        head = told.where("kind = 'word'").orderBy(F.desc("n"), "word").select("word", "n").limit(HEAD - 1).collect()
        # two bytes, so 65,536 rows at most
        ends = told.where("kind = 'ending'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect()
        n = {int.from_bytes(r["word"], "big"): r["n"] for r in ends}
        mass = {int.from_bytes(r["word"], "big"): r["mass"] for r in ends}
        self.head = {bytes(r["word"]): k + 1 for k, r in enumerate(head)}  # 0 is the end
        for r in head:
            e = _ending(bytes(r["word"]))
            n[e] -= r["n"]
            mass[e] -= r["n"] + 0.5
        common = sorted(n, key=lambda e: (-n[e], e))[:ENDINGS]
        self.ending = {e: HEAD + 1 + k for k, e in enumerate(common)}
        rest = np.full(ENDINGS + 1, 0.5)  # half a count for words that training has not seen
        rest_n = np.zeros(ENDINGS + 1)
        for e in n:
            k = self.ending.get(e, HEAD) - HEAD
            rest[k] += max(0.0, mass[e])
            rest_n[k] += max(0, n[e])
        self.rest_mass = rest
        counts = np.zeros(HEAD + ENDINGS + 1)
        counts[0] = self.end_count
        for k, r in enumerate(head):
            counts[k + 1] = r["n"]
        counts[HEAD:] = rest_n
        self.bias = np.log(counts + 0.5)

    def model(self, flat: np.ndarray | None = None) -> Model:
        model = Model(HEAD + ENDINGS + 1, PER_CLASS, 0, bias=self.bias)
        return model if flat is None else model.load(flat)


def _code(lexicon: Lexicon, shards: int):
    low = np.log10(lexicon.tokens + 0.5 * (lexicon.types + 1))

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        got, out = {r["shard"]: r["answer"] for r in replies.to_pylist()}, []
        for block in blocks.to_pylist():
            words, sizes = _words(block["words"]), np.frombuffer(block["sizes"], "<i8")
            ids = np.frombuffer(zstandard.decompress(block["ids"]), "<u4").astype(np.int64)
            split = lambda of: np.split(of[ids], np.cumsum(sizes)[:-1]) if len(sizes) else []  # noqa: E731, B023
            counts = np.zeros(len(words))
            for shard, at in B.by_shard(_shards_of(words, shards), shards):
                counts[at] = unpack_uint(zstandard.decompress(got[shard]))
            base = np.log10(counts + 0.5) - low
            code = np.fromiter((lexicon.head.get(w) or lexicon.ending.get(_ending(w), HEAD) for w in words), np.int64, len(words))
            rare = code >= HEAD
            fixed = np.where(rare, np.log10(counts + 0.5) - np.log10(lexicon.rest_mass[np.maximum(code - HEAD, 0)]), 0.0)
            end = np.log10(lexicon.end_count + 0.5) - low
            known = np.array([np.count_nonzero(x) for x in split(counts > 0)], "<i8") + (lexicon.end_count > 0)
            coded = np.zeros(len(ids) + len(sizes), "<u2")  # an end, which is 0, after each document
            coded[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = code.astype("<u2")[ids]
            out.append(
                {
                    "block": block["block"],
                    "meta": np.column_stack([np.frombuffer(block["doc_ids"], "<i8"), sizes + 1, known]).astype("<i8").tobytes(),
                    "base": np.array([x.sum() + end for x in split(base)], "<f8").tobytes(),
                    "fixed": np.array([x.sum() for x in split(fixed)], "<f8").tobytes(),
                    "ids": zstandard.compress(coded.tobytes(), 3),
                }
            )
        kinds = [("block", pa.int64()), *((c, pa.binary()) for c in ("meta", "base", "fixed", "ids"))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return run


def _opened(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    meta = np.frombuffer(row["meta"], "<i8").reshape(-1, 3)
    ids = np.frombuffer(zstandard.decompress(row["ids"]), "<u2").astype(np.int64)
    return meta, np.split(ids, np.cumsum(meta[:, 1])[:-1])


def _lanes(row: dict, stride: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The block's training documents (one in ``stride``) dealt to lanes, end to end: targets, and where documents start.

    The longest go first, each to the shortest lane, so lanes are about equally long; the longest lane comes first.
    """
    meta, docs = _opened(row)
    mine = [ids for k, ids in enumerate(docs) if not held_out(None if meta[k, 0] == B.NO_ID else int(meta[k, 0]))]
    mine = [d for d in mine if zlib.crc32(d.tobytes()) % stride == 0]
    mine.sort(key=lambda d: (-len(d), zlib.crc32(d.tobytes())))
    heap = [(0, k) for k in range(min(LANES, len(mine)))]
    held: list[list[np.ndarray]] = [[] for _ in heap]
    for d in mine:
        size, k = heapq.heappop(heap)
        held[k].append(d)
        heapq.heappush(heap, (size + len(d), k))
    held.sort(key=lambda lane: -sum(map(len, lane)))
    # a lane would open with its longest document; turned about, what is rare stands anywhere
    held = [lane[k % len(lane) :] + lane[: k % len(lane)] for k, lane in enumerate(held)]
    starts = [np.concatenate([np.arange(len(d)) == 0 for d in lane]) for lane in held]
    return [np.concatenate(lane) for lane in held], starts


def _train_block(trainer: Trainer, row: dict, stride: int = 1) -> int:
    """Train on every token of the block's documents, states carried to the end of each; the tokens looked at."""
    lanes, starts = _lanes(row, stride)
    if not lanes:
        return 0
    sizes = np.array([len(x) for x in lanes])
    first = np.cumsum(sizes) - sizes
    ids, fresh = np.concatenate(lanes), np.concatenate(starts)
    del lanes, starts
    before = np.r_[0, ids[:-1]]
    before[fresh] = 0  # what stands before a document is an end
    h = np.zeros((len(sizes), trainer.model.hidden), np.float32)
    for t in range(0, int(sizes[0]), WINDOW):
        n = int((sizes > t).sum())  # lanes that have not ended stand first
        # a window is gathered when its turn comes: memory goes by tokens, not by the longest lane
        rows = t + np.arange(min(WINDOW, int(sizes[0]) - t))[:, None]
        inside = rows < sizes[:n]
        at = np.where(inside, first[:n] + rows, 0)
        cut = lambda of: np.where(inside, of[at], 0)  # noqa: E731, B023
        h, _ = trainer.window(cut(before), cut(ids), h[:n], cut(fresh).astype(bool), inside)
    return int(sizes.sum())


def train(coded: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """The parameters, trained on all tokens of all blocks; tasks start alike and are averaged by tokens."""
    spark = coded.sparkSession

    def fit(start: np.ndarray | None, stride: int, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, seen = Trainer(lexicon.model(start), rate, LANES * WINDOW), 0
            with holding():
                for batch in batches:
                    for k in range(batch.num_rows):
                        seen += _train_block(trainer, batch.slice(k, 1).to_pylist()[0], stride)
            if seen:
                parts = [x.astype("<f4").tobytes() for x in np.array_split(trainer.model.flat(), CHUNKS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary()), pa.array([float(seen)] * CHUNKS)], ["chunk", "part", "weight"])

        return run

    def average(key: tuple, table: pa.Table) -> pa.Table:
        weights = table.column("weight").to_numpy()
        mean = sum(w * np.frombuffer(p.as_py(), "<f4").astype(np.float64) for w, p in zip(weights, table.column("part"), strict=True)) / weights.sum()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([mean.astype("<f4").tobytes()], pa.binary())})

    def round_(rows: DataFrame, start: np.ndarray | None, stride: int, rate: float) -> np.ndarray | None:
        parts = rows.mapInArrow(fit(start, stride, rate), "chunk int, part binary, weight double")
        done = parts.groupBy("chunk").applyInArrow(average, "chunk int, part binary").collect()  # as large as the model
        return np.concatenate([np.frombuffer(r["part"], "<f4") for r in sorted(done, key=lambda r: r["chunk"])]) if done else start

    del spark
    first = coded.orderBy("block").limit(START_BLOCKS).coalesce(1)
    start = round_(first, None, START_STRIDE, 0.1)
    return round_(coded, start, 1, 0.05) if start is not None else lexicon.model().flat()


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` and ``train_tokens``."""
    blocks, total = B.write_blocks(docs, block_bytes=max(BLOCK_BYTES, B.sizes_for(input_bytes(docs))[0]))
    shards = B.shards_for(total)
    numbered = materialise(blocks.mapInArrow(_number, _NUMBERED), "numbered")
    asked = numbered.select("block", "ends", "words", "counts").mapInArrow(_ask(shards), _ASK)
    told = materialise(asked.groupBy("shard").applyInArrow(_tell, _TOLD), "told")
    lexicon = Lexicon(told)
    replies = told.where("kind = 'reply'").select("block", "shard", "answer")
    coded = materialise(numbered.select("block", "doc_ids", "sizes", "words", "ids").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_code(lexicon, shards), _CODED), "coded")
    flat = train(coded, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lexicon.model(flat)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                meta, ids = _opened(row)
                with holding():
                    found = log_likelihood(model, ids, 0) / np.log(10) + np.frombuffer(row["fixed"])
                who = meta[:, 0]
                out = [held_out(None if i == B.NO_ID else int(i)) for i in who]
                columns = [pa.array(who, mask=who == B.NO_ID), pa.array(out), pa.array(meta[:, 1]), pa.array(meta[:, 2]), pa.array(np.frombuffer(row["base"])), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return coded.mapInArrow(run, OUT).withColumn("train_tokens", F.lit(lexicon.tokens).cast("long"))
