"""Token files: flat unsigned integers and 64-bit offsets, memory-mapped.

Documents are dealt by ranges of ``doc_id``.  Each task encodes its range
and writes three files to the shared folder: the identifiers (16 bits
where the vocabulary allows), ``n + 1`` offsets of 64 bits and the
document ids.  What a task wrote counts only if its row is in the
manifest; a task that is run again writes under a new name.  The base of
each part is the prefix sum of the parts before it, over the manifest.

Defined results: a null or empty text holds only the end id; repeated
``doc_id`` values lie together, in order of text; a null ``doc_id`` comes
first and comes back null; an empty table gives no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, release, shared_dir, texts
from .encoding import default_vocabulary, encoder

END_ID = 0
#: Stands for a null doc_id in the file of ids.
NO_ID = np.iinfo(np.int64).min
#: Documents taken together, and those encoded in one call.
TOGETHER = 256
ENCODED = 2048


def slices(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files; the manifest has a row for each part, with its base and paths."""
    vocabulary = vocabulary or default_vocabulary()
    folder = f"{shared_dir(docs.sparkSession)}/tokens"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(forget=False)
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"{folder}/{uuid.uuid4().hex}"
        fs, path = pafs.FileSystem.from_uri(name)
        fs.create_dir(path, recursive=True)
        at, n = 0, 0
        with fs.open_output_stream(f"{path}/ids.bin") as ids, fs.open_output_stream(f"{path}/offsets.bin") as offsets, fs.open_output_stream(f"{path}/docs.bin") as who:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in slices(batches, ENCODED):
                coded = enc.encode(batch.column(1))
                sizes = np.array([len(x) // enc.dtype.itemsize + 1 for x in coded], np.uint64)
                for x in coded:
                    ids.write(x + end)
                offsets.write((np.uint64(at) + np.cumsum(sizes)).astype("<u8").tobytes())
                who.write(batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                at, n = at + int(sizes.sum()), n + len(coded)
        if n:
            row = {"part": TaskContext.get().partitionId(), "n_docs": n, "n_ids": at, "width": enc.dtype.itemsize, "path": name}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("path", pa.string())]))

    spread = texts(docs).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    manifest = materialise(spread.mapInArrow(write, "part long, n_docs long, n_ids long, width int, path string"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part only
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def open_array(name: str, dtype: str | np.dtype) -> np.ndarray:
    """A file of the shared folder as an array: memory-mapped where it is mounted."""
    fs, path = pafs.FileSystem.from_uri(name)
    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = open_array(f"{part['path']}/ids.bin", f"<u{part['width']}")
                offsets = open_array(f"{part['path']}/offsets.bin", "<u8").astype(np.int64)
                who = np.array(open_array(f"{part['path']}/docs.bin", "<i8"))
                if len(offsets) != part["n_docs"] + 1 or offsets[-1] != part["n_ids"] or len(ids) != part["n_ids"]:
                    raise ValueError(f"{part['path']}: the files do not fit the manifest")
                for k in range(0, len(who), 4096):
                    cuts = offsets[k : k + 4097]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(who[k : k + 4096], mask=who[k : k + 4096] == NO_ID),
                            pa.array(cuts[:-1] + part["base"]),
                            pa.array(np.diff(cuts)),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # a task for each part: without the number, so few small rows would end in one task
    spread = manifest.repartition(max(1, manifest.count()), F.col("part"))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
