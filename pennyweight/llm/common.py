"""What the operators share: the shared folder, materialised steps, packed columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Folders of steps that are still there, in the order in which they were made.
_standing: list[str] = []
#: Tables that a process keeps from task to task, by name, until tasks of other operators run in it.
remembered: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder, seen by all executors, that goes when the session ends.

    It lies below ``spark.checkpoint.dir``; only where that is unset (tests
    on one machine) a temporary folder is set for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/pennyweight-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    _standing.append(path)
    return path


def made_since(mark: int) -> list[str]:
    """Folders made since there were ``mark`` of them (``len(made_since(0))`` is where one stands)."""
    return _standing[mark:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of steps that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        target = hadoop.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in _standing:
            _standing.remove(path)


def settled(make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """What ``make`` gives, written; whatever was written on the way to it goes."""
    mark = len(_standing)
    out = materialise(make(), name)
    delete(out.sparkSession, _standing[mark:-1])
    return out


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null becomes empty), plus other columns by name."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, counted over the whole table."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def release(forget: bool = True) -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive tasks.

    So do the tables that are remembered; only operators that use them go without ``forget``.
    """
    if forget:
        remembered.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Of glibc's ``mallopt``: what freed memory stays, what is asked for in advance, and from which size arrays get pages of their own.
_TRIM, _PAD, _MAP = -1, -2, -3


@contextmanager
def holding() -> Iterator[None]:
    """Meanwhile freed memory stays with the process: arrays made again and again get pages that are there already."""
    tune = getattr(ctypes.CDLL(None), "mallopt", lambda what, size: None)
    for what, size in ((_MAP, 16 << 20), (_TRIM, 128 << 20), (_PAD, 16 << 20)):
        tune(what, size)
    try:
        yield
    finally:
        for what, size in ((_MAP, 4 << 20), (_TRIM, 8 << 20), (_PAD, 0)):
            tune(what, size)
        release()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads near values apart."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack_uint(values: np.ndarray) -> bytes:
    """Unsigned integers as one width byte and that many bytes each."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + np.ascontiguousarray(raw[:, :width]).tobytes()


def unpack_uint(packed: bytes) -> np.ndarray:
    """The inverse of :func:`pack_uint`, as unsigned 64-bit integers."""
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)`` for each pair."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts.astype(np.int64), lengths)
