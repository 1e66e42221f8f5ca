"""A store of vectors kept up to date with its documents, in bounded batches, resumable at each.

The store is a log: every batch is a folder of rows ``id, hash, vector,
deleted`` that counts once Spark has marked it as whole.  What the store
holds is the last row of each id, unless that is a tombstone.  A run
compares content hashes with what is held, so after a failure the next
run does only what is left, and a run without changes writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import once
from ..operators.lineage import cut

#: Rows of a batch, about: ids are dealt by a hash.
BATCH_ROWS = 1_000_000


class VectorStore:
    """Vectors by id below a folder; ``schema`` is that of ``id`` and ``vector``."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "id long, vector array<double>"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"{schema}, hash string, deleted boolean"

    def batches(self) -> list[int]:
        """The numbers of the batches that are whole."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n.startswith("b") and n[1:].isdigit() and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def _folder(self, number: int) -> str:
        return f"{self.path}/b{number:012d}"

    def held(self) -> DataFrame:
        """``id, hash, vector`` of what the store holds."""
        numbers = self.batches()
        rows = self.spark.createDataFrame([], self.schema).withColumn("_batch", F.lit(0).cast("long"))
        if numbers:
            found = self.spark.read.schema(self.schema).parquet(*map(self._folder, numbers))
            rows = found.withColumn("_batch", F.regexp_extract(F.input_file_name(), r"/b(\d{12})/", 1).cast("long"))
        last = rows.groupBy("id").agg(F.max_by(F.struct("hash", "vector", "deleted"), "_batch").alias("last"))
        return last.where("NOT last.deleted").select("id", "last.hash", "last.vector")

    def _append(self, rows: DataFrame) -> None:
        number = (self.batches() or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(self._folder(number))

    def sync(self, wanted: DataFrame, embed: Callable[[DataFrame], DataFrame], batch_rows: int = BATCH_ROWS, most: int | None = None) -> dict[str, int]:
        """Bring the store to ``wanted`` (``id, hash`` and what ``embed`` needs to add ``vector``); what was written.

        ``most`` refuses a run that would embed more.  Tombstones go first,
        then changed documents, batch by batch.
        """
        plan = cut(once.sync_plan(self.held().select("id", "hash"), wanted.select("id", "hash"), "id", "hash"))
        counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        changed, gone = counts.get("insert", 0) + counts.get("update", 0), counts.get("delete", 0)
        if most is not None and changed > most:
            raise ValueError(f"{changed} documents to embed; at most {most} are allowed")
        if gone:
            empty = self.held().limit(0).select("vector")
            self._append(plan.where("action = 'delete'").select("id").join(empty, F.lit(False), "left").select("id", "vector", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("deleted")))
        many = -(-changed // batch_rows)
        due = plan.where("action <> 'delete'").select("id", F.pmod(F.xxhash64("id"), F.lit(max(1, many))).alias("_batch"))
        for k in range(many):
            rows = wanted.join(due.where(F.col("_batch") == k).select("id"), "id", "left_semi")
            self._append(embed(rows).select("id", "vector", "hash", F.lit(False).alias("deleted")))
        return {"embedded": changed, "deleted": gone, "batches": many + (gone > 0)}

    def compact(self) -> None:
        """Write what is held as one batch that replaces those before it."""
        numbers = self.batches()
        if len(numbers) < 2:
            return
        self._append(self.held().select("id", "vector", "hash", F.lit(False).alias("deleted")))
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for n in numbers:
            folder = hadoop.Path(self._folder(n))
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
