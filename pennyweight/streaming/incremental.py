"""The ledger as a stream (an extension: the batch is the reference for its results).

New lines arrive as files; late ones are bounded by a watermark on their
date, repeats of an id are dropped within it, and each batch is applied to
the stored table as a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_lines(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_each(lines: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each id once, as long as its repeats come within the watermark."""
    return lines.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def by_window(lines: DataFrame, at: str, by: list[str], size: str = "7 days", late: str = "30 days") -> DataFrame:
    """Counts and sums in tumbling windows."""
    return lines.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def keep_latest_into(lines: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch into the table of versions at ``path``: of rows with one key the latest stays.

    Batch ``n`` makes version ``n + 1`` of the version before it, so a batch
    that is run again after a failure gives the same table, and a crash
    leaves the last whole version (see :func:`sources.sinks.commit_baseline`).
    """
    from ..sources.sinks import commit_baseline, read_baseline

    def merge(batch: DataFrame, number: int) -> None:
        stored = read_baseline(batch.sparkSession, path, below=number + 1)
        rows = batch if stored is None else batch.unionByName(stored)
        fields = [c for c in rows.columns if c != key]
        best = rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(order, *fields)).alias("b"))
        commit_baseline(best.select(key, *(F.col(f"b.{c}").alias(c) for c in fields)).select(*rows.columns), path, number + 1)

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
