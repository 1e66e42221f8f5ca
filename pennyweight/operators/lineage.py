"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one on a single machine where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where none is named (on one machine, in tests) a temporary folder is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def settle(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go: Spark deletes them when the driver's memory no longer holds their frames."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sorted_table(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, dealt by ranges and sorted, so that filters on ``by`` read few row groups."""
    path = f"{shared_base(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", 1 << 20).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` from a table in the shared folder, and the table's path, for :func:`dropped`; it goes when the session ends, at the latest."""
    spark = df.sparkSession
    path = f"{shared_base(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete the table of a step that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
