"""Sinks: delimited files, partitioned tables, shards and synchronised stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header; nothing is written of an empty table."""
    if not df.take(1):
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned; rows of a partition are brought together first, so files stay few."""
    spread = df.repartition(*by) if by else df
    spread.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_shards(df: DataFrame, key: str, path: str, shards: int = 512) -> None:
    """JSON in folders by the shard of a key."""
    marked = df.withColumn("shard", ids.shard(F.col(key), shards))
    marked.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    """The folder's file system, and the numbers of its complete versions in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return fs, sorted(found)


def commit_baseline(df: DataFrame, path: str, version: int | None = None, kept: int = 2) -> int:
    """Write a table as its next version, a folder of its own, and return the version's number.

    A version counts once Spark has marked it as whole, so a crash at any
    point leaves the one before it to be read; nothing is deleted or moved
    before that.  Writing one version again replaces it.  Of older versions
    ``kept - 1`` stay for readers that still use them.
    """
    spark = df.sparkSession
    fs, there = _versions(spark, path)
    number = version if version is not None else (there[-1] + 1 if there else 1)
    df.write.mode("overwrite").parquet(f"{path}/v{number:012d}")
    for old in [v for v in there if v < number][: -(kept - 1) or None]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old:012d}"), True)
    return number


def read_baseline(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The latest whole version of a table (before version ``below``), or None."""
    _, there = _versions(spark, path)
    some = [v for v in there if below is None or v < below]
    return spark.read.parquet(f"{path}/v{some[-1]:012d}") if some else None


def apply_plan(stored: DataFrame, wanted: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """A store after a plan of :func:`operators.once.sync_plan`."""
    gone = plan.where("action IN ('delete', 'update')").select(key)
    fresh = plan.where("action IN ('insert', 'update')").select(key)
    return stored.join(gone, key, "left_anti").unionByName(wanted.join(fresh, key, "left_semi"))
