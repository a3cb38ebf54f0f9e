"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbatch import NO_ID


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, in local runs, a folder of our own. Elsewhere executors would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyledger-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df once and reads it back: the lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table of store() that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Keys that may be broadcast, at most, and the rows that make a key one of them, at least.
HOT_KEYS, HOT_ROWS = 1000, 256


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join with right (key once, n, ...), where n is how many of at most ``rows`` rows left has of the key.

    A key with more than 1/HOT_KEYS of the rows has fewer than HOT_KEYS like it: these are broadcast and their
    rows stay where they are, so only keys of few rows are shuffled.
    """
    hot = F.col("n") > max(rows / HOT_KEYS, HOT_ROWS)
    few = F.broadcast(right.filter(hot).drop("n"))
    rest = left.join(few.select(key), key, "left_anti").join(right.filter(~hot).drop("n"), key)
    return left.join(few, key).unionByName(rest)


def id_or_null(column: Column) -> Column:
    return F.when(column != F.lit(NO_ID), column)
