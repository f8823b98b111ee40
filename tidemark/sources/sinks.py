"""Sinks on plain Parquet: publish by swap, replace partitions, append, upsert, clustered files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit as A


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, P = _fs(spark, path)
    return fs.exists(P(path))


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """Write next to the table, validate what was written, then swap by rename. A failed check leaves the old data.

    Between the two renames there is no table at path for a moment, so readers must be ready to try again. If the second
    rename fails, the old data go back to where they were.
    """
    spark = df.sparkSession
    fs, P = _fs(spark, path)
    nxt, old = f"{path}__next_{uuid.uuid4().hex}", f"{path}__old_{uuid.uuid4().hex}"
    try:
        df.write.parquet(nxt)
        if check:
            check(spark.read.parquet(nxt))
    except Exception:
        fs.delete(P(nxt), True)
        raise
    had = fs.exists(P(path))
    if had and not fs.rename(P(path), P(old)):
        fs.delete(P(nxt), True)
        raise OSError(f"{path} cannot be renamed")
    if not fs.rename(P(nxt), P(path)):
        if had and not fs.rename(P(old), P(path)):
            raise OSError(f"{path} cannot be put back; its data are in {old}, the new ones in {nxt}")
        raise OSError(f"{nxt} cannot be renamed to {path}")
    if had:
        fs.delete(P(old), True)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_frontier(df: DataFrame, path: str, key: str, day: str) -> None:
    """Append the rows beyond each key's last day."""
    spark = df.sparkSession
    if exists(spark, path):
        df = A.frontier_append(spark.read.parquet(path), df, key, day)
    df.write.mode("append").parquet(path)


def upsert(df: DataFrame, path: str, grain: list[str]) -> None:
    """Replace rows of the same grain, keep the others: plain Parquet has no MERGE, so the table is published anew."""
    spark = df.sparkSession
    publish(A.merge_on_grain(spark.read.parquet(path), df, grain) if exists(spark, path) else df, path)


def clustered(df: DataFrame, path: str, code: str, day: str) -> None:
    """Files that each hold a range of codes, sorted: row-group statistics then prune point lookups."""
    df.repartitionByRange(F.col(code)).sortWithinPartitions(code, day).write.mode("overwrite").parquet(path)


def unique(grain: list[str]) -> Callable[[DataFrame], None]:
    def check(df: DataFrame) -> None:
        bad = A.duplicate_grain(df, grain).limit(3).collect()
        if bad:
            raise ValueError(f"duplicate grain: {bad}")

    return check


def floor(rows: int) -> Callable[[DataFrame], None]:
    def check(df: DataFrame) -> None:
        n = df.count()
        if n < rows:
            raise ValueError(f"{n} rows; {rows} at least are expected")

    return check
