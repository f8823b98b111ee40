"""Sampling of labelled rows and row keys shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id gives 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(m)), F.lit(0))


def class_sample(df: DataFrame, label: str, by: str, rows: int, max_classes: int = 1000) -> DataFrame:
    """(label, by) of at most `rows` distinct values of `by` for each label, those of the smallest hash; repeatable, and even.

    Copies count once. Distinct values of each label are estimated first (a bounded table: more than max_classes labels is
    an error). They set a hash threshold by label that leaves about twice the wanted values (an error of a few hundredths
    cannot reach the wanted ones), so the ranking that follows never sees a whole class. Copies are joined before it.
    """
    df = df.filter(F.col(label).isNotNull() & F.col(by).isNotNull()).select(label, by, F.xxhash64(by).alias("_h"))
    counts = df.groupBy(label).agg(F.approx_count_distinct("_h", 0.02).alias("count")).limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} labels")
    top = 1 << 63
    few = F.lit(False)
    for r in counts:
        share = min(1.0, 2.0 * (rows + 20) / r["count"])
        few = few | ((F.col(label) == F.lit(r[label])) & (F.col("_h") <= F.lit(int(-top + share * (2 * top - 1)) if share < 1 else top - 1)))
    w = W.partitionBy(label).orderBy("_h", by)
    one = df.filter(few).groupBy(label, "_h").agg(F.min(by).alias(by))
    return one.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows).select(label, by)


def bounded_texts(sample: DataFrame, label: str, most_bytes: int) -> DataFrame:
    """(label, text) of a bounded sample: whole texts of each label by hash, until their bytes reach the bound.

    The text that passes the bound is the last. sample has few rows, so the sums by label are of few lengths.
    """
    sized = sample.select(label, "text", F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_size"))
    before = W.partitionBy(label).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("_past", F.coalesce(F.sum("_size").over(before), F.lit(0))).filter(F.col("_past") < most_bytes).select(label, "text")
