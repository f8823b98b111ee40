"""Daily bars: one row for each (code, day), from an event stream or from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import in_tasks, table


def daily_bars(df: DataFrame, code: str, day: Column, price: Column, order: list[str], volume: Column | None = None, amount: Column | None = None, rows: int | None = None, by: tuple[str, ...] = ("code", "d")) -> DataFrame:
    """(code, d, open, high, low, close, vol, amount). Rows without a code, a day or a price are left out.

    Open and close are the first and last price by `order`, which makes the day's rows unique: no tie decides.
    One shuffle, with partial aggregation before it. Both sort, as the first and the last price have no fixed size. rows, how
    many df has, is for tables of few rows to a code's day: they are shuffled as they are, to tasks of a bounded number of rows.
    by code alone, windows over a code's bars need no other shuffle, and a code's history is one task's.
    """
    key = F.struct(*order)
    src = df.select(F.col(code).alias("code"), day.alias("d"), price.alias("p"), key.alias("o"), (volume if volume is not None else F.lit(1)).alias("v"), (amount if amount is not None else price).alias("a"))
    src = src.filter("code IS NOT NULL AND d IS NOT NULL AND p IS NOT NULL")
    return (
        (src if rows is None else in_tasks(src, rows, *by))
        .groupBy("code", "d")
        .agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("vol"), F.sum("a").alias("amount"))
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "events"), "user_id", F.to_date("ts"), F.col("value"), ["ts", "event_id"])


def event_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, vol, amount) of event_bars(), the amount added up event by event in their order.

    Sums of floats depend on the order of rows, so ranks of equal or nearly equal amounts need a fixed one.
    """
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), F.to_date("ts").alias("d"), "ts", "event_id", "value").filter("code IS NOT NULL AND d IS NOT NULL AND value IS NOT NULL")
    w = W.partitionBy("code", "d").orderBy("ts", "event_id", "value")
    so_far = e.select("code", "d", F.row_number().over(w).alias("n"), F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("amount"))
    return so_far.groupBy("code", "d").agg(F.max("n").cast("long").alias("vol"), F.max_by("amount", "n").alias("amount"))


def line_bars(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("code", "d")) -> DataFrame:
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    lines = table(spark, sf_dir, "lineitem")
    return daily_bars(lines, "l_suppkey", F.to_date("l_shipdate"), price, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], F.col("l_quantity"), F.col("l_extendedprice"), lines.count(), by)


#: The same bars as DuckDB common table expressions.
EVENT_BARS_SQL = """bars AS (
  SELECT user_id AS code, CAST(ts AS DATE) AS d, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, {'a': ts, 'b': event_id}) AS close, count(*)::BIGINT AS vol, sum(value) AS amount
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)"""
LINE_BARS_SQL = """bars AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close,
         sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS p, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_quantity} AS o FROM lineitem)
  WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)"""
