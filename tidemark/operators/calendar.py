"""Calendar operators: trading-day ordinals, period ends, deadlines and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trading_days(df: DataFrame, day: str = "d") -> DataFrame:
    """(d, n): the distinct days in order, numbered from 1. A calendar has a few hundred rows a year, whatever df has."""
    return df.select(F.col(day).alias("d")).filter("d IS NOT NULL").distinct().withColumn("n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("d")))


def open_days(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """(d): the weekdays of span (first, last; one row) that are no holidays (d)."""
    days = span.filter("first IS NOT NULL").select(F.explode(F.sequence("first", "last")).alias("d"))
    return days.filter(F.weekday("d") < 5).join(holidays.select("d"), "d", "left_anti")


def ordinals(calendar: DataFrame) -> DataFrame:
    """(day, n): of every day from the calendar's first to its last, open or not, how many trading days there are up to it."""
    span = calendar.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    open_ = calendar.select(F.col("d").alias("day"), F.lit(1).alias("_o")).distinct()
    w = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # days only: bounded by years
    return span.join(open_, "day", "left").select("day", F.count("_o").over(w).alias("n"))


def days_since(df: DataFrame, calendar: DataFrame, since: str, until: str, out: str = "days") -> DataFrame:
    """Trading days in (since, until], 0 if until is not later; NULL where a day lies outside the calendar, never clamped to 0.

    Both days meet their ordinal in a table of days, which is small enough to broadcast.
    """
    n = ordinals(calendar)
    a, b = F.broadcast(n.select(F.col("day").alias("_a"), F.col("n").alias("_na"))), F.broadcast(n.select(F.col("day").alias("_b"), F.col("n").alias("_nb")))
    j = df.join(a, F.col(since).cast("date") == F.col("_a"), "left").join(b, F.col(until).cast("date") == F.col("_b"), "left")
    return j.withColumn(out, F.greatest(F.when(F.col("_na").isNotNull(), F.col("_nb") - F.col("_na")), F.when(F.col("_na").isNotNull() & F.col("_nb").isNotNull(), F.lit(0).cast("long")))).drop("_a", "_na", "_b", "_nb")


def period_keys(day: Column) -> dict[str, Column]:
    """ISO week (of its own year) and month keys."""
    return {"week": F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day), "month": F.year(day) * 100 + F.month(day)}


def period_ends(calendar: DataFrame, period: str) -> DataFrame:
    """(period, period_end): the last trading day of each period by the calendar, not by the data."""
    return calendar.groupBy(period_keys(F.col("d"))[period].alias("period")).agg(F.max("d").alias("period_end"))


def report_deadline(quarter_end: Column) -> Column:
    """Statutory deadline of a quarterly report: end of April for Q4 and Q1, of August for Q2, of October for Q3."""
    y, m = F.year(quarter_end), F.month(quarter_end)
    return F.when(m == 3, F.make_date(y, F.lit(4), F.lit(30))).when(m == 6, F.make_date(y, F.lit(8), F.lit(31))).when(m == 9, F.make_date(y, F.lit(10), F.lit(31))).when(m == 12, F.make_date(y + 1, F.lit(4), F.lit(30)))


def available_at(day: Column, hour: int = 18, zone: str = "Asia/Shanghai") -> Column:
    """The instant, in UTC, at which a day's data count as known."""
    return F.to_utc_timestamp(F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), F.lit(f"{hour:02d}:00:00"))).cast("timestamp"), zone)


def pit(df: DataFrame, at: Column, available: str, event: str) -> DataFrame:
    """What was known at `at`: rows available and dated at or before it. A row without either anchor raises."""
    missing = F.col(available).isNull() | F.col(event).isNull()
    latest = F.when(missing, F.raise_error(F.lit("row without an availability or event time"))).otherwise(F.greatest(available, event))
    return df.filter(latest <= at)
