"""Joins, deduplication, set and multiset operators over keyed, dated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given (total) order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row at or before its time, by key; NULL where there is none.

    Both sides are stacked and sorted once by (key, time, right first); the last right row so far is carried along.
    One shuffle on the keys, linear in the rows, whatever the gaps. Of right rows with one time the greatest values win.
    """
    names = left.columns
    r = right.filter(F.col(right_time).isNotNull())
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    stacked = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_l"), F.lit(None).cast(r.select(packed.alias("x")).schema[0].dataType).alias("_r")).unionByName(
        r.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*names).alias("x")).schema[0].dataType).alias("_l"), packed.alias("_r"))
    )
    w = W.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = stacked.withColumn("_v", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    hit = F.col("_t").isNotNull()
    return got.select(*[F.col(f"_l.{c}").alias(c) for c in names], *[F.when(hit, F.col(f"_v.{v}")).alias(v) for v in values])


def interval_join(left: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, values: list[str], closed: bool = False) -> DataFrame:
    """left with the values of the span that holds its time; of several the newest start wins, then the greatest values.

    A span is [start, end), or [start, end] if closed; an end of NULL is open. Spans that overlap are allowed.

    The spans of a key are cut at all their ends into segments of one answer each, and left meets these as asof_join() does:
    one sort, whatever the length of spans. The work on spans alone grows with the square of the spans of one key, which are
    its changes in the course of time.
    """
    names = left.columns
    mine, theirs = left.schema[at].dataType.simpleString(), spans.schema[start].dataType.simpleString()
    kind = mine if mine == theirs else "timestamp" if {mine, theirs} & {"date", "timestamp", "string"} else "double"
    # at one time open ends and starts come first, then rows, then closed ends
    place = lambda t, k: F.struct(t.cast(kind).alias("t"), F.lit(k).alias("k"))
    s = spans.select(*keys, F.col(start).alias("_s"), place(F.col(start), 0).alias("_a"), F.when(F.col(end).isNotNull(), place(F.col(end), 2 if closed else 0)).alias("_e"), F.struct(F.col(start).alias("s"), *[F.col(v).alias(v) for v in values]).alias("_v"))
    s = s.filter("_s IS NOT NULL").dropna(subset=keys)
    cuts = s.select(*keys, F.explode(F.array_compact(F.array("_a", "_e"))).alias("_p")).distinct()
    won = cuts.join(s, keys).filter((F.col("_a") <= F.col("_p")) & (F.col("_e").isNull() | (F.col("_p") < F.col("_e")))).groupBy(*keys, "_p").agg(F.max("_v").alias("_v"))
    r = cuts.join(won, [*keys, "_p"], "left").select(*keys, "_p", F.struct("_v").alias("_r"))
    at_row = F.when(F.col(at).isNotNull(), place(F.col(at), 1))
    row = left.select(*keys, at_row.alias("_p"), F.struct(*names).alias("_l"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
    stacked = row.unionByName(r.select(*keys, "_p", F.lit(None).cast(row.schema["_l"].dataType).alias("_l"), "_r"))
    w = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = stacked.withColumn("_v", F.last("_r", True).over(w)).filter("_l IS NOT NULL")
    return got.select(*[F.col(f"_l.{c}").alias(c) for c in names], *[F.when(F.col("_p").isNotNull(), F.col(f"_v._v.{v}")).alias(v) for v in values])


def window_vwap(bars: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """spans with vwap = sum(close * vol) / sum(vol) of the bars in (start, end]; NULL without volume."""
    s = spans.select(*keys, start, end).distinct()
    j = bars.join(s, keys).filter((F.col("d") > F.col(start)) & (F.col("d") <= F.col(end)))
    v = j.groupBy(*keys, start, end).agg((F.sum(F.col("close") * F.col("vol")) / F.nullif(F.sum("vol"), F.lit(0))).alias("vwap"))
    return spans.join(v, [*keys, start, end], "left")


def multiset_compare(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """For each distinct row: copies on both sides, matched, only left and only right."""
    both = left.select(*cols, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*cols, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    x, y = F.col("n_left"), F.col("n_right")
    n = both.groupBy(*cols).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))  # one shuffle for both sides
    return n.select(*cols, x, y, F.least(x, y).alias("matched"), F.greatest(x - y, F.lit(0)).alias("only_left"), F.greatest(y - x, F.lit(0)).alias("only_right"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of first, and the rows of second whose key first does not have."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def missing_keys(expected: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Keys expected but not there: an anti-join, so a NULL on either side hides nothing."""
    return expected.select(*keys).distinct().join(have.select(*keys).distinct(), keys, "left_anti")


def full_integrity(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A full outer join by key with a status: both, differs, left_only, right_only."""
    a, b = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    status = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").when(F.col("_a").eqNullSafe(F.col("_b")), "both").otherwise("differs")
    return a.join(b, keys, "full").select(*keys, F.col("_a").alias("left_value"), F.col("_b").alias("right_value"), status.alias("status"))


def facet_page(df: DataFrame, equal: dict[str, object], order: list[Column], limit: int) -> DataFrame:
    """The first rows that pass the set facets (None: not set), with truncated: whether more would have."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    got = df.orderBy(*order).limit(limit + 1)
    w = W.partitionBy(F.lit(0))  # over limit + 1 rows
    return got.withColumn("truncated", F.count(F.lit(1)).over(w) > limit).orderBy(*order).limit(limit)


def search_page(df: DataFrame, text: str, cols: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).cast("string").contains(text)
    return df.filter(cond).orderBy(*order).offset(offset).limit(limit)


def dimension_rollup(df: DataFrame, dims: list[str], aggs: list[Column]) -> DataFrame:
    """One row for each (dim, value): each fact counts once in every dimension. One pass instead of a union of scans."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    return df.select("*", each.alias("_d")).groupBy(F.col("_d.dim").alias("dim"), F.col("_d.value").alias("value")).agg(*aggs)
