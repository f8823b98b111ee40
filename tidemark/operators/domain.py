"""Further operators: identity keys and resolution, period windows, segments, universe evidence, plans over dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators import windows as X


def identity_key(code: Column, name: Column, is_org: Column, kind: Column) -> tuple[Column, Column, Column]:
    """Key of a holder (by code, else by name), its kind, and how well that is founded."""
    key = F.when(code.isNotNull(), F.concat(F.lit("code:"), code)).otherwise(F.concat(F.lit("name:"), F.lower(F.trim(name))))
    what = F.when(code.isNotNull() | F.coalesce(is_org, F.lit(False)), "institution").when(is_org.isNotNull() & ~is_org, "person").when(kind == "person", "person").otherwise("institution")
    grade = F.when(code.isNotNull(), "vendor_code").when(is_org.isNotNull(), "vendor_org_flag").otherwise("holder_type_proxy")
    return key, what, grade


def period_windows(reports: DataFrame, bars: DataFrame, lookback: int = 92) -> DataFrame:
    """reports (code, d) with start (the report before, else `lookback` days back), vwap over (start, d] and the last close."""
    prev = F.lag("d").over(W.partitionBy("code").orderBy("d"))
    w = reports.select("code", F.col("d").alias("end"), F.coalesce(prev, F.date_sub("d", lookback)).alias("start"))
    priced = R.window_vwap(bars, w, ["code"], "start", "end")
    return R.asof_join(priced, bars.select("code", F.col("d").alias("bar_day"), "close"), ["code"], "end", "bar_day", ["close"])


def sum_if_all(value: str) -> Column:
    """Sum of a group, NULL if any of its values is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def resolve_identity(rows: DataFrame, changes: DataFrame, bars: DataFrame) -> DataFrame:
    """rows (code, d) with the code as of d and a status.

    changes (old, new, effective): a row under the new code before the change goes back to the old code, confirmed
    where the old code has a bar that day; a row whose old twin stands beside it is a duplicate. Other rows are
    confirmed by a bar, pending on the day after the last bar day, else unresolved.
    """
    have = bars.select("code", "d").distinct()
    last = bars.agg(F.max("d").alias("_last"))
    r = rows.join(changes.select(F.col("new").alias("code"), F.col("old").alias("_old"), "effective"), "code", "left")
    early = F.col("_old").isNotNull() & (F.col("d") < F.col("effective"))
    twin = rows.select(F.col("code").alias("_old"), "d", F.lit(True).alias("_twin")).distinct()
    r = r.join(twin, ["_old", "d"], "left").withColumn("asof_code", F.when(early & F.col("_twin").isNotNull(), F.lit(None)).when(early, F.col("_old")).otherwise(F.col("code")))
    r = r.join(have.select(F.col("code").alias("asof_code"), "d", F.lit(True).alias("_bar")), ["asof_code", "d"], "left").join(F.broadcast(last), F.lit(True))
    status = (
        F.when(early & F.col("_twin").isNotNull(), "backfill_duplicate").when(early & F.col("_bar").isNotNull(), "backfill_remapped").when(early, "unresolved")
        .when(F.col("_bar").isNotNull(), "confirmed").when(F.col("d") == F.date_add("_last", 1), "pending").otherwise("unresolved")
    )
    return r.select("code", "d", "asof_code", status.alias("status"))


def segments(daily: DataFrame, cap: str, turnover: str) -> DataFrame:
    """daily (code, d, ...) with cap and turnover bands by the day's percent rank."""
    d = daily.withColumn("cap_band", X.band(X.rank_share(cap, ["d"]), [0.2, 0.5, 0.8], ["micro", "small", "mid", "large"]))
    return d.withColumn("turnover_band", X.band(X.rank_share(turnover, ["d"]), [0.33, 0.67], ["low", "mid", "high"]))


def universe_evidence(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(reason, rows): each row counts once, under the first rule that excludes it, or under kept."""
    reason = None
    for name, bad in rules.items():
        bad = F.coalesce(bad, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return df.groupBy(reason.otherwise("kept").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def level_pivot(df: DataFrame, key: str, level: str, value: str, levels: list[int]) -> DataFrame:
    """One row for each key with a column for each level: the greatest value there."""
    return df.groupBy(key).pivot(level, levels).agg(F.max(value)).select(key, *[F.col(str(k)).alias(f"l{k}") for k in levels])


def due_days(settled: DataFrame, start: Column, end: Column, n: int) -> DataFrame:
    """The first n calendar days from start to end that are not settled."""
    days = settled.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("d"))
    return days.join(settled.select("d").distinct(), "d", "left_anti").orderBy("d").limit(n)


def missing_quarters(have: DataFrame, key: str, day: str) -> DataFrame:
    """(key, quarter): quarter ends between a key's first and last one that it lacks."""
    q = have.select(key, F.last_day(F.add_months(F.trunc(F.col(day), "quarter"), 2)).alias("quarter")).distinct()
    span = q.groupBy(key).agg(F.min("quarter").alias("lo"), F.max("quarter").alias("hi"))
    every = span.select(key, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 3 MONTH"))).alias("m")).select(key, F.last_day("m").alias("quarter"))
    return every.join(q, [key, "quarter"], "left_anti")


def condition(spec: dict) -> Column:
    """{indicator, op: above|below|flat, threshold[, band]} as a predicate; NULL and NaN are false."""
    x = F.col(spec["indicator"]).cast("double")
    t = float(spec["threshold"])
    hit = {"above": x > t, "below": x < t, "flat": F.abs(x - t) <= float(spec.get("band", 0.0))}[spec["op"]]
    return F.coalesce(hit & ~F.isnan(x), F.lit(False))


def catch_up_plan(facts: DataFrame, raw: DataFrame, key: str, day: str) -> DataFrame:
    """(key, start, end): the closed window of raw days that a fact lacks; keys that are up to date are not there."""
    f, r = facts.groupBy(key).agg(F.max(day).alias("_f")), raw.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("end"))
    d = r.join(f, key, "left").withColumn("start", F.coalesce(F.date_add("_f", 1), F.col("_lo")))
    return d.filter("start <= end").select(key, "start", "end")


def snapshot_hash(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(rows, snapshot): a fingerprint of the whole table that does not depend on the order of its rows.

    128 bits of each row's hash are summed, in two halves, so that no task sees more than its partition.
    """
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in [*keys, *cols]]), 256)
    half = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", half(1).cast("string"), half(13).cast("string")).alias("snapshot"))


def population_verdict(counts: DataFrame, floor: float = 0.9) -> DataFrame:
    """counts (key, raw, accepted) with the largest accepted count so far, and an action."""
    w = W.partitionBy("key").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    d = counts.withColumn("baseline", F.max("accepted").over(w))
    action = F.when(F.col("raw") == 0, "fetch").when(F.col("accepted") < F.col("raw"), "accept").when(F.col("baseline").isNotNull() & (F.col("accepted") < floor * F.col("baseline")), "refetch_truncated").otherwise("ok")
    return d.withColumn("action", action)
