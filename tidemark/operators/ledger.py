"""Ledgers and records: settled days, completeness by era, parity of pointers, shadow comparison, snapshots, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def update_changed(df: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """df with `column` from source where a row of the keys is there and differs; `changed` marks those rows. NULLs are values."""
    s = source.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_there"))
    d = df.join(s, keys, "left")
    changed = F.coalesce(F.col("_there"), F.lit(False)) & ~F.col(column).eqNullSafe(F.col("_new"))
    return d.withColumn("changed", changed).withColumn(column, F.when(F.col("changed"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_there")


def constant_in(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys with the one value of a column that is constant in a group; NULL where it is not (no value is picked at random)."""
    g = df.groupBy(*keys).agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    return g.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias(column))


def snapshot_day(stamp: Column, cutoff_hour: int, zone: str = "Asia/Shanghai") -> Column:
    """The local day that a snapshot taken at a UTC stamp speaks of; NULL before the day's cutoff hour."""
    local = F.from_utc_timestamp(stamp, zone)
    return F.when(F.hour(local) >= cutoff_hour, F.to_date(local))


def level_rollup(members: DataFrame, flows: DataFrame, levels: list[str], scale: float = 1e4) -> DataFrame:
    """(level, name, d, net, n_members, n_known): flows of a day summed at every level of the newest membership.

    members (code, since, levels): of a code's memberships the newest that has begun on the day counts, once. flows
    (code, d, net) in units of `scale`. Members without a known flow count as members; a level without any known is NULL.
    """
    m = F.struct("since", *levels)
    at = flows.join(members.select("code", "since", *levels), "code").filter("since <= d").groupBy("code", "d").agg(F.max_by(m, F.struct("since", *levels)).alias("m"), F.max("net").alias("net"))
    deep = at.select("d", "net", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("level"), F.col(f"m.{name}").cast("string").alias("name")) for k, name in enumerate(levels)])).alias("l"))
    return deep.groupBy("l.level", "l.name", "d").agg((F.sum("net") * scale).alias("net"), F.count(F.lit(1)).alias("n_members"), F.count("net").alias("n_known"))


def settled_days(ledger: DataFrame, lag: int, zone: str = "Asia/Shanghai") -> DataFrame:
    """(day): notice days that a fetch has settled.

    ledger (day, status, missing, local_rows, fetched_at in UTC): the fetch is complete, or empty with nothing held
    locally; nothing is missing; and it was made `lag` days after the notice day or later, by local date. Once settled,
    a day stays so whatever later fetches say.
    """
    ok = (F.col("status") == "complete") | ((F.col("status") == "empty") & (F.col("local_rows") == 0))
    late = F.to_date(F.from_utc_timestamp("fetched_at", zone)) >= F.date_add("day", lag)
    return ledger.filter(ok & (F.col("missing") == 0) & late).select("day").distinct()


def settle_statistics(ledger: DataFrame, lag: int, zone: str = "Asia/Shanghai") -> DataFrame:
    """By day: fetches, lag in days of the first settling fetch (NULL if none), and later fetches that miss rows."""
    ok = (F.col("status") == "complete") | ((F.col("status") == "empty") & (F.col("local_rows") == 0))
    late = F.to_date(F.from_utc_timestamp("fetched_at", zone)) >= F.date_add("day", lag)
    first = F.min(F.when(ok & (F.col("missing") == 0) & late, F.col("fetched_at"))).over(W.partitionBy("day"))
    d = ledger.withColumn("_first", first)
    return d.groupBy("day").agg(
        F.count(F.lit(1)).alias("fetches"),
        F.datediff(F.to_date(F.from_utc_timestamp(F.min("_first"), zone)), F.col("day")).alias("settle_lag"),
        F.count(F.when((F.col("fetched_at") > F.col("_first")) & (F.col("missing") > 0), 1)).alias("late_missing"),
    )


def incomplete_days(rows: DataFrame, day: str, group: str, eras: DataFrame) -> DataFrame:
    """(day, rows, n_groups, reason): days under their era's floor of rows, or without one of its required groups.

    eras (since, min_rows, required array): the newest that has begun holds. A small table, a row for each era.
    """
    g = rows.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.collect_set(group).alias("groups"))
    of = g.join(F.broadcast(eras), F.col("since") <= F.col("day")).groupBy("day").agg(F.max_by(F.struct("min_rows", "required"), "since").alias("e"), F.first("rows").alias("rows"), F.first("groups").alias("groups"))
    reason = F.when(F.col("rows") < F.col("e.min_rows"), "BELOW_MIN_ROWS").when(F.size(F.array_except("e.required", "groups")) > 0, "MISSING_GROUP")
    return of.select("day", "rows", F.size("groups").cast("long").alias("n_groups"), reason.alias("reason")).filter("reason IS NOT NULL")


def member_parity(pointers: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """pointers (keys, batch, rows) beside the members that the accepted batch holds; `intact` if the numbers agree."""
    n = members.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("members"))
    d = pointers.join(n, [*keys, "batch"], "left").withColumn("members", F.coalesce("members", F.lit(0)))
    return d.withColumn("intact", F.col("members") == F.col("rows"))


def shadow_compare(old: DataFrame, new: DataFrame, grain: list[str], numbers: list[str], digits: int = 6) -> DataFrame:
    """By grain that differs: kind (only_old, only_new, changed) and the first field that does, by the order of fields.

    Cells are made alike first: NaN and infinite numbers are NULL, others are rounded.
    """
    cell = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.round(F.col(c).cast("double"), digits))
    side = lambda df, tag: df.select(*grain, F.struct(*[cell(c).alias(c) for c in numbers]).alias(tag))
    d = side(old, "_o").join(side(new, "_n"), grain, "full")
    first = None
    for c in numbers:
        differs = ~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}"))
        first = F.when(differs, c) if first is None else first.when(differs, c)
    kind = F.when(F.col("_n").isNull(), "only_old").when(F.col("_o").isNull(), "only_new").when(first.isNotNull(), "changed")
    return d.select(*grain, kind.alias("kind"), F.when(kind == "changed", first).alias("field")).filter("kind IS NOT NULL")


def outside(df: DataFrame, code: str, pattern: str, family: str) -> DataFrame:
    """By family: rows, rows whose code is out of scope (not of the pattern, or NULL), and their codes: a plan for cleaning."""
    bad = ~F.coalesce(F.col(code).cast("string").rlike(pattern), F.lit(False))
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("out_rows"), F.count_distinct(F.when(bad, F.col(code))).alias("out_codes"))


def setup_signals(bars: DataFrame, window: int) -> DataFrame:
    """(code, bottom, available): lows of the `window` bars on both sides, known only `window` bars later."""
    w = W.partitionBy("code").orderBy("d")
    around = w.rowsBetween(-window, window)
    d = bars.select("code", F.col("d").alias("bottom"), "low", F.min("low").over(around).alias("_m"), F.count(F.lit(1)).over(around).alias("_n"), F.lead("d", window).over(w).alias("available"))
    return d.filter((F.col("_n") == 2 * window + 1) & (F.col("low") == F.col("_m"))).select("code", "bottom", "available")


def factor_divergence(ours: DataFrame, theirs: DataFrame, events: DataFrame, tolerance: float = 1e-4, days: int = 10) -> DataFrame:
    """(code, d, gap, cause): days on which two factor series differ, both taken from their first common day.

    cause: explained where an executed event lies within `days` of the day, drift where yesterday differed too, else
    unexplained. ours, theirs (code, d, factor); events (code, ex).
    """
    w = W.partitionBy("code").orderBy("d")
    base = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    both = ours.select("code", "d", F.col("factor").alias("a")).join(theirs.select("code", "d", F.col("factor").alias("b")), ["code", "d"])
    gap = F.abs(F.col("a") / F.first("a").over(base) / (F.col("b") / F.first("b").over(base)) - 1)
    d = both.withColumn("gap", gap).withColumn("_was", F.lag("gap").over(w))
    # an event explains the days around it: it is laid on each of them, so that the join is on equal keys
    near = events.select("code", F.explode(F.sequence(F.date_sub("ex", days), F.date_add("ex", days))).alias("d")).distinct().withColumn("_near", F.lit(True))
    cause = F.when(F.col("_near"), "explained").when(F.col("_was") > tolerance, "drift").otherwise("unexplained")
    return d.filter(F.col("gap") > tolerance).join(near, ["code", "d"], "left").select("code", "d", "gap", cause.alias("cause"))
