"""Incremental build of a panel by days: which days are due, what must be read for them, and checks before they are taken in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import windows as X
from tidemark.session import saved


def due_days(source: DataFrame, panel: DataFrame, late: int, day: str = "d") -> DataFrame:
    """(day): days that source has and the panel has not, and the last `late` days of the panel, whose rows may have come late.

    Days only: a bounded table, whatever the panel holds.
    """
    have = panel.select(day).filter(F.col(day).isNotNull()).distinct()
    last = have.orderBy(F.desc(day)).limit(late) if late else have.limit(0)
    there = source.select(day).filter(F.col(day).isNotNull()).distinct()
    return there.join(have, day, "left_anti").unionByName(last.join(there, day, "left_semi")).distinct()


def touched_days(source: DataFrame, changed: DataFrame, keys: list[str], back: int | None, day: str = "d") -> DataFrame:
    """(day): days of a key's row that reads a changed row (keys, day), itself or one of the `back` rows before it; None: any before.

    These are the days to rewrite after rows changed anywhere in the past.
    """
    w = X.over(keys, [day], None if back is None else -back, 0)
    hit = source.join(changed.select(*keys, day).distinct().withColumn("_hit", F.lit(1)), [*keys, day], "left")
    return hit.withColumn("_near", F.max("_hit").over(w)).filter("_near = 1").select(day).distinct()


def reading_from(source: DataFrame, due: DataFrame, keys: list[str], back: int, run: Column | None = None, before_run: int = 0, day: str = "d") -> DataFrame:
    """(keys, since): the first day to read of each key so that all windows of its due rows are whole.

    A due row reads `back` rows of its key before it; these are rows, not days, so a key with gaps reaches further back. run:
    a value that stays the same within a run (a sign, a flag) which is counted from its beginning; reading then starts
    `before_run` rows before the run that the first due row stands in. Keys without due rows are left out. Only keys, day and
    run are read.
    """
    narrow = source.select(*keys, day, (F.lit(0) if run is None else run).alias("_v")).join(F.broadcast(due.select(day).withColumn("_due", F.lit(1))), day, "left")
    w = X.over(keys, [day])
    rows = narrow.withColumn("_n", F.row_number().over(w)).withColumn("_new", ~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | (F.col("_n") == 1))
    rows = rows.withColumn("_start", F.max(F.when(F.col("_new"), F.col("_n"))).over(X.over(keys, [day], None, 0)))
    reach = F.col("_n") - back
    if run is not None:
        reach = F.least(reach, F.col("_start") - before_run)
    target = rows.filter("_due = 1").groupBy(*keys).agg(F.greatest(F.min(reach), F.lit(1)).alias("_n"))
    return rows.join(target, [*keys, "_n"]).select(*keys, F.col(day).alias("since"))


def increment(build: Callable[[DataFrame], DataFrame], source: DataFrame, due: DataFrame, keys: list[str], back: int, run: Column | None = None, before_run: int = 0, day: str = "d") -> DataFrame:
    """Panel rows of the due days, built from no more of source than they need.

    build makes the panel of a source table; its windows over `keys` ordered by day must reach back no further than `back`
    rows or the beginning of a run, and what it compares across keys must lie within one day. The first day of all is a
    constant of the scan, so partitions and row groups before it are skipped.
    """
    since = saved(reading_from(source, due, keys, back, run, before_run, day), "reading-from")
    ends = since.agg(F.min("since").alias("lo")).join(F.broadcast(due.agg(F.max(day).alias("hi"))), F.lit(True)).first()
    if ends is None or ends["lo"] is None:
        return build(source.limit(0))
    part = source.filter(F.col(day).between(F.lit(ends["lo"]), F.lit(ends["hi"]))).join(since, keys).filter(F.col(day) >= F.col("since")).drop("since")
    return build(part).join(F.broadcast(due.select(day)), day, "left_semi")


def taken_in(panel: DataFrame, rows: DataFrame, due: DataFrame, day: str = "d") -> DataFrame:
    """The panel with its due days replaced by rows."""
    return panel.join(F.broadcast(due.select(day)), day, "left_anti").unionByName(rows)


def batch_verdict(rows: DataFrame, panel: DataFrame, source_keys: DataFrame, due: DataFrame, grain: list[str], group: str | None = None, floors: dict | None = None, day: str = "d") -> DataFrame:
    """(problem, count): why rows must not replace the due days of the panel; every problem has a row, 0 where it does not occur.

    empty: due days without any row. null_grain and repeated_grain: of rows. missing_key and unexpected_key: grains of source
    that rows lack, and the other way round. lost_key: grains of the panel on due days that rows lack. below_floor: days and
    groups with fewer rows than floors (by group) ask for.
    """
    days = F.broadcast(due.select(day))
    null = F.lit(False)
    for c in grain:
        null = null | F.col(c).isNull()
    mine, theirs, ours = (df.select(*grain).join(days, day, "left_semi") for df in (rows, source_keys, panel))
    stack = lambda df, side: df.select(*grain, *[F.lit(int(s == side)).alias(s) for s in ("r", "s", "p")])
    by = stack(mine, "r").unionByName(stack(theirs, "s")).unionByName(stack(ours, "p")).groupBy(*grain).agg(*[F.sum(s).alias(s) for s in ("r", "s", "p")])
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    r, s, p = F.col("r"), F.col("s"), F.col("p")
    seen = due.select(day).join(mine.select(day).distinct().withColumn("_have", F.lit(1)), day, "left")
    checks = by.agg(
        count(null & (r > 0)).alias("null_grain"), count(r > 1).alias("repeated_grain"), count((s > 0) & (r == 0)).alias("missing_key"), count((r > 0) & (s == 0)).alias("unexpected_key"), count((p > 0) & (r == 0)).alias("lost_key")
    ).join(F.broadcast(seen.agg(count(F.col("_have").isNull()).alias("empty"))), F.lit(True))
    if group and floors:
        least = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))])
        counts = rows.join(days, day, "left_semi").groupBy(day, group).agg(F.count(F.lit(1)).alias("n"))
        every = due.select(day).withColumn(group, F.explode(F.array(*[F.lit(k) for k in floors])))
        short = every.join(counts, [day, group], "left").agg(count(F.coalesce("n", F.lit(0)) < least[F.col(group)]).alias("below_floor"))
        checks = checks.join(F.broadcast(short), F.lit(True))
    names = [c for c in checks.columns]
    return checks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("problem"), F.col(c).cast("long").alias("count")) for c in names])).alias("x")).select("x.problem", "x.count")


def require(verdict: DataFrame) -> None:
    """Raise if a batch_verdict() names a problem."""
    bad = {r["problem"]: r["count"] for r in verdict.filter("count > 0").collect()}
    if bad:
        raise ValueError(f"the batch is not taken in: {bad}")


def refresh(build: Callable[[DataFrame], DataFrame], source: DataFrame, path: str, keys: list[str], late: int, back: int, run: Column | None = None, before_run: int = 0, day: str = "d") -> list:
    """Bring the panel at path (Parquet, partitioned by day) up to date; returns the days that were rewritten.

    Without a panel all of it is built. Rows are written aside and checked first, and a batch that fails leaves the panel as it
    was; then only the due partitions are overwritten. Doing it again changes nothing, so an interrupted run is repeated.
    """
    from tidemark.sources import sinks

    spark = source.sparkSession
    if not sinks.exists(spark, path):
        build(source).write.partitionBy(day).parquet(path)
        return [r[day] for r in source.select(day).distinct().orderBy(day).collect()]
    panel = spark.read.parquet(path)
    due = saved(due_days(source, panel, late, day), "due-days")
    rows = saved(increment(build, source, due, keys, back, run, before_run, day), "increment")
    require(batch_verdict(rows, panel, source.select(*keys, day), due, [*keys, day], day=day))
    sinks.replace_partitions(rows, path, [day])
    return [r[day] for r in due.orderBy(day).collect()]
