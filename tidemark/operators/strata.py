"""Strata of episodes as they were known, matched samples of counterparts, and checks before a batch is landed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.relational import asof_join, interval_join


def bucket(value: Column, edges: list[tuple[str, float]]) -> Column:
    """Name of the last edge at or below value; edges (name, from) rise, the last is open. NULL below the first."""
    out = F.lit(None).cast("string")
    for name, low in edges:
        out = F.when(value >= low, name).otherwise(out)
    return out


def stratified(episodes: DataFrame, members: DataFrame, segments: DataFrame, states: DataFrame, edges: list[tuple[str, float]], names: tuple[list[str], list[str], list[str]]) -> DataFrame:
    """episodes (code, bottom, base_days, ...) with what was known at the bottom: one row for each, none lost or doubled.

    names[0] from members (code, since, until, ...): the newest span that holds the bottom, both ends included. names[1]
    from segments (code, d, ...): the newest row at or before it. names[2] from states (code, d, ...): the row of the day itself,
    of several the greatest. base_bucket by edges. Nothing known is NULL.
    """
    d = interval_join(episodes, members, ["code"], "bottom", "since", "until", names[0], closed=True)
    d = asof_join(d, segments, ["code"], "bottom", "d", names[1])
    one = states.groupBy("code", F.col("d").alias("bottom")).agg(F.max(F.struct(*names[2])).alias("_s"))
    d = d.join(one, ["code", "bottom"], "left")
    return d.select(*episodes.columns, *names[0], *names[1], *[F.col(f"_s.{c}").alias(c) for c in names[2]], bucket(F.col("base_days"), edges).alias("base_bucket"))


def matched(positives: DataFrame, candidates: DataFrame, strata: list[str], per: float, key: list[str], salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(chosen, quotas): of each stratum's candidates ceil(per x positives), those of the smallest hash of salt and key.

    chosen: candidates with n_in_stratum, their place from 1. quotas: stratum, positives, candidates, quota and taken, so that
    a shortage is seen. The same rows give the same sample, in any order and at any number of partitions; NULL is a value of a
    stratum like any other. Strata without positives have a quota of 0. Places beyond any quota are cut before rows move.
    """
    n = positives.groupBy(*strata).agg(F.count(F.lit(1)).alias("positives"))
    c = candidates.groupBy(*strata).agg(F.count(F.lit(1)).alias("candidates"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{s}").eqNullSafe(F.col(f"{b}.{s}")) for s in strata])
    zero = lambda x: F.coalesce(x, F.lit(0))
    q = n.alias("n").join(c.alias("c"), same("n", "c"), "full").select(*[F.coalesce(f"n.{s}", f"c.{s}").alias(s) for s in strata], zero("positives").alias("positives"), zero("candidates").alias("candidates"))
    q = q.withColumn("quota", F.ceil(F.col("positives") * per).cast("long")).withColumn("taken", F.least("quota", "candidates"))
    most = q.agg(F.max("taken")).first()[0] or 0
    order = W.partitionBy(*strata).orderBy(F.sha2(F.concat_ws("\x1f", F.lit(salt), *[F.col(k).cast("string") for k in key]), 256), *key)
    ranked = candidates.withColumn("n_in_stratum", F.row_number().over(order)).filter(F.col("n_in_stratum") <= most)
    chosen = ranked.alias("r").join(q.alias("q"), same("r", "q")).filter("n_in_stratum <= quota").select("r.*")
    return chosen, q


def landing_checks(df: DataFrame, checks: dict[str, Column], grain: list[str], expected: DataFrame | None = None) -> DataFrame:
    """(check, bad): rows that fail each condition (NULL fails), repeated grains, and grains of expected that df lacks or adds.

    Every check has a row, 0 where nothing is wrong. One pass over df for the conditions.
    """
    fails = [F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(name) for name, c in checks.items()]
    own = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("e"))
    both = own if expected is None else own.unionByName(expected.select(*grain).distinct().withColumns({"n": F.lit(0).cast("long"), "e": F.lit(1)}))
    by = both.groupBy(*grain).agg(F.sum("n").alias("n"), F.max("e").alias("e"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    grains = [count(F.col("n") > 1).alias("repeated")] + ([count((F.col("n") == 0) & (F.col("e") == 1)).alias("missing"), count((F.col("n") > 0) & (F.col("e") == 0)).alias("unexpected")] if expected is not None else [])
    one = df.agg(*fails).join(F.broadcast(by.agg(*grains)), F.lit(True)) if fails else by.agg(*grains)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("bad")) for c in one.columns])).alias("x")).select("x.check", "x.bad")
