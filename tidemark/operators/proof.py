"""Proofs that two ways to a table agree: multisets in both directions, and results on inputs cut at a day."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import in_tasks, saved


def _plain(df: DataFrame) -> list[Column]:
    """Columns with -0.0 as 0.0; grouping takes care of the rest (NaN equals NaN, NULL equals NULL)."""
    return [(F.col(c) + F.lit(0.0)).cast(t).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes]


def multiset_gaps(left: DataFrame, right: DataFrame, rows: int | None = None) -> DataFrame:
    """(columns..., n_left, n_right) of the rows that do not stand equally often on both sides. One aggregate over both.

    rows, about how many both have, is for rows that seldom repeat: they are counted in tasks of a bounded number of rows.
    """
    cols = left.columns
    a = left.select(*_plain(left)).withColumns({"_l": F.lit(1), "_r": F.lit(0)})
    b = right.select(*cols)
    b = b.select(*_plain(b)).withColumns({"_l": F.lit(0), "_r": F.lit(1)})
    both = a.unionByName(b)
    return (both if rows is None else in_tasks(both, rows, *cols)).groupBy(*cols).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).filter("n_left <> n_right")


def panel_proof(left: DataFrame, right: DataFrame, grain: list[str]) -> DataFrame:
    """One row: rows of both sides, rows only on one (in whole rows, with repeats), repeated and null grains, and whether all is equal.

    Empty tables are equal. Both must have the same columns, in any order.
    """
    gaps = multiset_gaps(left, right).agg(
        F.coalesce(F.sum(F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0))), F.lit(0)).alias("only_right")
    )
    either = left.select(*grain, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*grain, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    by = either.groupBy(*grain).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in grain])
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    sizes = by.agg(count(F.col("l"), "rows_left"), count(F.col("r"), "rows_right"), count((F.col("l") > 1).cast("int"), "repeated_left"), count((F.col("r") > 1).cast("int"), "repeated_right"), count(F.when(null, F.col("l") + F.col("r")), "null_grains"))
    out = sizes.join(F.broadcast(gaps), F.lit(True))  # one row each
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def cut_proof(plan: Callable[[dict[str, DataFrame]], DataFrame], inputs: dict[str, tuple[DataFrame, str]], cuts: list, day: str, shown: int = 3) -> DataFrame:
    """(cut, rows, only_cut, only_full, first_gap, examples): whether rows up to a day change when later input is there.

    inputs: by name a table and the column that says when a row was known. For each cut the plan runs on what was known by
    then and on everything; rows dated at or before the cut are compared as multisets. A plan that looks ahead differs:
    first_gap is the earliest day that does, examples are the first `shown` differing rows of one side as JSON. Input rows
    whose time of knowledge is NULL raise an error, for they could hide a difference. Cuts are a short list; each is one run
    of the plan.

    Inputs are written once and read by all runs: sums of floats that are worked out anew may differ in the last bits. So are
    the results, which are read more than once.
    """
    spark = next(iter(inputs.values()))[0].sparkSession
    inputs = {k: (saved(df, "proof-input"), at) for k, (df, at) in inputs.items()}
    full, out = saved(plan({k: df for k, (df, _) in inputs.items()}), "proof-full"), None
    rows = full.count()
    for cut in cuts:
        t = F.lit(cut)
        known = {k: df.filter(F.when(F.col(at).isNull(), F.raise_error(F.lit(f"{k}: a row without {at}")).cast("boolean")).otherwise(F.col(at) <= t)) for k, (df, at) in inputs.items()}
        a, b = plan(known).filter(F.col(day) <= t), full.filter(F.col(day) <= t)
        gaps = saved(multiset_gaps(a, b, 2 * rows), "proof-gaps")
        row = F.to_json(F.struct(*[F.col(c) for c in a.columns], F.when(F.col("n_left") > F.col("n_right"), "cut").otherwise("full").alias("side")))
        first = gaps.select(F.col(day), row.alias("example"), F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)).alias("lost"), F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0)).alias("won"))
        head = first.orderBy(day, "example").limit(shown).agg(F.array_sort(F.collect_list("example")).alias("examples"))
        sums = first.agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("only_cut"), F.coalesce(F.sum("won"), F.lit(0)).alias("only_full"), F.min(day).alias("first_gap"))
        one = b.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(sums), F.lit(True)).join(F.broadcast(head), F.lit(True)).select(t.alias("cut"), "rows", "only_cut", "only_full", "first_gap", "examples")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "cut date, rows long, only_cut long, only_full long, first_gap date, examples array<string>") if out is None else out
