"""Window operators: islands, streaks, strict percentiles, ranks over frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def over(keys: list[str], order: list[str], lo: int | None = None, hi: int | None = None):
    w = W.partitionBy(*keys).orderBy(*order)
    return w if lo is None and hi is None else w.rowsBetween(W.unboundedPreceding if lo is None else lo, W.unboundedFollowing if hi is None else hi)


def sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)


def signed_streak(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "streak") -> DataFrame:
    """Length of the current run of one sign, signed: the difference of two row numbers names the run."""
    s = sign(F.col(value))
    all_rows = F.row_number().over(over(keys, order))
    same = F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))
    d = df.withColumn("_s", s).withColumn("_island", all_rows - same)
    pos = F.row_number().over(W.partitionBy(*keys, "_s", "_island").orderBy(*order))
    return d.withColumn(out, (F.col("_s") * pos).cast("long")).drop("_s", "_island")


def run_length(df: DataFrame, keys: list[str], order: list[str], flag: Column, out: str) -> DataFrame:
    """Rows since the flag last was not set, 0 where it is not set: the number of the last break is carried along, in one sort."""
    f = F.coalesce(flag, F.lit(False))
    d = df.withColumn("_f", f).withColumn("_n", F.row_number().over(over(keys, order)))
    last = F.coalesce(F.max(F.when(~F.col("_f"), F.col("_n"))).over(over(keys, order, None, 0)), F.lit(0))
    return d.withColumn(out, F.when(F.col("_f"), F.col("_n") - last).otherwise(0).cast("long")).drop("_f", "_n")


def strict_percentile(value: str, keys: list[str], order: list[str], n: int) -> Column:
    """Share of the last n values (today's included) that are below today's; NULL until n non-null values are there."""
    frame = F.collect_list(value).over(over(keys, order, -(n - 1), 0))
    below = F.size(F.filter(frame, lambda v: v < F.col(value)))
    return F.when(F.col(value).isNotNull() & (F.size(frame) == n), below / F.lit(n))


def zscore_prior(value: str, keys: list[str], order: list[str], n: int) -> Column:
    """Distance from the mean of the n rows before, in their standard deviations; NULL unless all n have a value."""
    w = over(keys, order, -n, -1)
    sd = F.stddev_samp(value).over(w)
    return F.when((F.count(value).over(w) == n) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd)


def full_mean(value: str, keys: list[str], order: list[str], n: int) -> Column:
    """Mean of the last n rows; NULL unless all have a value."""
    w = over(keys, order, -(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def rank_share(value: str, keys: list[str]) -> Column:
    """Percent rank with NULLs apart: they neither get a rank nor move the others' ."""
    return F.when(F.col(value).isNotNull(), F.percent_rank().over(W.partitionBy(*keys, F.col(value).isNull()).orderBy(value)))


def mid_rank(value: str, keys: list[str]) -> Column:
    """0-100 rank with ties averaged; 50 for a single value."""
    n = F.count(value).over(W.partitionBy(*keys))
    r = F.rank().over(W.partitionBy(*keys, F.col(value).isNull()).orderBy(value))
    ties = F.count(value).over(W.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.when(n == 1, F.lit(50.0)).otherwise((r + (ties - 1) / 2 - 1) / (n - 1) * 100))


def band(x: Column, cuts: list[float], names: list[str]) -> Column:
    """Right-open bands, the last closed: names[k] below cuts[k]."""
    out = None
    for c, n in zip(cuts, names, strict=False):
        out = F.when(x < c, n) if out is None else out.when(x < c, n)
    return F.when(x.isNotNull(), out.otherwise(names[-1]))


def rolling_median(value: str, keys: list[str], order: list[str], n: int) -> Column:
    """Median of the n rows before, at least one of them with a value."""
    a = F.array_sort(F.collect_list(value).over(over(keys, order, -n, -1)))
    m = F.size(a)
    return F.when(m > 0, (F.element_at(a, F.floor((m + 1) / 2).cast("int")) + F.element_at(a, F.floor(m / 2 + 1).cast("int"))) / 2)


def _frame(how: str, x: np.ndarray, ok: np.ndarray, pos: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Values, validity and number of values of one aggregate over the rows from lo to hi (hi <= 0) of each row; see frames().

    pos: the row's place in its key, from 0. Rows of the key before are no part of a frame.
    """
    if how == "row":
        return pos + 1.0, np.ones(len(x), bool), None
    if how in ("lag", "change", "move"):
        was, there = np.concatenate([np.zeros(-lo), x])[: len(x)], np.concatenate([np.zeros(-lo, bool), ok])[: len(ok)] & (pos >= -lo)
        if how == "lag":
            return was, there, None
        there = there & ok
        return (x / was - 1, there & (was != 0), None) if how == "change" else (np.abs(x - was), there, None)

    def view(a: np.ndarray, fill) -> np.ndarray:
        padded = np.concatenate([np.full(-lo, fill, a.dtype), a])
        return np.ndarray((len(a), hi - lo + 1), a.dtype, padded, 0, (padded.itemsize, padded.itemsize))

    valid = view(ok, False) & (pos[:, None] >= -np.arange(lo, hi + 1))
    n = valid.sum(axis=1)
    if how == "count":
        return n.astype(float), np.ones(len(x), bool), n
    if how == "max":  # NaN is the largest value
        return np.where(valid, view(x, 0.0), -np.inf).max(axis=1), n > 0, n
    if how == "min":
        v = view(x, 0.0)
        some = valid & ~np.isnan(v)
        return np.where(some.any(axis=1), np.where(some, v, np.inf).min(axis=1), np.nan), n > 0, n
    v = np.where(valid, view(x, 0.0), 0.0)
    if how == "sum":
        return v.sum(axis=1), n > 0, n
    if how == "below":
        less = np.where(np.isnan(x)[:, None], ~np.isnan(v), v < x[:, None])
        return (less & valid).sum(axis=1).astype(float), ok, n
    if how == "fall":
        top = np.maximum(np.maximum.accumulate(np.where(valid, v, -np.inf), axis=1), 0.0)
        return np.maximum(np.where(valid & (top != 0), 1 - v / top, 0.0).max(axis=1), 0.0), n > 0, n
    if how == "avg":
        return v.sum(axis=1) / n, n > 0, n
    # distances from the frame's greatest value first: those of equal values are 0 and not the error of their mean
    v = np.where(valid, v - np.where(valid, v, -np.inf).max(axis=1)[:, None], 0.0)
    off = np.where(valid, v - (v.sum(axis=1) / n)[:, None], 0.0)
    square = (off * off).sum(axis=1)
    if how == "var_pop":
        return square / n, n > 0, n
    if how == "stddev_pop":
        return np.sqrt(square / n), n > 0, n
    if how == "stddev_samp":
        return np.sqrt(square / (n - 1)), n > 1, n
    at = np.arange(hi - lo + 1.0)
    at = np.where(valid, at - ((valid * at).sum(axis=1) / n)[:, None], 0.0)
    xx, xy = (at * at).sum(axis=1), (at * off).sum(axis=1)
    return (xy / xx, xx > 0, n) if how == "slope" else (np.where(square == 0, 1.0, xy * xy / (xx * square)), xx > 0, n)


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row of t, sorted by keys, begins a key; NULL is a key of its own."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        a, b = t[k].combine_chunks().slice(1), t[k].combine_chunks().slice(0, max(t.num_rows - 1, 0))
        there = pc.xor(a.is_null(), b.is_null())
        new[1:] |= np.asarray(pc.or_(pc.fill_null(pc.not_equal(a, b), False), there))
    return new


#: Rows whose frames are worked out at once: their views stay in a core's cache.
BLOCK = 4096


def frames(df: DataFrame, keys: list[str], order: list[str], spec: dict[str, tuple[str, str, int, int]], dealt: bool = False) -> DataFrame:
    """df with a double for each name of spec: an aggregate over a column's frame of rows, (how, column, lo, hi), lo <= hi <= 0.

    Spark's own frames work every row's frame out again value by value; here the frames of a key are strided views, one array
    operation each, so many wide frames cost about as much as reading the rows. A key's rows are one task's: histories only.
    dealt: df is repartitioned by some of keys, so that many short keys are worked out at once; else a key is a group.

    how: count, sum, avg, min, max, var_pop, stddev_pop, stddev_samp; slope and r2 of a line over the frame's rows; below, how
    many values are less than the row's own; fall, the deepest fall from the highest value before; of the value lo rows back
    lag, change (the row's own divided by it, less 1; NULL if it is 0) and move (the absolute difference); row, its number in the key.
    Nulls are left out and NaN is the largest value, as in Spark; a frame without values is NULL. Of frames named full_* all
    values must be there. A column may be the name of an earlier frame.
    """
    fields = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in spec]])
    cast = {c for _, c, _, _ in spec.values() if c in df.columns}
    far = {}  # rows before a row that a frame depends on, those of the frames that it reads among them
    for name, (_, c, lo, _) in spec.items():
        far[name] = far.get(c, 0) - lo
    far = max(far.values(), default=0)

    def block(have: dict, pos: np.ndarray, lo: int, hi: int) -> dict:
        since = max(0, lo - far)
        have = {c: (x[since:hi], ok[since:hi]) for c, (x, ok) in have.items()}
        at = pos[since:hi]
        for name, (how, c, a, b) in spec.items():
            x, ok, n = _frame(how, *have[c], at, a, b)
            have[name] = (x, ok & (n == b - a + 1) if name.startswith("full_") else ok)
        return {name: (have[name][0][lo - since :], have[name][1][lo - since :]) for name in spec}

    def added(t: pa.Table, begins: np.ndarray) -> pa.Table:
        rows = np.arange(t.num_rows)
        pos = rows - np.maximum.accumulate(np.where(begins, rows, 0)) if t.num_rows else rows
        have = {}
        for c in cast:
            a = t[c].combine_chunks().cast(pa.float64())
            have[c] = (pc.fill_null(a, 0.0).to_numpy(zero_copy_only=False), np.asarray(pc.is_valid(a)))
        with np.errstate(all="ignore"):
            parts = [block(have, pos, k, min(k + BLOCK, t.num_rows)) for k in range(0, max(t.num_rows, 1), BLOCK)]
        for name in spec:
            x, ok = (np.concatenate([p[name][i] for p in parts]) for i in (0, 1))
            t = t.append_column(name, pa.array(np.where(ok, x, 0.0), pa.float64(), mask=~ok))
        return t

    def group(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in order], null_placement="at_start"))
        return added(t, np.arange(t.num_rows) == 0)

    def whole_keys(batches):
        rest, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            new = _begins(t if last is None else pa.concat_tables([last, t]), keys)[-b.num_rows :]
            last, at = t.slice(b.num_rows - 1), np.flatnonzero(new)
            if not len(at) or (len(at) == 1 and at[0] == 0 and not rest):
                rest.append(t)
                continue
            ready = pa.concat_tables([*rest, t.slice(0, at[-1])]).combine_chunks()
            yield from added(ready, _begins(ready, keys)).to_batches()
            rest = [t.slice(at[-1])]
        if rest:
            ready = pa.concat_tables(rest).combine_chunks()
            yield from added(ready, _begins(ready, keys)).to_batches()

    if dealt:
        return df.sortWithinPartitions(*keys, *order).mapInArrow(whole_keys, fields)
    return df.groupBy(*keys).applyInArrow(group, fields)
