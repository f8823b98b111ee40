"""Classification of old records against new ones: exact, merged out of several, or residual."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import saved

#: Largest sum to leave out, in hundredths, and most rows of a group with negative amounts, that are searched; beyond them a group is `open`.
REACH, ROWS = 4096, 32
#: Groups that a task searches, about.
SEARCHES = 1000


def cents(amount: Column) -> Column:
    """Hundredths as a long, half up; a null counts as 0."""
    return F.coalesce((F.round(amount.cast("decimal(30,8)"), 2) * 100).cast("long"), F.lit(0).cast("long"))


def same(left: str, right: str, cols: list[str]) -> Column:
    """Null-safe equality of the columns of two aliases."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def least_dropped(values: np.ndarray, counts: np.ndarray, low: int, high: int) -> dict[int, int] | None:
    """The fewest of positive values (each at most counts times) with a sum from low to high, as {value: times}; None without any.

    Fewest rows by sum, value by value; of equally few the sum nearest to the middle, then the smaller one.
    """
    far = np.iinfo(np.int32).max // 2
    best = np.full(high + 1, far, np.int64)
    best[0] = 0
    taken = []
    for v, n in zip(values.tolist(), counts.tolist(), strict=True):
        times = np.zeros(high + 1, np.int32)
        new = best.copy()
        for k in range(1, min(n, high // v) + 1):
            more = np.full(high + 1, far, np.int64)
            more[k * v :] = best[: high + 1 - k * v] + k
            better = more < new
            new[better], times[better] = more[better], k
        best = new
        taken.append(times)
    window = np.arange(low, high + 1)
    reached = window[best[window] < far]
    if not len(reached):
        return None
    s = min(reached.tolist(), key=lambda x: (best[x], abs(2 * x - low - high), x))
    out = {}
    for v, times in zip(values[::-1].tolist(), taken[::-1], strict=True):
        k = int(times[s])
        if k:
            out[v] = k
            s -= k * v
    return out


def least_dropped_signed(values: np.ndarray, low: int, high: int) -> dict[int, int] | None:
    """least_dropped() for at most ROWS values of any sign, each once: the sums of both halves meet in the window."""
    halves = []
    for part in (values[: len(values) // 2], values[len(values) // 2 :]):
        sums, size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for v in part.tolist():
            sums, size = np.concatenate([sums, sums + v]), np.concatenate([size, size + 1])
        halves.append((part, sums, size))
    (left, ls, ln), (right, rs, rn) = halves
    by = {}
    for n in range(len(right) + 1):
        at = np.flatnonzero(rn == n)
        at = at[np.argsort(rs[at], kind="stable")]
        by[n] = (at, rs[at])
    for total in range(len(values) + 1):
        for n in range(max(0, total - len(right)), min(total, len(left)) + 1):
            at, sums = by[total - n]
            mine = np.flatnonzero(ln == n)
            first = np.searchsorted(sums, low - ls[mine])
            hit = np.flatnonzero((first < len(sums)) & (sums[np.minimum(first, len(sums) - 1)] + ls[mine] <= high))
            if len(hit):
                masks = ((left, int(mine[hit[0]])), (right, int(at[first[hit[0]]])))
                out: dict[int, int] = {}
                for part, mask in masks:
                    for i, v in enumerate(part.tolist()):
                        if mask >> i & 1:
                            out[v] = out.get(v, 0) + 1
                return out
    return None


def _searched(k: DataFrame, groups: DataFrame, group: list[str], tol: int, least: int) -> DataFrame:
    """(group..., cents, n_drop): what the searched groups leave out; groups without an answer have no row."""
    rows = k.filter("free > 0").alias("k").join(groups.filter("state = 'search'").alias("g"), same("k", "g", group))
    rows = rows.filter("low < 0 OR (cents > 0 AND cents <= diff + %d)" % tol).select(*[F.col(f"k.{c}").alias(c) for c in group], "cents", "free", "diff", "low", "n_free")
    # rows of one amount count once, and no more of them than the sum to leave out can hold
    rows = rows.groupBy(*group, "cents", "diff", "low", "n_free").agg(F.sum("free").alias("n"))
    rows = rows.withColumn("n", F.when(F.col("low") < 0, F.col("n")).otherwise(F.least("n", F.floor((F.col("diff") + tol) / F.col("cents")))))

    schema = rows.select(*group, F.col("cents").cast("long"), F.lit(0).cast("long").alias("n_drop")).schema
    for f in schema.fields:
        f.nullable = True
    # a group is one row; few bytes are much work, so the number of tasks follows that of the groups
    lists = rows.groupBy(*group, "diff", "low", "n_free").agg(F.sort_array(F.collect_list(F.struct("cents", F.col("n").cast("long").alias("n"))), False).alias("v"))
    tasks = -(-groups.filter("state = 'search'").count() // SEARCHES)
    names = [*group, "cents", "n_drop"]

    def run(batches):
        for b in batches:
            at, cents_, times = [], [], []
            v = b.column(b.schema.get_field_index("v"))
            ends, flat = v.offsets.to_numpy(), v.values
            values, counts = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            diffs, lows, frees = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("diff", "low", "n_free"))
            for k, (diff, low, free) in enumerate(zip(diffs, lows, frees, strict=True)):
                mine, n = values[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
                out = least_dropped_signed(np.repeat(mine, n), diff - tol, diff + tol) if low < 0 else least_dropped(mine, n, max(diff - tol, 0), diff + tol)
                if out and free - sum(out.values()) >= least:
                    at += [k] * len(out)
                    cents_ += out.keys()
                    times += out.values()
            mine = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[mine.column(b.schema.get_field_index(c)) for c in group], pa.array(cents_, pa.int64()), pa.array(times, pa.int64())], names=names)

    return lists.repartition(max(1, tasks), *group).mapInArrow(run, schema)


def classify_keys(
    old: DataFrame, new: DataFrame, key: list[str], group: list[str], amount: str, tol: int = 1, least: int = 2, reuse: bool = False, candidate: list[str] | None = None, close: tuple[list[str], float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Every old row as exact, merged or residual, and the new rows that answer for it. key holds group and amount.

    Returns (classes, parts). classes: one row for each key of old, with n_old = n_exact + n_merged + n_residual, left_as
    (null where nothing is left after exact matches) and n_parts. parts: one row for each key of new, with n_new, n_exact
    and n_part (n_exact + n_part <= n_new: a new row is used once).

    Exact are as many rows of a key as both sides have. What is left is taken group by group: it is merged if the group has
    at least as many free new rows as old ones are left, their amounts agree within tol hundredths for each old row left, and
    some `least` or more of the free new rows add up to the old ones within tol. Of such sets one that leaves out the fewest
    rows is taken, so a whole group is its own answer where its sums agree. left_as is then `merged`. Otherwise rows are
    residual: `none` if no new row has the same candidate columns, `candidate_close` if one has them with all columns of
    close[0] within close[1], else `candidate` (`residual`, if no candidate columns are named). `open` is the stated answer
    where no search is made: sums to leave out of more than REACH hundredths, or more than ROWS free rows with a negative one
    among them. reuse: new rows that match exactly may stand in a merged set too.

    Nulls equal each other in keys and groups; amounts are taken to two decimals, half up, null as 0. Repeated rows count as
    often as they stand. An empty old table gives no classes, an empty new one only residuals. Other columns are ignored.
    Sums and counts are formed before anything is grouped in one place; a searched group is a list of small amounts.
    """
    side = lambda df, o: df.select(*key, F.lit(o).alias("_o"), F.lit(1 - o).alias("_n"))
    k = side(old, 1).unionByName(side(new, 0)).groupBy(*key).agg(F.sum("_o").alias("n_old"), F.sum("_n").alias("n_new"))
    k = k.withColumn("n_exact", F.least("n_old", "n_new")).withColumn("left", F.col("n_old") - F.col("n_exact")).withColumn("free", F.col("n_new") - (F.lit(0) if reuse else F.col("n_exact")))
    k = saved(k.withColumn("cents", cents(F.col(amount))), "keys")
    g = k.groupBy(*group).agg(F.sum("left").alias("n_left"), F.sum("free").alias("n_free"), (F.sum(F.col("free") * F.col("cents")) - F.sum(F.col("left") * F.col("cents"))).alias("diff"), F.min(F.when(F.col("free") > 0, F.col("cents"))).alias("low")).filter("n_left > 0")
    fits = (F.col("n_free") >= F.greatest(F.col("n_left"), F.lit(least))) & (F.abs("diff") <= tol * F.col("n_left"))
    far = F.when(F.col("low") < 0, F.col("n_free") > ROWS).otherwise(F.col("diff") + tol > REACH)
    state = F.when(~fits, "none").when(F.abs("diff") <= tol, "whole").when((F.col("low") >= 0) & (F.col("diff") < 0), "none").when(far, "open").otherwise("search")
    g = saved(g.withColumn("state", state), "groups")
    drops = saved(_searched(k, g, group, tol, least), "left-out")
    solved = drops.groupBy(*group).agg(F.sum("n_drop").alias("dropped"))
    g = g.alias("g").join(solved.alias("s"), same("g", "s", group), "left").select("g.*", "s.dropped")
    g = saved(g.withColumn("state", F.when(F.col("state") == "search", F.when(F.col("dropped").isNotNull(), "solved").otherwise("none")).otherwise(F.col("state"))), "groups")

    # keys with nothing left, and those without a free new row, are answered without their group
    c = k.filter("n_old > 0 AND left > 0").alias("k").join(g.alias("g"), same("k", "g", group), "left").select("k.*", F.coalesce("g.state", F.lit("none")).alias("state"), (F.col("g.n_free") - F.coalesce("g.dropped", F.lit(0))).alias("n_set"))
    merged = F.col("state").isin("whole", "solved")
    c = c.withColumn("_hint", F.lit("residual"))
    if candidate:
        c = _hinted(c, new, key, candidate, close)
    left_as = F.when(merged, "merged").when(F.col("state") == "open", "open").otherwise(F.col("_hint"))
    classes = c.select(*key, "n_old", "n_exact", F.when(merged, F.col("left")).otherwise(0).cast("long").alias("n_merged"), F.when(merged, 0).otherwise(F.col("left")).cast("long").alias("n_residual"), left_as.alias("left_as"), F.when(merged, F.col("n_set")).alias("n_parts"))
    zero, null = F.lit(0).cast("long"), F.lit(None)
    classes = classes.unionByName(k.filter("n_old > 0 AND left = 0").select(*key, "n_old", "n_exact", zero.alias("n_merged"), zero.alias("n_residual"), null.cast("string").alias("left_as"), null.cast(classes.schema["n_parts"].dataType).alias("n_parts")))

    p = k.filter("n_new > 0 AND free > 0").alias("k").join(g.alias("g"), same("k", "g", group), "left").select("k.*", F.coalesce("g.state", F.lit("none")).alias("state"))
    p = p.alias("p").join(drops.alias("d"), same("p", "d", [*group, "cents"]), "left").select("p.*", F.coalesce("d.n_drop", F.lit(0)).alias("n_drop"))
    before = F.coalesce(F.sum("free").over(W.partitionBy(*group, "cents").orderBy(*key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("out", F.greatest(F.lit(0), F.least("free", F.col("n_drop") - before)))
    parts = p.select(*key, "n_new", "n_exact", F.when(F.col("state").isin("whole", "solved"), F.col("free") - F.col("out")).otherwise(0).cast("long").alias("n_part"))
    return classes, parts.unionByName(k.filter("n_new > 0 AND free = 0").select(*key, "n_new", "n_exact", zero.alias("n_part")))


def _hinted(c: DataFrame, new: DataFrame, key: list[str], candidate: list[str], close: tuple[list[str], float] | None) -> DataFrame:
    """c, of rows that are left, with _hint by the new rows of equal candidate columns. Near amounts meet in buckets as wide as the tolerance."""
    known = new.groupBy(*candidate).agg(F.count(F.lit(1)).alias("n_like"))
    c = c.alias("c").join(known.alias("w"), same("c", "w", candidate), "left").select("c.*", "w.n_like")
    hint = F.when(F.col("n_like").isNull(), "none")
    if close:
        cols, width = close
        value = lambda a, x: F.coalesce(F.col(f"{a}.{x}").cast("double"), F.lit(0.0))
        bucket = F.floor(F.coalesce(F.col(cols[0]).cast("double"), F.lit(0.0)) / width)
        near = new.select(*dict.fromkeys([*candidate, *cols])).distinct().withColumn("_b", bucket).alias("w")
        asked = c.select(*dict.fromkeys([*key, *candidate, *cols])).withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("c")
        within = reduce(lambda a, b: a & b, [F.abs(value("c", x) - value("w", x)) <= width for x in cols])
        found = asked.join(near, same("c", "w", candidate) & (F.col("c._b") == F.col("w._b")) & within, "left_semi").select(*key).distinct().withColumn("_close", F.lit(True))
        c = c.alias("c").join(found.alias("f"), same("c", "f", key), "left").select("c.*", "f._close")
        hint = hint.when(F.col("_close"), "candidate_close")
    return c.withColumn("_hint", hint.otherwise("candidate"))


def balance(classes: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """By group: old and new rows by what became of them, and whether every one is accounted for once."""
    a = classes.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n_old", "n_exact", "n_merged", "n_residual")])
    b = parts.groupBy(*group).agg(F.sum("n_new").alias("n_new"), F.sum("n_part").alias("n_part"), F.sum("n_exact").alias("_x"))
    j = a.alias("a").join(b.alias("b"), same("a", "b", group), "full")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c.rpartition(".")[2])
    j = j.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in group], *[n(c) for c in ("n_old", "n_exact", "n_merged", "n_residual", "n_new", "n_part", "_x")])
    whole = (F.col("n_exact") + F.col("n_merged") + F.col("n_residual") == F.col("n_old")) & (F.col("_x") == F.col("n_exact")) & (F.col("n_exact") + F.col("n_part") <= F.col("n_new"))
    return j.withColumn("balanced", whole).drop("_x")
