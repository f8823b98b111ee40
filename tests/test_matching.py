"""Classification of keys against all subsets, and its stated answers."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching as M

SCHEMA = "g string, f string, q decimal(12,2)"


def plainly(old, new, tol=1, least=2, reuse=False):
    """(kind, fewest left out) of each group with rows left, by trying every subset; exact counts by key."""
    o, n = Counter(old), Counter(new)
    exact = {k: min(o[k], n[k]) for k in o}
    left, free = defaultdict(list), defaultdict(list)
    for k in o:
        left[k[0]] += [k[2]] * (o[k] - exact[k])
    for k in n:
        free[k[0]] += [k[2]] * (n[k] - (0 if reuse else min(o[k], n[k])))
    out = {}
    for g, old_c in left.items():
        if not old_c:
            continue
        new_c, sizes = free[g], []
        if len(new_c) >= max(len(old_c), least) and abs(sum(new_c) - sum(old_c)) <= tol * len(old_c):
            sizes = [m for m in range(least, len(new_c) + 1) for s in itertools.combinations(new_c, m) if abs(sum(s) - sum(old_c)) <= tol]
        out[g] = max(sizes, default=None)
    return exact, out


def groups(seed, low):
    rng = random.Random(seed)
    old, new = [], []
    for i in range(70):
        g = rng.choice([f"g{i}", f"g{i}", None])
        parts = [rng.choice([rng.randint(low, 6), rng.randint(50, 400), 0]) for _ in range(rng.randint(0, 10))]
        mine = [sum(parts[a::3]) for a in range(rng.randint(1, 3))]
        if rng.random() < 0.5:
            mine = [sum(parts)] + [0] * rng.randint(0, 3)
        mine[0] += rng.choice([0, 0, 1, -1, 2, -2, 7])
        if g is None and any(x[0] is None for x in new):
            continue
        old += [(g, "a", x) for x in mine]
        new += [(g, rng.choice("ab"), x) for x in parts]
    return old, new


@pytest.mark.parametrize(("seed", "low", "reuse", "tol"), [(1, 1, False, 1), (2, 1, True, 1), (3, -6, False, 2), (4, -6, True, 1)])
def test_classes_equal_all_subsets(spark, seed, low, reuse, tol):
    old, new = groups(seed, low)
    df = lambda rows: spark.createDataFrame([(g, f, c) for g, f, c in rows], "g string, f string, c long").select("g", "f", (F.col("c") / 100).cast("decimal(12,2)").alias("q"), F.lit(1).alias("state"))
    classes, parts = M.classify_keys(df(old), df(new), ["g", "f", "q"], ["g"], "q", tol, reuse=reuse)
    exact, sets = plainly(old, new, tol, reuse=reuse)
    got, seen = classes.collect(), set()
    for r in got:
        k = (r.g, r.f, int(r.q * 100))
        left = old.count(k) - exact[k]
        want = sets.get(r.g) if left else None
        assert (r.n_old, r.n_exact, r.n_merged, r.n_residual, r.n_parts) == (old.count(k), exact[k], left if want else 0, 0 if want else left, want)
        assert r.left_as == (None if not left else "merged" if want else "residual")
        seen.add(k)
    assert seen == set(old) and len(got) == len(seen)
    # what is named as parts adds up, and no new row is used twice
    total, want = Counter(), Counter()
    for r in parts.collect():
        assert r.n_new == new.count((r.g, r.f, int(r.q * 100))) and r.n_part + (0 if reuse else r.n_exact) <= r.n_new
        total[r.g] += int(r.q * 100) * r.n_part
    for r in got:
        want[r.g] += int(r.q * 100) * r.n_merged
    assert all(abs(total[g] - want[g]) <= tol for g in set(total) | set(want))
    if not reuse:
        assert all(r.balanced for r in M.balance(classes, parts, ["g"]).collect())
    assert any(sets.values()) and not all(sets.values())


def test_large_groups_and_empty_tables(spark):
    """A hundred thousand equal rows in one group; sums beyond the reach stay open; nothing comes of nothing."""
    many = spark.range(100_000).select(F.lit("hot").alias("g"), F.lit("x").alias("f"), F.lit(0.01).cast("decimal(12,2)").alias("q"))
    one = spark.createDataFrame([("hot", "y", 999.98), ("hot", "z", 0.0), ("hot", "z", 0.0), ("far", "x", 1.0)], "g string, f string, q double").withColumn("q", F.col("q").cast("decimal(12,2)"))
    classes, parts = M.classify_keys(one, many, ["g", "f", "q"], ["g"], "q")
    got = {(r.g, r.f): (r.left_as, r.n_parts) for r in classes.collect()}
    assert got == {("hot", "y"): ("merged", 99_999), ("hot", "z"): ("merged", 99_999), ("far", "x"): ("residual", None)}
    assert [r.n_part for r in parts.collect()] == [99_999]
    signed = spark.createDataFrame([("s", "x", -0.5)] + [("s", "x", 0.03 * i) for i in range(M.ROWS)], "g string, f string, q double").withColumn("q", F.col("q").cast("decimal(12,2)"))
    total = float(signed.agg(F.sum("q")).first()[0])
    whole = spark.createDataFrame([("s", "t", total), ("s", "u", 0.02)], "g string, f string, q double").withColumn("q", F.col("q").cast("decimal(12,2)"))
    assert {r.left_as for r in M.classify_keys(whole, signed, ["g", "f", "q"], ["g"], "q")[0].collect()} == {"open"}
    assert {r.left_as for r in M.classify_keys(one, many.limit(0), ["g", "f", "q"], ["g"], "q")[0].collect()} == {"residual"}
    assert M.classify_keys(one.limit(0), many, ["g", "f", "q"], ["g"], "q")[0].count() == 0


def test_hints_of_residuals(spark):
    old = spark.createDataFrame([("a", "x", 10.0), ("b", "x", 10.0), ("c", "x", 10.0), ("d", "x", None)], "g string, f string, q double")
    new = spark.createDataFrame([("a", "y", 10.0), ("b", "x", 14.9), ("b", "x", 500.0), ("c", "x", 15.1), ("d", "x", 3.0)], "g string, f string, q double")
    classes, _ = M.classify_keys(old, new, ["g", "f", "q"], ["g"], "q", candidate=["g", "f"], close=(["q"], 5.0))
    assert {r.g: r.left_as for r in classes.collect()} == {"a": "none", "b": "candidate_close", "c": "candidate", "d": "candidate_close"}


def test_searches_are_spread(spark, monkeypatch):
    """Groups that are searched take few bytes and much work, so their tasks follow their number."""
    monkeypatch.setattr(M, "SEARCHES", 10)
    side = lambda *q: spark.range(95).select(F.col("id").cast("string").alias("g"), F.lit("x").alias("f"), F.explode(F.array(*[F.lit(x).cast("decimal(12,2)") for x in q])).alias("q"))
    old, new = side(0.7, 0.3), side(0.4, 0.6, 0.02)
    tasks, real = [], M._searched

    def counted(*args):
        out = real(*args)
        tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(M, "_searched", counted)
    classes, _ = M.classify_keys(old, new, ["g", "f", "q"], ["g"], "q")
    assert tasks == [10] and {(r.left_as, r.n_parts) for r in classes.collect()} == {("merged", 2)}
