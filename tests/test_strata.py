"""Matched samples and landing checks on literals."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import strata as T

D = dt.date(2020, 1, 1)


def test_quotas_are_met_and_samples_repeat(spark):
    pos = spark.createDataFrame([(i, D, s) for i, s in enumerate(["a"] * 10 + ["b"] * 3 + [None] * 4)], "code int, bottom date, s string")
    neg = spark.createDataFrame([(100 + i, D, s) for i, s in enumerate(["a"] * 50 + ["b"] * 2 + [None] * 9 + ["c"] * 5)], "code int, bottom date, s string")
    chosen, q = T.matched(pos, neg, ["s"], 1.5, ["code", "bottom"])
    assert {r.s: (r.positives, r.candidates, r.quota, r.taken) for r in q.collect()} == {"a": (10, 50, 15, 15), "b": (3, 2, 5, 2), None: (4, 9, 6, 6), "c": (0, 5, 0, 0)}
    got = sorted(r.code for r in chosen.collect())
    assert len(got) == 23 and len(set(got)) == 23
    assert sorted(r.code for r in T.matched(pos, neg.repartition(7).orderBy(F.desc("code")), ["s"], 1.5, ["code", "bottom"])[0].collect()) == got
    assert sorted(r.code for r in T.matched(pos, neg, ["s"], 1.5, ["code", "bottom"], "other")[0].collect()) != got
    assert T.matched(pos.limit(0), neg, ["s"], 1, ["code"])[0].count() == 0 and T.matched(pos, neg.limit(0), ["s"], 1, ["code"])[0].count() == 0


def test_nothing_is_drawn_within_the_purge_window(spark):
    from tidemark.operators.ladder import rally_negatives

    px = [10 + (k % 12) * 0.1 + (3 if k % 12 > 6 else 0) for k in range(200)]
    bars = spark.createDataFrame([(c, D + dt.timedelta(k), p, p * 1.01, p * 0.99, p) for c in (1, 2) for k, p in enumerate(px)], "code int, d date, open double, high double, low double, close double")
    hits = spark.createDataFrame([(1, D + dt.timedelta(96), "x"), (2, D + dt.timedelta(12), "x")], "code int, bottom date, s string")
    neg = rally_negatives(bars, hits, side=3, ahead=20, gain=0.6, purge=30, base=1, history=30, gap=5).withColumn("s", F.lit("x"))
    chosen, q = T.matched(hits, neg, ["s"], 2, ["code", "bottom"])
    got = chosen.collect()
    assert q.first().taken == len(got) == 4
    at = {(r.code, r.bottom) for r in hits.collect()}
    assert all(abs((r.bottom - d).days) > 30 for r in got for c, d in at if c == r.code)


def test_strata_are_one_to_one_and_as_known(spark):
    ep = spark.createDataFrame([(1, D, 3), (1, D + dt.timedelta(9), None), (2, D, 50), (None, D, -1)], "code int, bottom date, base_days int")
    mem = spark.createDataFrame([(1, D - dt.timedelta(9), D, "old"), (1, D - dt.timedelta(5), None, "new"), (2, D + dt.timedelta(1), None, "later")], "code int, since date, until date, sector string")
    seg = spark.createDataFrame([(1, D - dt.timedelta(1), "a"), (1, D, "b"), (2, D + dt.timedelta(1), "c")], "code int, d date, regime string")
    st = spark.createDataFrame([(1, D, "p"), (1, D, "q"), (2, D + dt.timedelta(1), "r")], "code int, d date, position string")
    got = {(r.code, r.bottom): (r.sector, r.regime, r.position, r.base_bucket) for r in T.stratified(ep, mem, seg, st, [("low", 0), ("high", 50)], (["sector"], ["regime"], ["position"])).collect()}
    assert got == {(1, D): ("new", "b", "q", "low"), (1, D + dt.timedelta(9)): ("new", "b", None, None), (2, D): (None, None, None, "high"), (None, D): (None, None, None, None)}
    none = {r.check: r.bad for r in T.landing_checks(ep.limit(0), {"x": F.col("base_days") > 0}, ["code"], ep).collect()}
    assert none == {"x": 0, "repeated": 0, "missing": 3, "unexpected": 0}


def test_interval_join_equals_a_look_at_every_span(spark):
    import random

    from tidemark.operators.relational import interval_join

    rng = random.Random(11)
    spans = [(rng.choice("ab"), s := rng.choice([None, *range(30)]), None if s is None else rng.choice([None, s - 1, s, s + rng.randint(1, 15)]), k) for k in range(40)]
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-2, 40)]), k % 5) for k in range(200)]
    for closed in (False, True):
        got = interval_join(spark.createDataFrame(left, "k string, t int, n int"), spark.createDataFrame(spans, "k string, s int, e long, v int"), ["k"], "t", "s", "e", ["v"], closed).collect()
        want = []
        for k, t, n in left:
            fit = [(s, v) for c, s, e, v in spans if c == k and t is not None and s is not None and s <= t and (e is None or e > t or (closed and e == t))]
            want.append((k, t, n, max(fit)[1] if fit else None))
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_rally_negatives_sort_bounded_numbers_of_bars(spark, monkeypatch):
    from tidemark import session
    from tidemark.operators.ladder import rally_negatives

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    d0 = dt.date(2020, 1, 1)
    rows = [(c, d0 + dt.timedelta(k), 10.0 + abs(k % 10 - 5) - 0.5, 10.0 + abs(k % 10 - 5) + 0.5, 10.0 + abs(k % 10 - 5)) for c in "abcd" for k in range(60)]
    bars = spark.createDataFrame(rows, "code string, d date, low double, high double, close double")
    hits = spark.createDataFrame([("a", d0 + dt.timedelta(25)), ("a", d0 + dt.timedelta(25)), ("z", d0)], "code string, bottom date")
    neg = rally_negatives(bars, hits, side=3, ahead=10, gain=0.9, purge=6, base=1, history=10, gap=11)
    assert neg.rdd.getNumPartitions() == 5
    # lows on days 5, 15, ...: 5 hides 15; day 25 of a is a hit
    assert sorted((r.code, (r.bottom - d0).days) for r in neg.collect()) == sorted([("a", 5), ("a", 35)] + [(c, k) for c in "bcd" for k in (5, 25, 45)])
