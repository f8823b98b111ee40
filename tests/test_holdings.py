"""Episodes on three bases, case by case."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import holdings as H

SCHEMA = "holder string, stock long, d date, seq long, kind string, shares double, change double, c1 double, c2 double, c3 double"
D = dt.date(2020, 1, 1)


def run(spark, *moves):
    rows = [("h", 1, D + dt.timedelta(30 * i), i, *m) for i, m in enumerate(moves)]
    return sorted((tuple(r[2:]) for r in H.cost_episodes(spark.createDataFrame(rows[::-1], SCHEMA)).collect()), key=str)


def day(i):
    return D + dt.timedelta(30 * i)


def test_bases_fall_back_and_exits_close_or_stay_unpriced(spark):
    got = run(spark, ("new", 100.0, None, 10.0, None, 12.0), ("add", 200.0, 100.0, 20.0, 0.0, None), ("trim", 150.0, -50.0, 30.0, 31.0, 32.0), ("exit", 0.0, None, 40.0, None, 44.0))
    [(opened, closed, status, seeded, peak, adds, trims, k1, k2, k3, g1, g2, g3)] = got
    assert (opened, closed, status, seeded, peak, adds, trims) == (day(0), day(3), "closed", False, 200.0, 1, 1)
    assert (k1, k2, k3) == (15.0, 15.0, 16.0)
    assert (g1, g2, g3) == (50 * 15 + 150 * 25, 50 * 16 + 150 * 25, 50 * 16 + 150 * 28)
    got = run(spark, ("add", 10.0, 5.0, 2.0, None, None), ("exit", None, None, None, 9.0, 9.0))
    assert got[0][:4] == (day(0), day(1), "unpriced_close", True) and got[0][10:] == (0.0, 0.0, 0.0)


def test_superseded_held_and_skipped_moves(spark):
    got = run(spark, ("exit", 0.0, None, 5.0, None, None), ("new", 10.0, None, 5.0, None, None), ("hold", 99.0, None, 6.0, None, None), ("new", 20.0, None, 7.0, None, None), ("add", 30.0, 10.0, None, 9.0, 9.0), ("odd", 1.0, 1.0, 9.0, 9.0, 9.0), ("trim", None, -50.0, 8.0, None, None), ("hold", None, None, float("nan"), None, None))
    assert [(x[0], x[1], x[2], x[4]) for x in got] == [(day(1), day(3), "superseded", 10.0), (day(3), None, "holding", 20.0)]
    assert got[0][10] == 20.0 and got[1][10] == 20.0  # a trim sells what there is at most
    assert run(spark, ("new", 0.0, None, 0.0, 3.0, 0.0), ("exit", None, None, 4.0, 4.0, 4.0))[0][7:] == (0.0, 3.0, 0.0, 0.0, 0.0, 0.0)
    assert H.cost_episodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_window_prices_on_literals(spark):
    bars = spark.createDataFrame([(1, day(0), 10.0, 1.0), (1, day(1), 20.0, 3.0), (1, day(2), 30.0, 0.0), (1, day(5), 40.0, 2.0), (2, day(0), 5.0, 1.0)], "code long, d date, close double, vol double")
    reports = spark.createDataFrame([(1, day(1)), (1, day(1)), (1, day(2)), (1, day(6)), (1, day(9)), (3, day(1)), (None, day(1))], "code long, d date")
    seats = spark.createDataFrame([(1, day(0), -1.0), (1, day(1), 1.0), (1, day(1), 2.0), (1, day(5), 0.0)], "code long, d date, net double")
    got = {(r.code, r.d): (r.start, r.c1, r.c2, r.c3) for r in H.window_prices(reports, bars, seats).collect()}
    assert got[1, day(1)] == (day(1) - dt.timedelta(92), 17.5, 20.0, 17.5)
    assert got[1, day(2)] == (day(1), None, 30.0, None) and got[1, day(6)] == (day(2), 40.0, 40.0, None)
    assert got[1, day(9)] == (day(6), None, 40.0, None) and got[3, day(1)][1:] == (None, None, None) and len(got) == 5


def test_window_prices_carry_the_next_report_along(spark):
    """No frame to the end of a code's history, which is worked out anew for every row."""
    b = spark.createDataFrame([("a", dt.date(2020, 1, k), 1.0 * k, 2.0) for k in range(1, 29)], "code string, d date, close double, vol double")
    r = b.filter("day(d) IN (10, 20)").select("code", "d")
    p = H.window_prices(r, b, b.select("code", "d", F.col("vol").alias("net")).limit(0))
    assert "currentrow$(), unboundedfollowing$()" not in p._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(x.d.day, x.c1, x.c2) for x in sorted(p.collect())] == [(10, 5.5, 10.0), (20, 15.5, 20.0)]
