"""Operators on literals: boundaries, NULLs, ties, empty inputs and sequential state."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators import calendar as C
from tidemark.operators import flow as L
from tidemark.operators import ladder as R2
from tidemark.operators import price as P
from tidemark.operators import relational as R
from tidemark.operators import research as S
from tidemark.operators import technical as T
from tidemark.operators import windows as X
from tidemark.sources import binary, sinks

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def bars(spark, data):
    return spark.createDataFrame([(c, D(i), *map(float, x)) for c, i, *x in data], "code long, d date, open double, high double, low double, close double, vol double, amount double")


def flat(spark, closes, code=1):
    return bars(spark, [(code, i, c, c, c, c, 100, 100 * c) for i, c in enumerate(closes)])


def test_asof_join_takes_latest_and_keeps_gaps(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("a", None), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("a", None, 1), ("c", 1, 7)], "k string, t2 int, v int")
    got = rows(R.asof_join(left, right, ["k"], "t", "t2", ["v"]), "k", "t")
    assert got == [("a", None, None), ("a", 1, None), ("a", 5, 51), ("a", 5, 51), ("b", 9, None)]
    assert R.asof_join(left, right.limit(0), ["k"], "t", "t2", ["v"]).filter("v IS NOT NULL").count() == 0


def test_interval_join_newest_wins_and_end_is_open(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t int")
    spans = spark.createDataFrame([("a", 1, 10, "old"), ("a", 5, None, "new"), ("a", 3, 20, "mid")], "k string, s int, e int, v string")
    assert rows(R.interval_join(left, spans, ["k"], "t", "s", "e", ["v"]), "k", "t") == [("a", 10, "new"), ("a", 20, "new"), ("b", 5, None)]
    short = spans.filter("v = 'old'")
    assert rows(R.interval_join(left, short, ["k"], "t", "s", "e", ["v"]), "k", "t")[0][2] is None
    assert rows(R.interval_join(left, short, ["k"], "t", "s", "e", ["v"], closed=True), "k", "t")[0][2] == "old"


def test_multiset_compare_counts_copies_and_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert rows(R.multiset_compare(a, b, ["x"]), "x") == [(None, 1, 1, 1, 0, 0), (1, 2, 1, 1, 1, 0), (2, 0, 1, 0, 0, 1)]


def test_facet_page_says_whether_more_rows_pass(spark):
    d = spark.range(5).withColumn("g", F.lit(1))
    got = R.facet_page(d, {"g": 1, "id": None}, [F.asc("id")], 3).collect()
    assert [(r.id, r.truncated) for r in got] == [(0, True), (1, True), (2, True)]
    assert not R.facet_page(d, {"g": 1}, [F.asc("id")], 5).first().truncated


def test_streaks_and_runs(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, -1.0, 0.0, 0.0, 3.0, None, 4.0])], "k string, t int, x double")
    assert [r.streak for r in X.signed_streak(d, ["k"], ["t"], "x").orderBy("t").collect()] == [1, 2, -1, 0, 0, 1, None, 1]
    assert [r.n for r in X.run_length(d, ["k"], ["t"], F.col("x") > 0, "n").orderBy("t").collect()] == [1, 2, 0, 0, 0, 1, 0, 1]


def test_percentile_zscore_and_ranks(spark):
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 3])], "k string, t int, x double")
    assert [r.p for r in d.select("t", X.strict_percentile("x", ["k"], ["t"], 3).alias("p")).orderBy("t").collect()] == [None, None, 2 / 3, 1 / 3]
    z = [r.z for r in d.select("t", X.zscore_prior("x", ["k"], ["t"], 2).alias("z")).orderBy("t").collect()]
    assert z[:2] == [None, None] and z[2] == pytest.approx(1.5 / np.std([1, 2], ddof=1))
    r = {x.t: x.p for x in d.select("t", X.mid_rank("x", ["k"]).alias("p")).collect()}
    assert r[0] == 0 and r[2] == r[3] == pytest.approx(2.5 / 3 * 100)
    e = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 2.0)], "k string, x double")
    assert [x[0] for x in e.orderBy(F.col("x").asc_nulls_first()).select(X.rank_share("x", ["k"]).alias("s"), "x").orderBy(F.col("x").asc_nulls_first()).select("s").collect()] == [None, 0.0, 1.0]


def test_adjustment_ratio_kinds_and_factors(spark):
    b = spark.createDataFrame([(1, D(0), 10.0, None), (1, D(1), 10.0, 10.004), (1, D(2), 5.0, 5.0), (1, D(3), 5.0, None), (1, D(4), 5.0, 0.1)], "code long, d date, close double, pre_close double")
    r = P.adjustment_ratio(b)
    assert [x.ratio_kind for x in r.orderBy("d").collect()] == ["first_day", "no_event", "adjusted", "missing_input", "out_of_bounds"]
    f = P.forward_factor(P.backward_factor(r.filter("ratio IS NOT NULL")))
    assert [round(x.hfq, 9) for x in f.orderBy("d").collect()] == [1, 1, 2] and f.orderBy(F.desc("d")).first().qfq == 1
    assert [x.hfq is None for x in P.backward_factor(r).orderBy("d").collect()] == [False, False, False, True, True]


def test_chip_distribution_renews_by_turnover(spark):
    b = flat(spark, [10, 20]).withColumn("turnover", F.when(F.col("close") == 10, F.lit(None)).otherwise(0.25))
    got = P.chip_distribution(b).orderBy("d").collect()
    assert got[0].winner == 0 and got[1].winner == pytest.approx(0.75) and got[1].cost_mean == pytest.approx(12.5)


def test_calendar(spark):
    cal = C.trading_days(spark.createDataFrame([(D(i),) for i in (0, 1, 2, 3, 4, 7, 8)], "d date"))
    q = spark.createDataFrame([(D(1), D(7)), (D(4), D(5)), (D(0), D(99)), (D(8), D(8))], "a date, b date")
    assert [r.days for r in C.days_since(q, cal, "a", "b").orderBy("a").collect()] == [None, 4, 0, 0]
    with pytest.raises(Exception, match="availability"):
        C.pit(spark.createDataFrame([(D(0), None)], "a date, e date"), F.lit(D(3)), "a", "e").collect()


def test_pattern_matches_backwards_in_window(spark):
    d = spark.createDataFrame([(1, D(i), x) for i, x in enumerate("abxcacb")], "code long, d date, l string")
    assert [r.h for r in d.withColumn("h", T.pattern(d, "l", ["a", "b", "c"], 4)).orderBy("d").collect()] == [False, False, False, True, False, False, False]


def test_majority_ties_take_first_seen(spark):
    d = spark.createDataFrame([(1, D(i), x) for i, x in enumerate("baabc")], "code long, d date, l string")
    assert [r.m for r in d.withColumn("m", T.majority_before("l", 4)).orderBy("d").collect()] == [None, "b", "b", "a", "b"]


def test_formula_primitives():
    c = np.array([False, True, False, False, True, True])
    assert T.bars_last(c).tolist() == [1_000_000, 0, 1, 2, 0, 0]
    assert T.bars_last_count(c).tolist() == [0, 1, 0, 0, 1, 2]
    assert T.cooldown(c, 4).tolist() == [False, True, False, False, False, True]
    assert T.cross(np.array([1.0, 3, 3, np.nan, 5]), np.array([2.0, 2, 2, 2, 2])).tolist() == [False, True, False, False, False]
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(T.ema(x, 3), [1, 1.5, 2.75]) and np.isnan(T.ma(x, 2)[0])


def test_features_do_not_change_when_the_future_is_cut(spark):
    rng = np.random.default_rng(1)
    b = flat(spark, (10 + rng.random(60)).tolist())
    full, part = T.features(b), T.features(b.filter(F.col("d") <= F.lit(D(40))))
    assert rows(full.filter(F.col("d") <= F.lit(D(40))), "d") == rows(part, "d")


def test_annotate_regimes(spark):
    d = spark.createDataFrame([(1, D(i), n, p) for i, (n, p) in enumerate([(1.0, 0.1)] * 3 + [(-1.0, -5.0)] * 3 + [(None, 0.0)])], "code long, d date, net double, pct double")
    assert [r.regime for r in L.annotate(d, ["code"], prior=50, run=3).orderBy("d").collect()] == ["neutral", "neutral", "accum_in_silent", "neutral", "neutral", "accum_out_driving", None]


def test_greedy_count_and_pair_stats(spark):
    d = spark.createDataFrame([([1, 4, 11, 12],), ([],)], "p array<long>")
    assert [r[0] for r in d.select(S.greedy_count(F.col("p"), 9)).collect()] == [2, 0]


def test_outcome_is_censored_at_the_end(spark):
    o = S.outcome(flat(spark, [10, 11, 12, 13]), 1).orderBy("d").collect()
    assert [r.censored for r in o] == [False, False, True, True] and o[0].ret == pytest.approx(12 / 11 - 1)


def test_episode_machine(spark):
    m = [(1, 1, D(0), 0, "new", 10.0, 5.0), (1, 1, D(1), 0, "add", 20.0, 7.0), (1, 1, D(2), 0, "trim", 5.0, 8.0), (1, 1, D(3), 0, "exit", None, 9.0), (1, 1, D(4), 0, "hold", 3.0, 9.0), (1, 1, D(5), 0, "new", 4.0, 9.0), (1, 1, D(6), 0, "exit", None, None), (2, 1, D(0), 0, "add", 1.0, None)]
    e = S.episodes(spark.createDataFrame(m, "holder long, stock long, d date, seq long, kind string, shares double, price double")).orderBy("opened").collect()
    assert [(x.status, x.seeded) for x in e] == [("closed", False), ("superseded", True), ("unpriced_close", False)]
    assert e[0].cost == 6 and e[0].realized == 15 * 2 + 5 * 3 and e[0].ret == pytest.approx(45 / 120)


def test_episodes_equal_a_walk_move_by_move(spark):
    import random

    rng = random.Random(4)
    moves = [(rng.randint(0, 5), rng.randint(0, 3), D(rng.randint(0, 40)), k, rng.choice(["new", "add", "trim", "hold", "exit"]), rng.choice([None, 1.0, 5.0, 8.0, 20.0]), rng.choice([None, float("nan"), 2.0, 3.5, 7.0])) for k in range(600)]
    want = []
    for key in sorted({m[:2] for m in moves}):
        at = None  # opened, seeded, shares, peak, cost, realized

        def end(status, day, key=key):
            o, seeded, _, peak, cost, got = at
            want.append((*key, o, day, status, seeded, peak, round(cost, 6), round(got, 6), round(got / (cost * peak), 6) if cost * peak > 0 else None))

        for _, _, d, _, kind, n, px in sorted((m for m in moves if m[:2] == key), key=lambda m: (m[2], m[3])):
            known = px is not None and px == px
            if kind == "exit":
                if at:
                    at[5] += at[2] * (px - at[4]) if known else 0
                    end("closed" if known else "unpriced_close", d)
                at = None
            elif known and n is not None:
                if at and kind == "new":
                    at[5] += at[2] * (px - at[4])
                    end("superseded", d)
                    at = None
                if at is None:
                    at = [d, kind != "new", n, n, px, 0.0]
                elif kind != "hold":
                    if n > at[2]:
                        at[4] = (at[4] * at[2] + (n - at[2]) * px) / n
                    else:
                        at[5] += (at[2] - n) * (px - at[4])
                    at[2], at[3] = n, max(at[3], n)
        if at:
            end("holding", None)
    got = S.episodes(spark.createDataFrame(moves, "holder long, stock long, d date, seq long, kind string, shares double, price double")).collect()
    r6 = lambda v: None if v is None else round(v, 6)
    assert sorted(map(str, ((r.holder, r.stock, r.opened, r.closed, r.status, r.seeded, r.peak_shares, r6(r.cost), r6(r.realized), r6(r.ret)) for r in got))) == sorted(map(str, want))


def test_rally_scan_goes_on_past_the_peak(spark):
    px = [9, 8, 5, 6, 7, 9, 8, 7, 6, 7, 8, 9]
    got = S.rally_scan(flat(spark, px), side=2, ahead=5, gain=0.5, least=2).collect()
    assert sorted((r.bottom, r.peak, r.days) for r in got) == [(D(2), D(5), 3), (D(8), D(11), 3)]


def test_event_hold_never_overlaps(spark):
    b = flat(spark, [10, 11, 12, 13, 14, 15, 16])
    ev = spark.createDataFrame([(1, D(0), "entry"), (1, D(1), "entry"), (1, D(2), "exit"), (1, D(4), "entry")], "code long, d date, kind string")
    got = S.event_hold(ev, b, 30, 2).orderBy("entered").collect()
    assert [(r.entered, r.left, r.status) for r in got] == [(D(1), D(3), "closed"), (D(5), None, "window_end")]


def test_reject_codes_first_rule_wins(spark):
    d = spark.createDataFrame([(1, None), (2, -1.0), (3, 5.0), (3, 6.0), (4, 1.0)], "k int, v double")
    got = rows(A.reject_codes(d, [("NULL", F.col("v").isNull()), ("NEG", F.col("v") < 0)], ["k"]).select("k", "reject_code"), "k", "v")
    assert got == [(1, "NULL"), (2, "NEG"), (3, "DUPLICATE_GRAIN"), (3, "DUPLICATE_GRAIN"), (4, None)]


def test_lineage_impact_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = rows(A.lineage_impact(e, spark.createDataFrame([("a",)], "root string"), 9), "distance")
    assert got == [("a", "b", 1), ("a", "c", 2)]


def test_near_has_no_null(spark):
    d = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (100.0, 101.0)], "a double, b double")
    assert [r[0] for r in d.select(A.near(F.col("a"), F.col("b"), 0.1, 0.02)).collect()] == [True, False, True]


def test_publish_keeps_the_old_table_when_a_check_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path)
    with pytest.raises(ValueError):
        sinks.publish(spark.range(1), path, sinks.floor(2))
    assert spark.read.parquet(path).count() == 3
    sinks.upsert(spark.range(2, 5), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_replace_partitions_and_frontier(spark, tmp_path):
    path = str(tmp_path / "p")
    d = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    sinks.replace_partitions(d, path, ["p"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert sorted((r.v, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]
    f = str(tmp_path / "f")
    e = spark.createDataFrame([("x", 1), ("x", 2)], "k string, d int")
    sinks.append_frontier(e, f, "k", "d")
    sinks.append_frontier(spark.createDataFrame([("x", 2), ("x", 3), ("y", 1)], "k string, d int"), f, "k", "d")
    assert spark.read.parquet(f).count() == 4


def test_binary_readers(spark, tmp_path):
    a = np.zeros(2, binary.DAY)
    a["date"], a["open"], a["close"], a["vol"], a["amount"] = [20240102, 20241399], [1000, 1], [1010, 1], [7, 1], [70.5, 1]
    (tmp_path / "sh600000.day").write_bytes(a.tobytes() + b"torn")
    m = np.zeros(1, binary.MINUTE_FLOAT)
    m["day"], m["minute"], m["close"] = (2024 - 2004) * 2048 + 102, 9 * 60 + 31, 1.5
    (tmp_path / "sh600000.lc5").write_bytes(m.tobytes())
    d = binary.read_day(spark, str(tmp_path)).collect()
    assert [(r.code, r.ts, r.open, r.close, r.vol) for r in d] == [("sh600000", dt.datetime(2024, 1, 2), 10.0, pytest.approx(10.1), 7.0)]
    assert binary.read_minute_float(spark, str(tmp_path)).first().ts == dt.datetime(2024, 1, 2, 9, 31)


def test_streaming_windows(spark, tmp_path):
    from tidemark.streaming import events as E

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    q = E.tumbling(E.read_events(spark, "/root/testdata/sf0.001", src.schema, glob="events.parquet")).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == src.filter("ts IS NOT NULL").count()


def test_limit_days_tell_no_source_from_no_limits(spark):
    x = spark.createDataFrame([(1, D(0), "U", 1, "92500"), (2, D(0), "U", 2, "100000"), (3, D(0), "Z", None, None), (1, D(1), "U", 2, "93059"), (2, D(1), "U", None, "93100"), (3, D(3), "D", None, None), (1, D(4), "U", 3, None)], "code long, d date, kind string, times int, first_time string")
    got = rows(R2.limit_days(spark.createDataFrame([(D(i),) for i in range(5)], "d date"), x).select("d", "up", "highest", "early", "promotion", "broken_rate", "ladder"), "d")
    assert [r[1:] for r in got] == [(2, 2, 1, None, 1 / 3, '{"1":1,"2":1}'), (2, 2, 1, 0.5, 0.0, '{"2":1}'), (None,) * 6, (0, 0, 0, 0.0, None, "{}"), (1, 3, 0, None, 0.0, '{"3":1}')]


def test_held_trades_wait_for_a_bar_that_trades(spark):
    b = bars(spark, [(1, i, c, c, c, c, v, c * v) for i, (c, v) in enumerate([(10, 1), (11, 1), (12, 0), (12, 1), (10.8, 1), (10, 0), (10.5, 1)])])
    got = rows(R2.held_trades(b.select("code", "d"), b, F.lit(0.1), 1, 2).select("d", "status", "bought", "sold", F.round("ret", 6)), "d")
    # day 1 closes at its upper limit, day 4 at its lower one, days 2 and 5 have no volume
    late = ("closed", D(3), D(6), round(10.5 / 12 - 1, 6))
    assert got[:3] == [(D(k), *late) for k in range(3)] and got[3] == (D(3), "closed", D(4), D(6), round(10.5 / 10.8 - 1, 6))
    assert [(r[1], r[2]) for r in got[-2:]] == [("open", D(6)), ("unfilled", None)]


def test_spaced_and_funnel(spark):
    assert spark.createDataFrame([([9, 1, 3, 5, 6],), ([],)], "p array<long>").select(R2.spaced(F.col("p"), 4)).collect()[0][0] == [1, 5, 9]
    d = spark.createDataFrame([(1, None), (2, True), (3, False)], "x int, y boolean")
    assert rows(R2.funnel(d, [("big", F.col("x") > 1), ("y", F.col("y"))]), "step") == [(0, "all", 3), (1, "big", 2), (2, "y", 1)]
    assert rows(R2.funnel(d.limit(0), [("y", F.col("y"))]), "step") == [(0, "all", 0), (1, "y", 0)]


def test_ext_days_and_blocks(spark, tmp_path):
    a = np.zeros(2, binary.EXT_DAY)
    a["date"], a["close"], a["vol"], a["settle"], a["amount"] = [20240102, 20241399], [1.5, 1], [7, 1], [1.25, 1], [np.float32(2.5).view("<u4"), 1]
    (tmp_path / "28#CU.day").write_bytes(a.tobytes() + b"torn")
    r = binary.read_ext_day(spark, str(tmp_path)).collect()
    assert [(x.code, x.ts, x.close, x.vol, x.settle, x.amount_float) for x in r] == [("28#CU", dt.datetime(2024, 1, 2), 1.5, 7.0, 1.25, 2.5)]
    b = np.zeros(2, binary.BLOCK)
    b[0]["name"], b[0]["n"], b[0]["kind"] = "银行".encode("gbk"), 2, 2
    b[0]["codes"][0], b[0]["codes"][1] = b"600000", b"000001"
    (tmp_path / "block_gn.dat").write_bytes(bytes(384) + (3).to_bytes(2, "little") + b.tobytes())
    (tmp_path / "block_no.dat").write_bytes(b"")
    assert rows(binary.read_blocks(spark, str(tmp_path)), "seq") == [("block_gn", "银行", 2, 0, "600000"), ("block_gn", "银行", 2, 1, "000001")]


def test_special_prefix(spark):
    n = spark.createDataFrame([(D(0), 1, "*ST a"), (D(0), 2, "SST b"), (D(0), 3, "BEST"), (D(0), 4, None)], "d date, code int, name string")
    f = spark.createDataFrame([(D(0), 3, True), (D(1), 1, True)], "d date, code int, flag boolean")
    need = spark.createDataFrame([(D(0), 1), (D(1), 1), (D(2), 1)], "d date, code int")
    assert rows(R2.special_members(need, n, f), "d", "code") == [(D(0), 1, "names"), (D(0), 2, "names"), (D(1), 1, "flags")]
    assert rows(R2.special_paths(need, n, f), "d") == [(D(0), "names", 1), (D(1), "flags", 0), (D(2), None, 1)]


def test_segments_by_day_ties_amounts_whose_sums_differ_in_the_last_bit(spark, tmp_path):
    from tidemark.plans.domain import segments_by_day

    at = dt.datetime(2024, 1, 4, 9)
    users = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [5.0], 4: [6.0], 5: [7.0], 6: [0.01]}
    rows = [(10 * u + i, at + dt.timedelta(seconds=i), u, v) for u, vs in users.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert {r["code"]: r["cap_band"] for r in segments_by_day(spark, str(tmp_path)).collect() if r["code"] < 3} == {1: "small", 2: "small"}


def test_segments_by_day_adds_amounts_up_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tidemark.plans import domain

    rng, at = random.Random(1), dt.datetime(2024, 1, 4, 9)
    rows = [(k, at + dt.timedelta(seconds=k), rng.randrange(2000), rng.randrange(1, 60) / 100) for k in range(6000)]
    rows += [(6000, at, 3000, 1e-9), (6001, at, 3001, 2e-9), (6002, at, None, 1.0), (6003, None, 1, 1.0), (6004, at, 1, None), (6005, at, 3002, float("nan"))]
    rng.shuffle(rows)  # files in any order give the same bands; the SQL reads them in the order of events
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE TABLE events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    want = sorted(c.execute(domain.ORACLE["segments_by_day"]).fetchall())
    assert sorted(tuple(r) for r in domain.segments_by_day(spark, str(tmp_path)).collect()) == want


def test_array_frames_equal_sparks_frames(spark):
    rng = random.Random(5)
    draw = lambda: rng.choice([None, float("nan"), 0.0, 1.0, -1.0]) if rng.random() < 0.3 else rng.uniform(1, 9)
    rows = [(c, k, draw()) for c in (1, 2, None) for k in rng.sample(range(100), 30)]
    df = spark.createDataFrame(rows, "code long, d int, x double")
    hows = ("count", "sum", "avg", "min", "max", "var_pop", "stddev_pop", "stddev_samp")
    spec = {f"{h}{lo}{hi}": (h, "x", lo, hi) for h in hows for lo, hi in ((-4, 0), (-6, -2))} | {"below": ("below", "x", -4, 0), "lag3": ("lag", "x", -3, 0), "slope": ("slope", "x", -4, 0), "r2": ("r2", "x", -4, 0), "full_below": ("below", "x", -4, 0)}
    over = lambda lo, hi: X.over(["code"], ["d"], lo, hi)
    want = {n: getattr(F, h)("x").over(over(lo, hi)) for n, (h, _, lo, hi) in spec.items() if h in hows}
    seen = F.collect_list("x").over(over(-4, 0))
    below = F.when(F.col("x").isNotNull(), F.size(F.filter(seen, lambda v: v < F.col("x"))))
    n = F.row_number().over(X.over(["code"], ["d"]))
    want |= {"below": below, "full_below": F.when(F.size(seen) == 5, below), "lag3": F.lag("x", 3).over(X.over(["code"], ["d"])), "slope": F.regr_slope("x", "_n").over(over(-4, 0)), "r2": F.regr_r2("x", "_n").over(over(-4, 0))}
    got = {(r["code"], r["d"]): r for r in X.frames(df, ["code"], ["d"], spec).collect()}
    for r in df.withColumn("_n", n).withColumns(want).collect():
        for c in want:
            a, b = got[r["code"], r["d"]][c], r[c]
            same = a is b is None or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)))
            assert same, (r, c, a, b)


def test_frames_of_dealt_rows_equal_those_of_groups(spark):
    rng = random.Random(7)
    rows = [(c, k, rng.choice([None, 0.0, rng.uniform(1, 9)]), float(k)) for c in [None, *range(60)] for k in rng.sample(range(200), rng.randrange(1, 150))] + [(99, k, rng.random(), 1.0) for k in range(9000)]
    df = spark.createDataFrame(rows, "code long, d int, x double, y double").repartition(3)
    spec = {f"{h}{lo}{hi}": (h, "x", lo, hi) for h in ("count", "sum", "avg", "min", "max", "stddev_samp", "slope", "r2", "below", "fall") for lo, hi in ((-4, 0), (-9, -2))}
    spec |= {"full_a": ("avg", "y", -3, 0), "back": ("lag", "full_a", -20, 0), "full_b": ("below", "full_a", -30, 0), "change": ("change", "x", -1, 0), "move": ("move", "x", -2, 0)}
    one, many = X.frames(df, ["code"], ["d"], spec), X.frames(df.repartition(2, "code"), ["code"], ["d"], spec, dealt=True)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert X.frames(df.limit(0).repartition("code"), ["code"], ["d"], spec, dealt=True).count() == 0
    w = X.over(["code"], ["d"])
    want = df.select("code", "d", (F.col("x") / F.nullif(F.lag("x").over(w), F.lit(0.0)) - 1).alias("change"), F.abs(F.col("x") - F.lag("x", 2).over(w)).alias("move"))
    assert sorted(map(str, many.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["var_pop", "stddev_pop", "stddev_samp"])
def test_equal_values_do_not_vary(spark, how):
    values = [math.log(v) for v in range(200, 420)]
    df = spark.createDataFrame([(c, k, x) for c, x in enumerate(values) for k in range(7)], "code int, d int, x double")
    spec = {f"v{n}": (how, "x", 1 - n, 0) for n in (2, 3, 4, 5, 6, 7)}
    got = X.frames(df, ["code"], ["d"], spec).filter("d = 6").collect()
    assert len(got) == len(values) and {r[n] for r in got for n in spec} == {0.0}


def test_array_frames_find_the_deepest_fall_and_keep_other_columns(spark):
    rows = [(1, k, x, "s") for k, x in enumerate([5.0, 10.0, 4.0, 8.0, None, 12.0, 9.0])]
    got = X.frames(spark.createDataFrame(rows, "code long, d int, x double, s string"), ["code"], ["d"], {"fall": ("fall", "x", -2, 0)}).orderBy("d").collect()
    assert [round(r["fall"], 3) for r in got] == [0, 0, 0.6, 0.6, 0, 0, 0.25] and {r["s"] for r in got} == {"s"}


def test_runs_and_streaks_take_few_sorts_and_wide_frames_none_of_sparks(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 2.0)], "code long, d int, net double, pct double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(X.run_length(rows, ["code"], ["d"], F.col("net") > 0, "n")).count("Sort [") == 1
    p = plan(L.annotate(rows, ["code"]))
    assert p.count("Sort [") <= 3 and "stddev_samp(" not in p
