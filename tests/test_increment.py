"""Increments against full builds, proofs, and acceptance that breaks off between any two steps."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import increment as I
from tidemark.operators import proof
from tidemark.operators import windows as X
from tidemark.plans.increment import BACK, annotated
from tidemark.sources import sinks
from tidemark.sources.acceptance import AcceptanceError, Contract, Store

D0 = dt.date(2020, 1, 1)
FLOW = "code long, d date, close double, net double"


def flow_rows(seed, codes=6, days=150, gaps=0.2):
    rng = random.Random(seed)
    out = []
    for c in range(codes):
        sign = 1
        for k in range(days):
            if rng.random() < 0.1:
                sign = -sign
            if rng.random() >= (gaps * 4 if c == 0 else gaps):
                out.append((c, D0 + dt.timedelta(k), 10 + rng.random(), rng.choice([None, 0.0, 1.0, 1.0, 1.0, 1.0]) and sign * rng.random() * 100))
    return out


def frame(spark, rows, schema=FLOW):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_increment_after_late_rows_equals_a_full_build(spark, seed):
    """Codes with gaps reach back over more days than rows; a run may have begun long before."""
    rows = flow_rows(seed)
    long_run = [(99, D0 + dt.timedelta(k), 5.0 + k / 100, 1.0) for k in range(150)]
    source = frame(spark, rows + long_run)
    late = [r for r in rows if not (r[1] > D0 + dt.timedelta(130) or (r[0] % 2 == 0 and r[1] > D0 + dt.timedelta(122)))]
    old = frame(spark, late + [r for r in long_run if r[1] <= D0 + dt.timedelta(125)])
    panel = annotated(old)
    due = I.due_days(source, panel, 10)
    got = I.taken_in(panel, I.increment(annotated, source, due, ["code"], BACK, X.sign(F.col("net")), 1), due)
    one = proof.panel_proof(got, annotated(source), ["code", "d"]).first()
    assert one.equal and one.only_left == one.only_right == one.repeated_left == one.null_grains == 0 and one.rows_left == len(rows) + 150
    # one row less of reach is too little, and the proof says so
    short = I.taken_in(panel, I.increment(annotated, source, due, ["code"], 20, None, 0), due)
    assert not proof.panel_proof(short, annotated(source), ["code", "d"]).first().equal


def test_touched_days_are_those_that_change(spark):
    rows = flow_rows(5, days=120)
    at = D0 + dt.timedelta(40)
    after = [(c, d, x, (n or 0) + 1000.0 if d == at and c == 1 else n) for c, d, x, n in rows]
    assert after != rows
    panel = lambda r: frame(spark, r).withColumn("m", F.sum("net").over(X.over(["code"], ["d"], -7, 0)))
    changed = spark.createDataFrame([(1, at)], "code long, d date")
    touched = {r.d for r in I.touched_days(frame(spark, rows), changed, ["code"], 7).collect()}
    assert touched == {r.d for r in proof.multiset_gaps(panel(rows), panel(after)).collect()} and len(touched) == 8
    assert len(I.touched_days(frame(spark, rows), changed, ["code"], None).collect()) == len({d for c, d, *_ in rows if c == 1 and d >= at})


def test_refresh_rewrites_only_due_days_and_can_be_repeated(spark, tmp_path):
    path, rows = str(tmp_path / "panel"), flow_rows(3)
    args = (["code"], 5, BACK, X.sign(F.col("net")), 1)
    old = frame(spark, [r for r in rows if r[1] < D0 + dt.timedelta(140)])
    assert len(I.refresh(annotated, old, path, *args)) == len({r[1] for r in rows if r[1] < D0 + dt.timedelta(140)})
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "panel").glob("d=*")}
    for _ in range(2):
        due = I.refresh(annotated, frame(spark, rows), path, *args)
        assert proof.panel_proof(spark.read.parquet(path).select("code", "d", "z", "streak"), annotated(frame(spark, rows)).select("code", "d", "z", "streak"), ["code", "d"]).first().equal
    now = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "panel").glob("d=*")}
    assert len(due) == 5 and {n for n in kept if now[n] == kept[n]} >= {f"d={d}" for d in sorted({r[1] for r in rows})[:120]}


def test_a_bad_batch_is_not_taken_in(spark, tmp_path):
    path, rows = str(tmp_path / "panel"), flow_rows(4, days=30)
    I.refresh(annotated, frame(spark, rows[:-40]), path, ["code"], 3, BACK)
    before = spark.read.parquet(path).count()
    twice = lambda df: annotated(df).unionByName(annotated(df))
    fewer = lambda df: annotated(df).filter("code <> 3")
    for build, word in ((twice, "repeated_grain"), (fewer, "missing_key")):
        with pytest.raises(ValueError, match=word):
            I.refresh(build, frame(spark, rows), path, ["code"], 3, BACK)
    assert spark.read.parquet(path).count() == before
    none = I.batch_verdict(annotated(frame(spark, [])), annotated(frame(spark, rows)), frame(spark, rows).select("code", "d"), spark.createDataFrame([(D0,)], "d date"), ["code", "d"])
    got = {r.problem: r["count"] for r in none.collect()}
    here = len([r for r in rows if r[1] == D0])
    assert got == {"null_grain": 0, "repeated_grain": 0, "missing_key": here, "unexpected_key": 0, "lost_key": here, "empty": 1}
    with pytest.raises(ValueError, match="lost_key"):
        I.require(none)
    assert I.increment(annotated, frame(spark, rows), spark.createDataFrame([], "d date"), ["code"], BACK).count() == 0


def test_proof_counts_repeats_nulls_and_both_directions(spark):
    a = frame(spark, [(1, D0, 0.0, 1.0), (1, D0, 0.0, 1.0), (2, None, float("nan"), None)])
    b = frame(spark, [(1, D0, -0.0, 1.0), (2, None, float("nan"), None), (3, D0, 1.0, 1.0), (3, D0, 2.0, 1.0)])
    r = proof.panel_proof(a, b, ["code", "d"]).first()
    assert (r.rows_left, r.rows_right, r.only_left, r.only_right, r.repeated_left, r.repeated_right, r.null_grains, r.equal) == (3, 4, 1, 2, 1, 1, 2, False)
    none = proof.panel_proof(a.limit(0), b.limit(0), ["code", "d"]).first()
    assert none.equal and none.rows_left == none.only_left == 0


def test_cut_proof_catches_a_look_ahead_and_unknown_times(spark):
    df = frame(spark, [(c, D0 + dt.timedelta(k), float(k), 1.0) for c in range(3) for k in range(10)])
    cut = D0 + dt.timedelta(5)
    mean = lambda t: t["x"].withColumn("m", F.avg("close").over(W.partitionBy("code")))
    past = lambda t: t["x"].withColumn("m", F.avg("close").over(X.over(["code"], ["d"], None, 0)))
    bad, good = (proof.cut_proof(p, {"x": (df, "d")}, [cut], "d").first() for p in (mean, past))
    assert (bad.rows, bad.only_cut, bad.only_full, bad.first_gap, len(bad.examples)) == (18, 18, 18, D0, 3) and '"side"' in bad.examples[0]
    assert (good.rows, good.only_cut, good.only_full, good.first_gap, good.examples) == (18, 0, 0, None, [])
    with pytest.raises(Exception, match="a row without d"):
        proof.cut_proof(past, {"x": (frame(spark, [(1, None, 1.0, 1.0)]), "d")}, [cut], "d").collect()
    assert proof.cut_proof(past, {"x": (df, "d")}, [], "d").count() == 0


# --- acceptance

AT = dt.datetime(2020, 1, 2, tzinfo=dt.timezone.utc)
ROWS = "part string, id long, v double"


class Crash(Exception):
    pass


def contract(**how):
    return Contract("t", "v1", "part", ["id"], [("NULL_VALUE", F.col("v").isNull()), ("NEGATIVE", F.col("v") < 0)], **how)


def land(store, spark, batch, rows, part="p/1"):
    return store.land(batch, spark.createDataFrame(rows, ROWS), part, "test", AT, AT)


def shown(store):
    return sorted((r.part, r.id, r.v, r.batch_id) for r in store.read().collect())


def test_landing_is_idempotent_and_refuses_other_payloads(spark, tmp_path):
    store = Store(spark, str(tmp_path), contract())
    rows = [("p/1", 1, 1.0), ("p/1", 2, 2.0)]
    land(store, spark, "b1", rows)
    files = sorted(p for p in tmp_path.rglob("*") if p.is_file())
    assert land(store, spark, "b1", rows[::-1]) == "b1" and sorted(p for p in tmp_path.rglob("*") if p.is_file()) == files
    for bad in ([("p/1", 1, 1.0)], [], [("p/1", 1, 1.0), ("p/1", 2, 2.5)]):
        with pytest.raises(AcceptanceError):
            land(store, spark, "b1", bad)
    with pytest.raises(AcceptanceError):
        store.land("b2", spark.createDataFrame(rows, ROWS), "p/1", "test", AT, AT - dt.timedelta(1))
    with pytest.raises(AcceptanceError):
        land(store, spark, " ", rows)
    with pytest.raises(AcceptanceError):
        store.accept("never landed")
    assert store.read() is None and store.pending() == ["b1"] and not store.parity().filter("intact").count()


def test_old_version_stays_readable_whatever_step_breaks_off(spark, tmp_path):
    old, new = [("p/1", 1, 1.0), ("p/1", 2, 2.0)], [("p/1", 2, 20.0), ("p/1", 3, 30.0), ("p/1", 4, 40.0)]
    want_old, want_new = [(*r, "old") for r in old], [(*r, "new") for r in new]
    for k, stop in enumerate(["rows written", "landed", "version written", "pointer written"]):
        store = Store(spark, str(tmp_path / str(k)), contract())
        store.accept(land(store, spark, "old", old))

        def crash(step, stop=stop):
            if step == stop:
                raise Crash

        broken = Store(spark, store.root, contract(), crash)
        with pytest.raises(Crash):
            broken.accept(land(broken, spark, "new", new))
        assert shown(store) == (want_new if stop == "pointer written" else want_old)
        assert store.pending() == (["new"] if stop in ("landed", "version written") else [])
        swept = store.sweep()
        assert swept == {"version written": ["new"], "pointer written": ["old"]}.get(stop, [])
        assert shown(store) == (want_new if stop == "pointer written" else want_old)
        for _ in range(2):
            out = store.accept(land(store, spark, "new", new))
            assert (out.status, out.rows, shown(store)) == ("ACCEPTED", 3, want_new)
        p = store.parity().collect()
        assert [(r.partition, r.batch, r.rows, r.members, r.intact) for r in p] == [("p/1", "new", 3, 3, True)]
        assert store.pointers().first().number == 2 and store.pending() == []


def test_rejections_stand_and_leave_the_version(spark, tmp_path):
    store = Store(spark, str(tmp_path), contract(least_rows=2))
    good = [("p/1", 1, 1.0), ("p/1", 2, 2.0)]
    store.accept(land(store, spark, "good", good))
    bad = {"BELOW_MIN_ROWS": [("p/1", 1, 1.0)], "DUPLICATE_GRAIN": [("p/1", 1, 1.0), ("p/1", 1, 2.0)], "WRONG_PARTITION": [("p/1", 1, 1.0), (None, 2, 2.0)], "NULL_VALUE": [("p/1", 1, None), ("p/1", 2, 2.0)], "NEGATIVE": [("p/1", 1, -1.0), ("p/1", 2, -2.0), ("p/1", 3, None)]}
    for code, rows in bad.items():
        for _ in range(2):
            out = store.accept(land(store, spark, f"bad {code}", rows))
            assert (out.status, out.code) == ("REJECTED", code)
    assert shown(store) == [(*r, "good") for r in good] and store.pending() == []
    other = Store(spark, str(tmp_path), Contract("t", "v2", "part", ["id"]))
    assert other.accept(land(store, spark, "old contract", [("p/1", 7, 1.0), ("p/1", 8, 1.0)])).code == "CONTRACT_DRIFT"
    plain = store.land("odd", spark.createDataFrame([(1,), (2,)], "x int"), "p/1", "test", AT, AT)
    assert store.accept(plain).code == "MISSING_FIELDS"
    store.accept(land(store, spark, "next", [("p2", 1, 1.0), ("p2", 2, 1.0)], "p2"))
    assert {r[0] for r in shown(store)} == {"p/1", "p2"} and sinks.exists(spark, str(tmp_path / "versions"))


def test_cut_proof_reads_inputs_that_differ_when_worked_out_anew_once(spark):
    noise = F.udf(random.random, "double").asNondeterministic()
    df = spark.range(50).select("id", F.lit(D0).alias("d"), noise().alias("x"))
    r = proof.cut_proof(lambda t: t["x"], {"x": (df, "d")}, [D0], "d").first()
    assert (r["rows"], r["only_cut"], r["only_full"]) == (50, 0, 0)


def test_gaps_are_counted_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch):
    from tidemark import session

    monkeypatch.setattr(session, "TASK_ROWS", 30)
    a = spark.range(100).select((F.col("id") % 90).alias("k"), (F.col("id") % 90 / 7).alias("x"))
    gaps = proof.multiset_gaps(a, a.filter("k <> 5"), 200)
    assert gaps.rdd.getNumPartitions() == 7 and [(r.k, r.n_left, r.n_right) for r in gaps.collect()] == [(5, 2, 0)]


def test_line_bars_sort_bounded_numbers_of_lines(spark, monkeypatch):
    from tidemark import session
    from tidemark.sources.bars import line_bars

    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    b = line_bars(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert b.rdd.getNumPartitions() == -(-n // 1000) and b.count() > 1000
