"""The form table: closed periods only, increments, unknown limits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar as C
from tidemark.operators import forms as M
from tidemark.operators import increment as I
from tidemark.operators import proof
from tidemark.plans.states import FRAMES

D0 = dt.date(2019, 1, 1)
SCHEMA = "code long, d date, open double, high double, low double, close double, vol double"
SHORT = {"day": {**FRAMES["day"], "ma": (2, 3, 4, 6), "er": 6, "pctile": 10, "range": 8, "pth": 10, "rv": 3, "rv_pct": 5, "warmup": 12}, "week": FRAMES["week"], "month": {**FRAMES["month"], "warmup": 5}}


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(3)
    rows, out = {}, []
    for code in (1, 2, 3):
        price = 10.0
        for k in range(430):
            day = D0 + dt.timedelta(k)
            price = max(1.0, price * (1 + rng.gauss(0.0005, 0.02)))
            if day.weekday() < 5 and not (code == 2 and rng.random() < 0.4) and not (code == 3 and 100 < k < 250):
                out.append((code, day, price * 0.99, price * 1.02, price * 0.97, price, 100 * rng.random() + 1))
    return spark.createDataFrame(out, SCHEMA).cache()


def test_a_week_is_seen_from_its_last_day_on(spark, bars):
    calendar = C.trading_days(bars)
    got = M.form_table(bars, calendar, None, SHORT).filter("code = 1").orderBy("d").collect()
    label = {r.d: r.label for r in M.period_labels(bars, calendar, "week", SHORT["week"]).filter("code = 1").collect()}
    assert len(label) > 20 and all(d.weekday() == 4 or d == max(r.d for r in got) for d in label)
    for r in got:
        seen = [x for x in label if x <= r.d]
        assert r.week == (label[max(seen)] if seen else None)
    # a later bar of a week that is not over yet changes nothing before the week's end
    cut = D0 + dt.timedelta(400)
    assert cut.weekday() == 2
    part = M.form_table(bars.filter(F.col("d") <= F.lit(cut)), calendar, None, SHORT)
    whole = M.form_table(bars, calendar, None, SHORT).filter(F.col("d") <= F.lit(cut))
    assert proof.panel_proof(part, whole, ["code", "d"]).first().equal
    assert all(r.buyable is None and r.sellable is None and r.is_one_word is None for r in got)


def test_increment_equals_a_full_table(spark, bars):
    calendar = C.trading_days(bars)
    build = lambda b: M.form_table(b, calendar, None, SHORT)
    rough = lambda df: df.select("code", "d", "position", "trend", "purity", "volume", F.round("trend_score", 6).alias("s"), "label", "sub", "week", "month", "breakout", "base_days")
    before = bars.filter(F.col("d") < F.lit(D0 + dt.timedelta(415))).filter(~((F.col("code") == 2) & (F.col("d") > F.lit(D0 + dt.timedelta(410)))))
    due = I.due_days(bars, before, 5)
    back = M.lookback(SHORT, cap=60)
    assert back < 400 and M.lookback() >= 750
    rows = I.increment(build, bars, due, ["code"], back)
    assert proof.panel_proof(rough(I.taken_in(build(before), rows, due)), rough(build(bars)), ["code", "d"]).first().equal


def test_no_bars_and_no_states(spark, bars):
    calendar = C.trading_days(bars)
    assert M.form_table(bars.limit(0), calendar, None, SHORT).count() == 0
    assert M.form_table(bars.filter("code = 1").orderBy("d").limit(5), calendar, None, SHORT).count() == 0


def test_an_axis_without_its_features_has_no_value(spark):
    from tidemark.operators import states as S

    values = dict.fromkeys(("pctile", "pth", "ma_slope", "ma_align", "er", "r2", "vol_ratio_eff", "zvol_eff"), 0.4)
    lacking = [None, *values]
    rows = [tuple(None if f == gone else x for f, x in values.items()) for gone in lacking]
    got = S.axes(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in values))).collect()
    for gone, r in zip(lacking, got, strict=True):
        for name, options in S.AXES.items():
            unknown = gone in {c[0] for cs in options.values() for c in cs}
            assert (r[name] is None) == (r[f"{name}_score"] is None) == (r[f"{name}_share"] is None) == unknown, (gone, name)


def test_the_form_table_shuffles_rows_of_a_code_once_and_then_all_together(spark, bars):
    p = M.form_table(bars, C.trading_days(bars), None, SHORT)._jdf.queryExecution().executedPlan().toString()
    # days; periods twice each, as they are resampled; all together
    assert sum("Exchange hashpartitioning(code" in x for x in p.splitlines()) <= 6
    assert "FlatMapGroupsInArrow" not in p and "SortMergeJoin" not in p


def test_generated_methods_are_short_enough_for_the_jvm_to_compile(spark, bars):
    import re

    df = M.form_table(bars, C.trading_days(bars), None, SHORT)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(df.select("*")._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(map(int, sizes)) < 8000


def test_the_increment_reads_its_rows_from_one_table(spark):
    from tidemark.plans.states import tech_form_increment

    p = tech_form_increment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "form-part" in p and "reading-from" not in p
