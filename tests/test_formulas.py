"""Formula signals do not change when the future is cut off, and fire where they should."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import formulas as M

SCHEMA = "code long, d date, open double, high double, low double, close double, vol double, amount double"


def series(n=420, seed=3):
    rng = np.random.default_rng(seed)
    c = 20 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
    o = c * (1 + rng.normal(0, 0.01, n))
    h, lo = np.maximum(o, c) * (1 + rng.random(n) * 0.01), np.minimum(o, c) * (1 - rng.random(n) * 0.01)
    v = rng.integers(100, 1000, n).astype(float) * np.where(rng.random(n) < 0.05, 5, 1)
    return {"open": o, "high": h, "low": lo, "close": c, "vol": v, "amount": v * c}


def flags(spark, name, p, n=None):
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(k), *[float(p[c][k]) for c in ("open", "high", "low", "close", "vol", "amount")]) for k in range(len(p["close"]) if n is None else n)]
    got = sorted((r.d, r.entry, r.exit) for r in M.signals(spark.createDataFrame(rows, SCHEMA), name).collect())
    return np.array([r[1] for r in got], bool), np.array([r[2] for r in got], bool)


@pytest.mark.parametrize("name", sorted(M.FORMULAS))
def test_prefix_gives_the_same_signals(spark, name):
    p = series()
    full, part = flags(spark, name, p), flags(spark, name, p, 300)
    assert len(full[0]) == 420 and (full[0][:300] == part[0]).all() and (full[1][:300] == part[1]).all()


@pytest.mark.parametrize("name", sorted(M.FORMULAS))
def test_short_histories(spark, name):
    for n in (0, 1, 5):
        entry, leave = flags(spark, name, series(), n)
        assert len(entry) == len(leave) == n


def test_crossings_equal_a_walk_bar_by_bar(spark):
    p = series(200, 8)
    o, h, lo, c = (p[k] for k in ("open", "high", "low", "close"))
    line = []
    for k in range(200):
        ms = [c[k - n + 1 : k + 1].mean() for n in (3, 7, 13, 27) if k + 1 >= n]
        line.append(np.mean(ms) if ms else c[0] if k == 0 else c[0] * 2 / 3 + c[1] / 3)
    x = list((h + lo + 2 * o + 6 * c) / 10)
    up = lambda a, b, k: k > 0 and a[k] > b[k] and a[k - 1] <= b[k - 1]
    for _ in range(10):
        new = list(x)
        for k in range(200):
            body, step = c[k] - o[k], c[k] / c[k - 1] if k else 1.0
            hp, lp = (h[k - 1], lo[k - 1]) if k else (c[k], lo[k])
            weak = body < 0 or (body > 0 and c[k] < hp) or (body >= 0 and h[k] - c[k] >= body and step < 1.02)
            firm = (body > 0 and step > 0.94) or (body < 0 and c[k] > lp) or (body <= 0 and c[k] - lo[k] >= -body and step > 0.98)
            if up(x, line, k) and weak:
                new[k] = line[k] * 0.98
            elif up(line, x, k) and firm:
                new[k] = line[k] * 1.02
        x = new
    entry, leave = flags(spark, "raw_crossing", p)
    assert entry.tolist() == [up(x, line, k) for k in range(200)] and leave.tolist() == [up(line, x, k) for k in range(200)] and entry.any()


def test_raw_crossing_buys_after_a_turn(spark):
    c = np.concatenate([np.linspace(30, 20, 40), np.linspace(20, 30, 40)])
    p = {"open": c, "high": c * 1.001, "low": c * 0.999, "close": c, "vol": c, "amount": c}
    entry, leave = flags(spark, "raw_crossing", p)
    assert entry[40:60].any() and not entry[15:39].any()


def test_average_base_buys_out_of_a_long_base(spark):
    c = np.concatenate([np.linspace(40, 20, 150), np.linspace(20, 19.5, 60), np.linspace(19.5, 26, 40)])
    p = {"open": c, "high": c * 1.001, "low": c * 0.999, "close": c, "vol": c, "amount": c}
    entry, leave = flags(spark, "average_base", p)
    assert not entry[:210].any() and leave[149:209].all()


def test_volume_base_fires_once_on_leaving_the_base():
    c = np.concatenate([np.full(40, 10.0), np.full(15, 10.2), [10.6, 10.7, 10.8]])
    v = np.concatenate([np.full(40, 100.0), np.full(15, 60.0), [200.0, 200, 200]])
    v[40] = 900
    p = {"open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "vol": v, "amount": v * c}
    entry, _ = M.volume_base(p)
    assert entry[55:].sum() <= 1 and entry.sum() >= 1


def test_volume_base_equals_a_walk_in_array_time():
    """Entries are those of a walk bar by bar, burst by burst, and a long history takes no walk's time."""
    import time

    import numpy as np

    from tidemark.operators import formulas as M
    from tidemark.operators.technical import ma

    def walk(p):
        c, h, lo, v, a = (p[k] for k in ("close", "high", "low", "vol", "amount"))
        v10, v20, a20, m20 = ma(v, 10), ma(v, 20), ma(a, 20), ma(c, 20)
        ok = np.zeros(len(c), bool)
        for i in range(20, len(c)):
            for s in range(max(0, i - 30), i - 8):
                top, low, vol = h[s + 1 : i].max(), lo[s + 1 : i].min(), v[s + 1 : i]
                late = vol[len(vol) // 2 :].mean()
                dry = late <= 0.30 * v[max(0, s - 20) : s + 1].mean() or late <= 0.55 * v[s] or v10[i] < v20[i]
                live = v20[i] > 0 and v[i - 4 : i + 1].mean() > 0.60 * v20[i]
                out = 0 <= c[i] / c[i - 4] - 1 <= 0.60 and (c[i] >= h[i - 20 : i].max() or (c[i] > m20[i] and m20[i] > m20[i - 1]))
                ok[i] |= (v[s] >= 2 * v20[s] or a[s] >= 2 * a20[s]) and (top - low) / low <= 0.35 and 0.75 * c[s] <= c[i] <= 1.60 * h[s] and dry and live and out
        return ok & ~np.concatenate([[False], ok[:-1]])

    rng = np.random.default_rng(5)
    made = lambda n: (lambda c, v: {"close": c, "high": c * 1.01, "low": c * 0.99, "vol": v, "amount": v * c})(10 * np.exp(np.cumsum(rng.normal(0, 0.02, n)) % 2), np.exp(rng.normal(0, 1, n)))
    with np.errstate(invalid="ignore"):
        for n in (0, 1, 8, 9, 20, 31, 300, 700):
            p = made(n)
            assert M.volume_base(p)[0].tolist() == walk(p).tolist()
    began = time.process_time()
    M.volume_base(made(20_000))
    assert time.process_time() - began < 0.5
