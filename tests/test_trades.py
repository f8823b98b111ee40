"""Trades sold by rules against a walk bar by bar."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import trades as R

D0 = dt.date(2020, 1, 1)
SCHEMA = "code long, d date, open double, high double, low double, close double, vol double, amount double, flag boolean, other boolean"


def bars(seed, codes=8, days=60):
    rng = random.Random(seed)
    out = []
    for c in range(codes):
        px = 10.0
        for k in range(days if c else 1):
            px = round(max(0.5, px * (1 + rng.choice([0.1, -0.1, 0.02, -0.03, 0.0]))), 2)
            vol = 0.0 if rng.random() < 0.15 or (c == 1 and k > 40) else 5.0
            out.append((c, D0 + dt.timedelta(k), px, round(px * 1.01, 2), round(px * (1 - rng.random() * 0.08), 2), px, vol, px * vol, rng.random() < 0.1, rng.choice([True, False, None, False, False, False])))
    return out


def walk(rows, signals, hold, use, trail, delay):
    """The rules read off bar by bar."""
    out = []
    for code in {r[0] for r in rows}:
        b = sorted(r for r in rows if r[0] == code)
        n = len(b)
        px = [r[5] for r in b]

        def stop(i, up, b=b):
            if b[i][6] <= 0:
                return "suspended"
            if i and up and b[i][5] >= round(b[i - 1][5] * 1.1 + 1e-9, 2) - 0.005:
                return "limit_up"
            if i and not up and b[i][5] <= round(b[i - 1][5] * 0.9 + 1e-9, 2) + 0.005:
                return "limit_down"
            return None

        for i in range(n):
            if (code, b[i][1]) not in signals:
                continue
            if i == n - 1:
                out.append((code, b[i][1], "pending", None, None, None, None, None, None, None))
                continue
            tried = [j for j in range(i + 1, min(n, i + 2 + delay))]
            free = [j for j in tried if not stop(j, True)]
            if not free:
                out.append((code, b[i][1], "unfilled", None, None, None, stop(tried[-1], True), None, None, None))
                continue
            at = free[0]
            top, j, by = px[at], at, None
            while by is None:
                j += 1
                if j >= n:
                    j, by = at + hold, "hold"
                    break
                top = max(top, px[j])
                if use and b[j][8]:
                    by = "flag"
                elif use and b[j][9]:
                    by = "other"
                elif trail is not None and px[j] < top * (1 - trail):
                    by = "trail"
                elif j == at + hold:
                    by = "hold"
            low = lambda z, at=at: min(0.0, min(r[4] for r in b[at : z + 1]) / px[at] - 1)  # noqa: B023, E731
            if j >= n:
                out.append((code, b[i][1], "open", at - i - 1, None, None, None, j - (n - 1), px[-1] / px[at] - 1, low(n - 1)))
                continue
            sold = [z for z in range(j, n) if not stop(z, False)]
            if not sold:
                out.append((code, b[i][1], "blocked", at - i - 1, None, by, stop(n - 1, False), None, None, None))
            else:
                out.append((code, b[i][1], "closed", at - i - 1, sold[0] - j, by, None, None, px[sold[0]] / px[at] - 1, low(sold[0])))
    return out


@pytest.mark.parametrize(("seed", "hold", "use", "trail", "delay"), [(1, 6, True, 0.12, 2), (2, 1, False, None, 0), (3, 25, False, 0.05, 3)])
def test_trades_equal_a_walk(spark, seed, hold, use, trail, delay):
    rows = bars(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    rng = random.Random(seed)
    signals = {(r[0], r[1]) for r in rows if rng.random() < 0.5} | {(r[0], r[1]) for r in rows if r[0] < 2}
    picks = spark.createDataFrame([*signals, *list(signals)[:5], (777, D0)], "code long, d date")
    exits = [("flag", F.col("flag")), ("other", F.col("other"))] if use else None
    got = R.sell_rule_trades(picks, df, F.lit(0.1), hold, exits, trail, delay).collect()
    round_ = lambda x: None if x is None else round(x, 9)
    mine = sorted(((r.code, r.d, r.status, r.buy_delay, r.sell_delay, r.by, r.reason, r.left, round_(r.ret), round_(r["drop"])) for r in got), key=str)
    want = sorted(((*x[:8], round_(x[8]), round_(x[9])) for x in walk(rows, signals, hold, use, trail, delay)), key=str)
    assert mine == want
    seen = Counter(r.status for r in got)
    assert seen["closed"] > 20 and seen["pending"] and seen["unfilled"] and (seen["open"] or hold == 1) and (seen["blocked"] or hold != 6)
    assert R.sell_rule_trades(picks.limit(0), df, F.lit(0.1), hold).count() == 0


def test_tasks_follow_the_bars(spark, monkeypatch):
    """Sorts are of a bounded number of bars."""
    from tidemark import session

    monkeypatch.setattr(session, "TASK_ROWS", 60)
    df = spark.createDataFrame(bars(4), SCHEMA)
    t = R.sell_rule_trades(df.select("code", "d"), df, F.lit(0.1), 6, [("flag", F.col("flag"))], 0.12, 2)
    assert t.rdd.getNumPartitions() == -(-df.count() // 60)
