"""Technical states: resampling, feature vectors, axes and labels, breakouts, candles, patterns and formulas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import calendar as C
from tidemark.operators import windows as X

K, O = ["code"], ["d"]


def by():
    return W.partitionBy("code").orderBy("d")


def resample(bars: DataFrame, calendar: DataFrame, period: str) -> DataFrame:
    """Weekly or monthly bars, keyed by the period's last trading day of the calendar; rows without a close are left out."""
    b = bars.filter(F.col("close").isNotNull() & ~F.isnan("close")).withColumn("period", C.period_keys(F.col("d"))[period])
    agg = b.groupBy("code", "period").agg(F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("vol").alias("vol"))
    return agg.join(F.broadcast(C.period_ends(calendar, period)), "period").select("code", F.col("period_end").alias("d"), "open", "high", "low", "close", "vol")


def slope(value: Column, n: int, keys: list[str] = K, order: list[str] = O) -> tuple[Column, Column]:
    """Slope and R2 of a least-squares line over the last n rows, by closed sums; value must not be NULL there."""
    w = X.over(keys, order, -(n - 1), 0)
    i = F.row_number().over(X.over(keys, order)).cast("double")
    c = F.count(value).over(w)
    sx, sy, sxy, sxx, syy = (F.sum(e).over(w) for e in (i, value, i * value, i * i, value * value))
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    return F.when(c == n, cov / F.nullif(vx, F.lit(0.0))), F.when((c == n) & (vy > 1e-12), cov * cov / F.nullif(vx * vy, F.lit(0.0)))


def features(bars: DataFrame, n: int = 20) -> DataFrame:
    """ma_dist, ma_slope, mom, range_pct, vol_ratio (its base leaves today out), er and trend of each bar."""
    ma = X.full_mean("close", K, O, n)
    d = bars.withColumn("ma", ma)
    w, prior = X.over(K, O, -(n - 1), 0), X.over(K, O, -n, -1)
    full = F.count("close").over(w) == n
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    d = d.withColumn("_move", F.abs(F.col("close") - F.lag("close").over(by())))
    back = F.lag("close", n).over(by())
    return d.select(
        "code", "d", "close",
        (F.col("close") / F.nullif(F.col("ma"), F.lit(0.0)) - 1).alias("ma_dist"),
        (F.col("ma") / F.nullif(F.lag("ma", 5).over(by()), F.lit(0.0)) - 1).alias("ma_slope"),
        (F.col("close") / F.nullif(back, F.lit(0.0)) - 1).alias("mom"),
        F.when(full, (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0))).alias("range_pct"),
        F.when(F.count("vol").over(prior) == n, F.col("vol") / F.nullif(F.avg("vol").over(prior), F.lit(0.0))).alias("vol_ratio"),
        F.when(F.count("_move").over(w) == n, F.abs(F.col("close") - back) / F.nullif(F.sum("_move").over(w), F.lit(0.0))).alias("er"),
    )


def gate(x: Column, threshold: float, above: bool = True, k: float = 10.0) -> Column:
    """Soft condition: a sigmoid of the distance from the threshold."""
    z = (x - threshold) * (k if above else -k)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))


def axis(scores: dict[str, list[Column]], tau: float = 0.25) -> tuple[Column, Column]:
    """Best value of an axis and its softmax share: each value scores the geometric mean of its gates."""
    raw = {}
    for name, gates in scores.items():
        prod = gates[0]
        for g in gates[1:]:
            prod = prod * g
        raw[name] = F.pow(prod, F.lit(1.0 / len(gates)))
    total = sum((F.exp(v / tau) for v in raw.values()), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct((F.exp(v / tau) / total).alias("p"), F.lit(-i).alias("first"), F.lit(n).alias("name")) for i, (n, v) in enumerate(raw.items())]))
    return best["name"], best["p"]


def labelled(feat: DataFrame) -> DataFrame:
    """position and trend axes with their shares, and the label of their cell."""
    pos, pp = axis({"low": [gate(F.col("range_pct"), 0.33, False)], "mid": [gate(F.col("range_pct"), 0.33), gate(F.col("range_pct"), 0.67, False)], "high": [gate(F.col("range_pct"), 0.67)]})
    trend, tp = axis({"down": [gate(F.col("ma_slope"), -0.005, False, 100), gate(F.col("mom"), 0.0, False)], "flat": [gate(F.abs("ma_slope"), 0.005, False, 100)], "up": [gate(F.col("ma_slope"), 0.005, True, 100), gate(F.col("mom"), 0.0)]})
    known = feat.filter("range_pct IS NOT NULL AND ma_slope IS NOT NULL AND mom IS NOT NULL")
    d = known.withColumn("position", pos).withColumn("trend", trend).withColumn("position_p", pp).withColumn("trend_p", tp)
    label = F.when((F.col("position") == "low") & (F.col("trend") == "up"), "turning_up").when((F.col("position") == "high") & (F.col("trend") == "down"), "turning_down").when(F.col("trend") == "flat", F.concat(F.lit("base_"), F.col("position"))).otherwise(F.concat_ws("_", "trend", "position"))
    return d.withColumn("label", label)


def majority_before(value: str, n: int) -> Column:
    """Most frequent value of the n rows before today; of ties the one seen first in the frame."""
    seen = F.collect_list(value).over(X.over(K, O, -n, -1))
    count = lambda s, v: F.size(F.filter(s, lambda x: x == v))
    ranked = lambda s: F.array_max(F.transform(F.array_distinct(s), lambda v: F.struct(count(s, v).alias("n"), (-F.array_position(s, v)).alias("first"), v.alias("v"))))
    # the list is bound once: a frame is worked out anew wherever it is named
    return F.transform(F.array(seen), lambda s: ranked(s)["v"])[0]


def breakout(bars: DataFrame, n: int = 60, base: int = 20, volume: float = 1.2) -> DataFrame:
    """Bars that close above the highest high of the n bars before, on volume, after `base` days in the lower half of the range."""
    prior, full = X.over(K, O, -n, -1), F.count("close").over(X.over(K, O, -n, -1)) == n
    top, bottom = F.max("high").over(prior), F.min("low").over(prior)
    d = bars.withColumn("_top", F.when(full, top)).withColumn("_quiet", F.when(full, F.col("close") <= bottom + (top - bottom) * 0.67))
    d = X.run_length(d, K, O, F.col("_quiet"), "_streak")
    vr = F.col("vol") / F.nullif(F.avg("vol").over(X.over(K, O, -20, -1)), F.lit(0.0))
    hit = (F.col("close") > F.col("_top")) & (F.lag("_streak").over(by()) >= base) & (vr >= volume)
    return d.withColumn("breakout", F.coalesce(hit, F.lit(False))).drop("_top", "_quiet", "_streak")


def candle(bars: DataFrame) -> DataFrame:
    """A name for each bar's body and shadows."""
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    b, u, lo = (x / F.nullif(span, F.lit(0.0)) for x in (body, upper, lower))
    up = F.col("close") > F.col("open")
    name = F.when(span == 0, "flat").when((b <= 0.1) & (lo >= 0.6), "dragonfly").when((b <= 0.1) & (u >= 0.6), "gravestone").when(b <= 0.1, "doji").when((b >= 0.9) & up, "full_up").when(b >= 0.9, "full_down").when((lo >= 0.6) & (b <= 0.35), "hammer").when((u >= 0.6) & (b <= 0.35), "shooting_star").when(up, "up").otherwise("down")
    return bars.withColumn("candle", name)


def pattern(df: DataFrame, label: str, steps: list[str], window: int) -> Column:
    """Whether the steps stand in this order, gaps allowed, within the last `window` rows, the last step today.

    Matched greedily backwards from today.
    """
    seen = F.reverse(F.collect_list(label).over(X.over(K, O, -(window - 1), 0)))
    want = F.array(*[F.lit(s) for s in reversed(steps)])
    done = F.aggregate(seen, F.lit(0), lambda k, x: F.when((k < len(steps)) & (F.try_element_at(want, k + 1) == x), k + 1).otherwise(k))
    return (F.col(label) == steps[-1]) & (done == len(steps))


# formula primitives over one code's arrays


def ma(x: np.ndarray, n: int) -> np.ndarray:
    s = pd.Series(x)
    return s.rolling(n).mean().to_numpy()


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).ewm(span=n, adjust=False).mean().to_numpy()


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), bool)
    with np.errstate(invalid="ignore"):
        out[1:] = (a[1:] > b[1:]) & (a[:-1] <= b[:-1])
    return out


def bars_last(c: np.ndarray) -> np.ndarray:
    i = np.arange(len(c))
    last = np.maximum.accumulate(np.where(c, i, -1)) if len(c) else i
    return np.where(last >= 0, i - last, 1_000_000)


def bars_last_count(c: np.ndarray) -> np.ndarray:
    i = np.arange(1, len(c) + 1)
    return i - np.maximum.accumulate(np.where(c, 0, i)) if len(c) else i


def cooldown(c: np.ndarray, k: int) -> np.ndarray:
    out, last = np.zeros(len(c), bool), None
    for i in np.flatnonzero(c):
        if last is None or i - last >= k:
            out[i], last = True, i
    return out


def formula_panel(bars: DataFrame, fast: int = 5, slow: int = 20, gap: int = 10) -> DataFrame:
    """(code, d, ma_fast, ema_slow, hhv, llv, cross_up, since_cross, run_up, entry): one code's history to a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d").reset_index(drop=True)
        c = pdf["close"].to_numpy(float)
        f, e = ma(c, fast), ema(c, slow)
        up = cross(f, e)
        rise = np.concatenate([[False], c[1:] > c[:-1]]) if len(c) else np.zeros(0, bool)
        return pd.DataFrame({
            "code": pdf["code"], "d": pdf["d"], "ma_fast": f, "ema_slow": e, "hhv": pdf["high"].rolling(slow, min_periods=1).max(), "llv": pdf["low"].rolling(slow, min_periods=1).min(),
            "cross_up": up, "since_cross": bars_last(up), "run_up": bars_last_count(rise), "entry": cooldown(up, gap),
        })

    code = bars.schema["code"].dataType.simpleString()
    return bars.select("code", "d", "close", "high", "low").groupBy("code").applyInPandas(run, f"code {code}, d date, ma_fast double, ema_slow double, hhv double, llv double, cross_up boolean, since_cross long, run_up long, entry boolean")


def activity_breakout(bars: DataFrame, enter: float = 6.0, leave: float = 3.0, lo: float = -20.0, hi: float = 1000.0) -> DataFrame:
    """entry and exit of the activity measure: 1.2 times the largest of several sums of shadows, body, gap and return, in percent."""
    low_body, high_body, prev = F.least("open", "close"), F.greatest("open", "close"), F.lag("close").over(by())
    pct = lambda a, b: a / F.nullif(b, F.lit(0.0)) * 100
    x2, x3, x4 = pct(low_body - F.col("low"), F.col("low")), pct(F.col("close") - prev, prev), pct(F.col("open") - prev, prev)
    x5, x7 = pct(F.col("close") - F.col("open"), F.col("open")), pct(F.col("high") - high_body, high_body)
    act = 1.2 * F.greatest(x7 + x2, x3, x5 + x2, x5 + x7, x2, x7, x4)
    d = bars.withColumn("activity", F.when(prev.isNotNull(), act)).withColumn("_ret", x3)
    was = F.lag("activity").over(by())
    entry = (F.col("activity") > enter) & (was <= enter) & F.col("_ret").between(lo, hi)
    return d.withColumn("entry", F.coalesce(entry, F.lit(False))).withColumn("exit", F.coalesce(F.col("activity") < leave, F.lit(False))).drop("_ret")
