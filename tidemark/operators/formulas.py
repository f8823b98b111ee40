"""Entry and exit signals of four bar formulas, as frames over one code's bars in order.

A crossing is a bar on which one line stands above another that it did not stand above on the bar before; `since` counts
bars from the last time a flag was set. volume_base looks back for a burst whose base it then measures, which no frame
of a fixed size does, so it walks one code's history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as X
from tidemark.operators.technical import by, cooldown, ma

SIGNALS = "code {code}, d date, entry boolean, exit boolean"
NEVER = 1_000_000
#: Bars from a burst to the bar that leaves its base, the last one excluded.
BASE = (9, 31)


def true(c: Column) -> Column:
    """Unknown counts as not set."""
    return F.coalesce(c, F.lit(False))


def crosses(a: str, b: str) -> Column:
    return true((F.col(a) > F.col(b)) & (F.lag(a).over(by()) <= F.lag(b).over(by())))


def since(flag: Column) -> Column:
    """Bars since the flag was last set, today's included; NEVER before the first time."""
    i = F.row_number().over(by())
    return F.coalesce(i - F.max(F.when(flag, F.col("_i"))).over(X.over(["code"], ["d"], None, 0)), F.lit(NEVER))


def frame(n: int):
    """The last n bars, fewer at the start."""
    return X.over(["code"], ["d"], -(n - 1), 0)


def count(flag: Column, n: int) -> Column:
    return F.sum(flag.cast("int")).over(frame(n))


def mean(n: int) -> Column:
    return X.full_mean("close", ["code"], ["d"], n)


def numbered(bars: DataFrame) -> DataFrame:
    return bars.select("code", "d", "open", "high", "low", "close", "vol", "amount", F.row_number().over(by()).alias("_i"))


def turns(bars: DataFrame, passes: int = 10) -> DataFrame:
    """Numbered bars with buy and sell: crossings of a weighted price with its mean line, weak ones undone.

    The line is the mean of those of the 3, 7, 13 and 27-bar means that are known, before them a 5-bar exponential mean.
    In each pass, the price of a weak bar that crosses up is moved to 2 % below the line, and of a firm bar that crosses
    down to 2 % above it; crossings of what is left after all passes count.
    """
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    prev = lambda x, first: F.coalesce(F.lag(x).over(by()), first)
    d = numbered(bars).withColumns({f"_m{n}": mean(n) for n in (3, 7, 13, 27)})
    known = [F.col(f"_m{n}") for n in (3, 7, 13, 27)]
    some = sum((k.isNotNull().cast("int") for k in known), F.lit(0))
    total = sum((F.coalesce(k, F.lit(0.0)) for k in known), F.lit(0.0))
    early = F.when(F.col("_i") == 1, c).otherwise(F.lag("close").over(by()) * 2 / 3 + c / 3)  # the first two bars only
    d = d.withColumn("_line", F.when(some > 0, total / some).otherwise(early)).withColumn("_body", c - o).withColumn("_step", F.when(prev("close", c) != 0, c / prev("close", c)).otherwise(1.0))
    body, upper, lower, step = F.col("_body"), h - c, c - lo, F.col("_step")
    # The limits of the day's step that belong to each shape of bar.
    weak = (body < 0) | ((body > 0) & (c < prev("high", c))) | ((body >= 0) & (upper >= body) & (step < 1.02)) | ((body == 0) & (upper >= lower) & (step < 1.05))
    firm = ((body > 0) & (step > 0.94)) | ((body < 0) & (c > prev("low", lo))) | ((body <= 0) & (lower >= -body) & (step > 0.98)) | ((body == 0) & (lower >= upper) & (step > 0.95))
    d = d.withColumn("_weak", weak).withColumn("_firm", firm).withColumn("_x", (h + lo + 2 * o + 6 * c) / 10)
    for _ in range(passes):
        moved = F.when(crosses("_x", "_line") & F.col("_weak"), F.col("_line") * 0.98).when(crosses("_line", "_x") & F.col("_firm"), F.col("_line") * 1.02)
        d = d.withColumn("_x", moved.otherwise(F.col("_x")))
    return d.withColumn("buy", crosses("_x", "_line")).withColumn("sell", crosses("_line", "_x")).select("code", "d", "_i", "open", "high", "low", "close", "buy", "sell")


def raw_crossing(bars: DataFrame) -> DataFrame:
    return turns(bars).select("code", "d", F.col("buy").alias("entry"), F.col("sell").alias("exit"))


def pullback_confirm(bars: DataFrame) -> DataFrame:
    """Entry on a pullback in an up trend whose earlier crossings mostly came back fast; exit on a sell crossing."""
    c = F.col("close")
    d = turns(bars).withColumn("_sold", since(F.col("sell"))).withColumn("_bought", since(F.col("buy"))).withColumn("_down", F.col("_sold") < F.col("_bought"))
    back = F.col("buy") & (F.col("_sold") > 0)
    d = X.run_length(d, ["code"], ["d"], F.col("_down"), "_fall")
    # flags as numbers: their sums over frames are whole
    flags = {"_fast": back & (F.col("_sold") <= 3), "_back": back, "_slow": F.col("buy") & (F.col("_sold") > 10), "_downs": F.col("_down")}
    d = d.withColumns({n: f.cast("int") for n, f in flags.items()}).withColumn("_held", F.when(F.col("buy"), F.col("_sold")).otherwise(0))
    spec = {f"full_m{n}": ("avg", "close", 1 - n, 0) for n in (20, 60, 90)} | {"_l60": ("lag", "full_m60", -20, 0), "_l90": ("lag", "full_m90", -20, 0), "_top": ("max", "high", -19, 0)}
    spec |= {"_f90": ("sum", "_fast", -89, 0), "_b90": ("sum", "_back", -89, 0), "_s90": ("sum", "_slow", -89, 0), "_d45": ("sum", "_downs", -44, 0), "_longest": ("max", "_fall", -44, 0), "_latest": ("max", "_held", -89, 0)}
    d = X.frames(d.select("code", "d", "high", "close", "sell", "_sold", "_down", "_fall", "_held", *flags), ["code"], ["d"], spec)
    m20, m60, m90 = (F.col(f"full_m{n}") for n in (20, 60, 90))
    history = (F.col("_f90") >= 1) & (F.col("_f90") * 100 >= F.col("_b90") * 40)
    calm = (F.col("_longest") <= 8) & (F.col("_d45") / 45 <= 0.6)  # a run counts from where it began
    steady = (F.col("_latest") <= 20) & (F.col("_s90") <= 2)
    order = (m20 > m60) & (m60 > m90) & (c > m90) & (c > 0.97 * m60)
    rising = (m60 > F.col("_l60")) & (m90 > F.col("_l90"))
    depth = c / F.col("_top")
    entry = F.col("_down") & (F.col("_sold") <= 3) & history & calm & steady & order & rising & depth.between(0.78, 0.995)
    return d.select("code", "d", true(entry).alias("entry"), F.col("sell").alias("exit"))


def average_base(bars: DataFrame) -> DataFrame:
    """Entry soon after the close crosses its 145-bar mean out of a long base and stays above; exit below that mean."""
    c = F.col("close")
    d = numbered(bars).withColumns({f"_m{n}": mean(n) for n in (5, 90, 145)})
    d = d.withColumn("_up", crosses("close", "_m145")).withColumn("_met", crosses("_m90", "_m145") | crosses("_m145", "_m90")).withColumn("_rose", true(F.col("_m5") > F.lag("_m5").over(by())))
    above, below = true(c > F.col("_m145")), true(c < F.col("_m145"))
    d = d.withColumn("_since", since(F.col("_up")))
    base = (since(true(F.col("_m5") >= F.col("_m90"))) >= 45) & (F.col("_m5") < F.col("_m90")) & (count(F.col("_rose"), 10) >= 7)
    left = (F.col("_since") <= 10) & above & (since(below) > F.col("_since")) & (count(above, 45) == F.col("_since") + 1)
    near = (c <= 1.06 * F.greatest("_m90", "_m145")) & (c <= 1.10 * F.col("_m145")) & (count(F.col("_met"), 45) == 0)
    return d.select("code", "d", true(base & left & near).alias("entry"), below.alias("exit"))


def _rolling(x: np.ndarray, n: int, how: str) -> np.ndarray:
    """Partial at the start, as all counts and extremes of the formulas are."""
    return getattr(pd.Series(x.astype(float)).rolling(n, min_periods=1), how)().to_numpy()


def _before(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if n < len(x):
        out[n:] = x[:-n]
    return out


def _tail_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the last n values, fewer at the start; each added up as one alone."""
    out = np.array([x[: k + 1].mean() for k in range(min(n - 1, len(x)))])
    return np.concatenate([out, np.lib.stride_tricks.sliding_window_view(x, n).copy().mean(axis=1)]) if len(x) >= n else out


def volume_base(p: dict, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Entry where the close leaves a dry base that began with a burst of volume; exit below the 20-day mean."""
    c, h, lo, v, a = (p[k] for k in ("close", "high", "low", "vol", "amount"))
    v10 = ma(v, 10)
    v20, a20, m20 = pd.DataFrame({"v": v, "a": a, "c": c}).rolling(20).mean().to_numpy().T
    with np.errstate(invalid="ignore", divide="ignore"):
        burst = (v >= 2 * v20) | (a >= 2 * a20)
        ret4 = c / _before(c, 4) - 1
        high20 = _before(_rolling(h, 20, "max"), 1)
        rise = m20 > _before(m20, 1)
        now = (v20 > 0) & (_tail_mean(v, 5) > 0.60 * v20) & (ret4 >= 0) & (ret4 <= 0.60) & ((c >= high20) | ((c > m20) & rise))
    ok = np.zeros(len(c), bool)
    at = np.flatnonzero(now)
    if len(at) and burst.any():
        # the bars that may enter are met with each distance of a burst at once; extremes grow bar by bar going back
        n = np.arange(*BASE)
        back = np.maximum(at[:, None] - np.arange(1, BASE[1]), 0)
        top, low = np.maximum.accumulate(h[back], axis=1)[:, n - 2], np.minimum.accumulate(lo[back], axis=1)[:, n - 2]
        half = n - 1 - (n - 1) // 2
        late = np.stack([v[np.maximum(at[:, None] + np.arange(-k, 0), 0)].mean(axis=1) for k in range(half[0], half[-1] + 1)], axis=1)[:, half - half[0]]
        s, i = at[:, None] - n, at[:, None]
        known = (s >= 0) & burst[s]
        with np.errstate(invalid="ignore", divide="ignore"):
            flat = (low > 0) & ((top - low) / low <= 0.35)
            box = (0.75 * c[s] <= c[i]) & (c[i] <= 1.60 * h[s])
            dry = (late <= 0.30 * _tail_mean(v, 21)[s]) | (late <= 0.55 * v[s]) | (v10 < v20)[i]
        ok[at] = (known & flat & box & dry).any(axis=1)
    first = ok & ~np.concatenate([[False], ok[:-1]]) if len(c) else ok
    with np.errstate(invalid="ignore"):
        return (cooldown(first, gap) if gap else first), c < m20


def volume_base_signals(bars: DataFrame) -> DataFrame:
    """volume_base of each code; a code's history is bounded by years of trading days."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        t = t.take(pc.sort_indices(t, [("d", "ascending")]))
        entry, leave = volume_base({k: t[k].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("high", "low", "close", "vol", "amount")})
        return pa.table({"code": t["code"], "d": t["d"], "entry": entry.astype(bool), "exit": leave.astype(bool)})

    code = bars.schema["code"].dataType.simpleString()
    return bars.select("code", "d", "high", "low", "close", "vol", "amount").groupBy("code").applyInArrow(run, SIGNALS.format(code=code))


FORMULAS = {"raw_crossing": raw_crossing, "pullback_confirm": pullback_confirm, "average_base": average_base, "volume_base": volume_base_signals}


def signals(bars: DataFrame, formula: str) -> DataFrame:
    """(code, d, entry, exit) of a formula by name."""
    return FORMULAS[formula](bars)


def overlaps(entries: dict[str, DataFrame]) -> DataFrame:
    """(a, b, shared): entries that two formulas have in common."""
    both = None
    for name, df in entries.items():
        one = df.filter("entry").select("code", "d", F.lit(name).alias("f"))
        both = one if both is None else both.unionByName(one)
    sets = both.groupBy("code", "d").agg(F.array_sort(F.collect_set("f")).alias("fs"))
    pairs = sets.select(F.explode("fs").alias("a"), "fs").select("a", F.explode("fs").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
