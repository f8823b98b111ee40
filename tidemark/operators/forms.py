"""The form table of a code's days: states of the day beside those of the last closed week and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import states as S
from tidemark.operators import technical as T
from tidemark.operators import windows as X

#: Frames by period, with the windows of each.
FRAMES = {"day": S.DAILY, "week": S.WEEKLY, "month": S.MONTHLY}
#: Bars of one period at most, on any calendar.
PER = {"day": 1, "week": 7, "month": 31}
#: Columns that bars may have besides open to volume; without them limits are unknown.
LIMITS = ("raw_close", "up_limit", "down_limit")


def reach(w: dict) -> int:
    """Bars of a frame that its newest state depends on, the warm-up among them."""
    return 1 + max(w["warmup"], w["pth"], w["rv"] + w["rv_pct"], max(w["ma"]) + w["mom"], w["er"] + 1, w["range"], w["vol"] + 1, w["pctile"], w["rs"])


def lookback(frames: dict[str, dict] = FRAMES, cap: int = 250, before: int = 10) -> int:
    """Daily bars before a day that its row depends on: base and context on top of the daily frame, or the longest closed period.

    One period more is read than is needed, as the first one may be cut, and one for the as-of step back.
    """
    daily = reach(frames["day"]) + max(cap, before) + 1
    return max(daily, *[(reach(w) + 2) * PER[p] for p, w in frames.items() if p != "day"])


def period_labels(bars: DataFrame, calendar: DataFrame, period: str, w: dict) -> DataFrame:
    """(code, d, label): the label of each closed week or month, dated at its last trading day of the calendar.

    Volume is as measured, since limits are of days; the context of days has no part in it.
    """
    d = S.features(T.resample(bars, calendar, period), None, w).withColumns({"vol_ratio_eff": F.col("vol_ratio"), "zvol_eff": F.col("zvol")})
    return S.cells(S.axes(d).filter("known")).select("code", "d", "label")


def form_table(bars: DataFrame, calendar: DataFrame, bench: DataFrame | None = None, frames: dict[str, dict] = FRAMES, tolerance: float = 0.005, breakout: dict | None = None) -> DataFrame:
    """(code, d, position, trend, purity, volume and their scores, label, sub, week, month, breakout, base_days, buyable, sellable, is_one_word).

    bars: (code, d, open, high, low, close, vol) and, if they are known, raw_close, up_limit and down_limit. One row for each
    bar that has a state; those of the warm-up have none. calendar: (d, n) of all trading days, which are known ahead, so that
    a week or month counts from its last trading day on and never before. week and month are the newest closed ones, unknown
    labels included. Without a limit its flag is unknown, not false. bench: (d, bench), a row a day.
    """
    for c in LIMITS:
        if c not in bars.columns:
            bars = bars.withColumn(c, F.lit(None).cast("double"))
    flagged = S.limit_flags(bars, tolerance).select("code", "d", "open", "high", "low", "close", "vol", "is_up_limit", "is_down_limit", "is_one_word")
    d = S.axes(S.effective_views(S.features(flagged, bench, frames["day"])))
    # what follows reads a code's rows in order: those of days and of closed periods meet in one shuffle of narrow rows
    d = d.select("code", "d", F.lit(1).alias("_side"), "high", "close", "known", *[c for n in S.AXES for c in (n, f"{n}_score")], "mom", "ma_dist", "vol_ratio", "vol_ratio_eff", "rv_pctile", "is_up_limit", "is_down_limit", "is_one_word")
    for period in ("week", "month"):
        p = period_labels(bars, calendar, period, frames[period])
        d = d.unionByName(p.select("code", "d", F.lit(0).alias("_side"), F.struct(F.col("label").alias("is")).alias(f"_{period}")), True)
    so_far = X.over(["code"], ["d", "_side"], None, 0)
    d = d.withColumns({p: F.last(f"_{p}", True).over(so_far)["is"] for p in ("week", "month")}).filter("_side = 1").drop("_week", "_month", "_side")
    out = S.labels(S.with_breakouts(d, **(breakout or {})))
    return out.select("code", "d", *S.AXES, *[f"{n}_score" for n in S.AXES], "label", "sub", "week", "month", "breakout", F.col("base_days").cast("long").alias("base_days"), (~F.col("is_up_limit")).alias("buyable"), (~F.col("is_down_limit")).alias("sellable"), "is_one_word")
