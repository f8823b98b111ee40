"""Price and corporate-action operators on daily bars (code, d, open, high, low, close, vol, amount)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_day():
    return W.partitionBy("code").orderBy("d")


def so_far():
    return by_day().rowsBetween(W.unboundedPreceding, 0)


def adjustment_ratio(bars: DataFrame, tolerance: float = 0.005, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """bars (with pre_close) plus ratio and ratio_kind: 1 on the first day and without an event, previous close over
    pre_close at an event, NULL where an input is missing or the ratio is out of bounds."""
    prev = F.lag("close").over(by_day())
    first = F.row_number().over(by_day()) == 1
    r = F.col("_prev") / F.nullif(F.col("pre_close"), F.lit(0.0))
    d = bars.withColumn("_prev", prev).withColumn("_first", first).withColumn("_r", r)
    kind = (
        F.when(F.col("_first"), "first_day")
        .when(F.col("_prev").isNull() | F.col("pre_close").isNull() | F.col("close").isNull(), "missing_input")
        .when(F.abs(F.col("pre_close") - F.col("_prev")) <= tolerance, "no_event")
        .when(F.col("_r").isNull() | ~F.col("_r").between(low, high), "out_of_bounds")
        .otherwise("adjusted")
    )
    d = d.withColumn("ratio_kind", kind)
    ratio = F.when(F.col("ratio_kind").isin("first_day", "no_event"), 1.0).when(F.col("ratio_kind") == "adjusted", F.col("_r"))
    return d.withColumn("ratio", ratio).drop("_prev", "_first", "_r")


def backward_factor(ratios: DataFrame) -> DataFrame:
    """hfq: the product of ratios so far, as exp of a running sum of logarithms; NULL from the first NULL ratio on."""
    log = F.sum(F.ln(F.coalesce("ratio", F.lit(1.0)))).over(so_far())
    broken = F.max(F.col("ratio").isNull().cast("int")).over(so_far())
    return ratios.withColumn("hfq", F.when(broken == 0, F.exp(log)))


def forward_factor(factors: DataFrame) -> DataFrame:
    """qfq: hfq over the code's latest hfq; worked out when read."""
    last = factors.groupBy("code").agg(F.max_by("hfq", "d").alias("_last"))
    return factors.join(last, "code").withColumn("qfq", F.col("hfq") / F.nullif(F.col("_last"), F.lit(0.0))).drop("_last")


def rebased_bars(factors: DataFrame) -> DataFrame:
    """Bars in today's prices: O/H/L/C times qfq, volume in single units, amount in single currency units."""
    px = [(F.col(c) * F.col("qfq")).alias(c) for c in ("open", "high", "low", "close")]
    return factors.select("code", "d", *px, (F.col("vol") * 100).alias("vol"), (F.col("amount") * 1000).alias("amount"), F.max("d").over(W.partitionBy("code")).alias("anchor"))


def guarded_vwap(bars: DataFrame) -> DataFrame:
    """vwap and vwap_kind: of amount / vol and amount / (100 vol), those within 0.5 to 1.5 of the close and 5 % of the
    day's range; the nearest to the close wins, and the close stands in where there is none."""
    v = F.nullif(F.col("vol").cast("double"), F.lit(0.0))
    one, two = F.col("amount") / (v * 100), F.col("amount") / v
    fits = lambda x: x.between(F.col("close") * 0.5, F.col("close") * 1.5) & x.between(F.col("low") * 0.95, F.col("high") * 1.05)
    d = bars.withColumn("_a", F.when(fits(one), one)).withColumn("_b", F.when(fits(two), two))
    gap = lambda c: F.abs(F.col(c) - F.col("close"))
    kind = F.when(F.col("_a").isNotNull() & (F.col("_b").isNull() | (gap("_a") <= gap("_b"))), "lots").when(F.col("_b").isNotNull(), "units").otherwise("close")
    d = d.withColumn("vwap_kind", kind)
    return d.withColumn("vwap", F.when(F.col("vwap_kind") == "lots", F.col("_a")).when(F.col("vwap_kind") == "units", F.col("_b")).otherwise(F.col("close"))).drop("_a", "_b")


def limit_flags(bars: DataFrame, band: Column) -> DataFrame:
    """limit_up, limit_down, one_word, suspended from the previous close and the code's band; NULL where unknown."""
    prev = F.lag("close").over(by_day())
    d = bars.withColumn("_p", prev).withColumn("_b", band)
    up, down = F.round(F.col("_p") * (1 + F.col("_b")), 2), F.round(F.col("_p") * (1 - F.col("_b")), 2)
    known = F.col("_p").isNotNull() & F.col("_b").isNotNull()
    d = d.withColumn("limit_up", F.when(known, F.col("close") >= up - 0.005)).withColumn("limit_down", F.when(known, F.col("close") <= down + 0.005))
    same = (F.abs(F.col("high") - F.col("low")) <= 1e-9 * F.abs("high")) & (F.abs(F.col("open") - F.col("close")) <= 1e-9 * F.abs("open"))
    return d.withColumn("one_word", F.when(known, same & (F.col("limit_up") | F.col("limit_down")))).withColumn("suspended", F.col("vol").isNull() | (F.col("vol") <= 0)).drop("_p", "_b")


def chip_distribution(bars: DataFrame, turnover: str = "turnover") -> DataFrame:
    """(code, d, winner, cost5, cost50, cost95, cost_mean): a histogram of holders' costs that turnover renews.

    A code's days are worked through in order (state is the whole histogram), one code to a group: a history of
    trading days is bounded by years, not by the number of codes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        mass: dict[float, float] = {}
        rows = []
        for d, close, t in zip(pdf["d"], pdf["close"], pdf[turnover], strict=True):
            t = 0.0 if t is None or np.isnan(t) else min(max(float(t), 0.0), 1.0)
            if not mass:
                t = 1.0
            mass = {p: m * (1 - t) for p, m in mass.items() if m * (1 - t) > 1e-12}
            mass[close] = mass.get(close, 0.0) + t
            p = np.array(sorted(mass))
            m = np.array([mass[x] for x in p])
            share = np.cumsum(m) / m.sum()
            at = lambda q: float(p[min(int(np.searchsorted(share, q - 1e-12)), len(p) - 1)])
            rows.append((pdf["code"].iloc[0], d, float(m[p < close].sum() / m.sum()), at(0.05), at(0.5), at(0.95), float((p * m).sum() / m.sum())))
        return pd.DataFrame(rows, columns=["code", "d", "winner", "cost5", "cost50", "cost95", "cost_mean"])

    code = bars.schema["code"].dataType.simpleString()
    return bars.select("code", "d", "close", turnover).filter("close IS NOT NULL").groupBy("code").applyInPandas(run, f"code {code}, d date, winner double, cost5 double, cost50 double, cost95 double, cost_mean double")
