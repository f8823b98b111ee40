"""Research operators: event outcomes, effective sample sizes, holding episodes, rallies, paper trades."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import calendar as C
from tidemark.operators import windows as X

Z = 1.959963984540054


def outcome(bars: DataFrame, hold: int) -> DataFrame:
    """Each bar as an event: entry at the next open, exit at the close `hold` days after it; censored where the data end."""
    w = W.partitionBy("code").orderBy("d")
    entry, out = F.lead("open", 1).over(w), F.lead("close", hold + 1).over(w)
    d = bars.select("code", "d", F.row_number().over(w).cast("long").alias("bar"), entry.alias("entry"), out.alias("exit"))
    ret = F.when(F.col("entry") > 0, F.col("exit") / F.col("entry") - 1)
    return d.withColumn("censored", F.col("entry").isNull() | F.col("exit").isNull()).withColumn("ret", ret).withColumn("win", F.when(ret.isNotNull(), ret > 0))


def baseline(out: DataFrame, keys: list[str]) -> DataFrame:
    """Count, share of wins (flat counts as a loss) and median return of uncensored outcomes."""
    known = F.col("ret").isNotNull()
    return out.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.median("ret").alias("median_ret"))


def wilson(wins: Column, n: Column) -> tuple[Column, Column]:
    p = wins / F.nullif(n, F.lit(0))
    mid, spread = (p + Z * Z / (2 * n)) / (1 + Z * Z / n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return mid - spread, mid + spread


def greedy_count(positions: Column, gap: int) -> Column:
    """How many of the sorted positions stay when each kept one blocks the next `gap`."""
    step = lambda s, p: F.when(s["last"].isNull() | (p > s["last"] + gap), F.struct((s["n"] + 1).alias("n"), p.alias("last"))).otherwise(s)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    return F.aggregate(F.array_sort(positions), start, step)["n"]


def pair_stats(signals: DataFrame, base: DataFrame, hold: int) -> DataFrame:
    """By code: signals and wins, effective sizes without overlap, their harmonic size, Wilson bounds and half width, tier.

    signals: outcome() rows that are signals; base: outcome() of all bars.
    """
    s = signals.filter("ret IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n_sig"), F.sum(F.col("win").cast("long")).alias("wins"), greedy_count(F.collect_list("bar"), hold).alias("n_eff_sig"))
    b = base.filter("ret IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n_days"), F.avg(F.col("win").cast("double")).alias("base_wr"))
    d = s.join(b, "code").withColumn("n_eff_base", F.floor((F.col("n_days") - 1) / (hold + 1)) + 1)
    pair = F.when((F.col("n_eff_sig") > 0) & (F.col("n_eff_base") > 0), 1 / (1 / F.col("n_eff_sig") + 1 / F.col("n_eff_base"))).otherwise(0.0)
    d = d.withColumn("wr", F.col("wins") / F.col("n_sig")).withColumn("n_pair", pair)
    size = F.col("n_eff_sig").cast("double")  # the bounds must not gain from overlapping signals
    lo, hi = wilson(F.col("wr") * size, size)
    half = Z * F.sqrt(F.col("wr") * (1 - F.col("wr")) / F.col("n_eff_sig") + F.col("base_wr") * (1 - F.col("base_wr")) / F.col("n_eff_base"))
    tier = F.when(F.col("n_pair") < 10, "too_few").when(F.col("n_pair") < 30, "low").when(F.col("n_pair") < 200, "fair").otherwise("good")
    return d.withColumn("excess", F.col("wr") - F.col("base_wr")).withColumn("wilson_lo", lo).withColumn("wilson_hi", hi).withColumn("half_width", half).withColumn("tier", tier)


def nav(returns: DataFrame, day: str, ret: str) -> DataFrame:
    """(day, bag_ret, nav, drawdown): equal-weight bags by day, compounded."""
    bag = returns.groupBy(F.col(day).alias("d")).agg(F.avg(ret).alias("bag_ret"))
    w = W.partitionBy(F.lit(0)).orderBy("d").rowsBetween(W.unboundedPreceding, 0)  # days only: bounded by years
    d = bag.withColumn("nav", F.exp(F.sum(F.log1p("bag_ret")).over(w)))
    return d.withColumn("drawdown", 1 - F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)))


def rally_scan(bars: DataFrame, side: int = 20, ahead: int = 250, gain: float = 0.6, least: int = 20) -> DataFrame:
    """(code, bottom, peak, gain, days): pivot lows whose highest high ahead gains enough; after a hit, go on past its peak.

    A hit hides the bars up to its peak, so a code's history is walked in order: one code to a group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        lo, hi, d = pdf["low"].to_numpy(), pdf["high"].to_numpy(), pdf["d"].to_numpy()
        n, i, rows = len(pdf), 0, []
        while i < n:
            a, b = max(0, i - side), min(n, i + side + 1)
            if i >= side and i + side < n and lo[i] == lo[a:b].min() and i + 1 < n:
                ahead_hi = hi[i + 1 : i + 1 + ahead]
                k = int(ahead_hi.argmax())
                if lo[i] > 0 and ahead_hi[k] / lo[i] - 1 >= gain and k + 1 >= least:
                    rows.append((pdf["code"].iloc[0], d[i], d[i + 1 + k], ahead_hi[k] / lo[i] - 1, k + 1))
                    i += k + 1
            i += 1
        return pd.DataFrame(rows, columns=["code", "bottom", "peak", "gain", "days"])

    code = bars.schema["code"].dataType.simpleString()
    return bars.select("code", "d", "low", "high").groupBy("code").applyInPandas(run, f"code {code}, bottom date, peak date, gain double, days long")


def pivot_lows(bars: DataFrame, side: int, ahead: int) -> DataFrame:
    """Bars that are the low of the `side` bars around them, with the highest high ahead and whether all of it is known."""
    w = W.partitionBy("code").orderBy("d")
    around, after = w.rowsBetween(-side, side), w.rowsBetween(1, ahead)
    full = F.count(F.lit(1)).over(around) == 2 * side + 1
    d = bars.withColumn("pivot", full & (F.col("low") == F.min("low").over(around)))
    return d.withColumn("peak", F.max("high").over(after)).withColumn("complete", F.count(F.lit(1)).over(after) == ahead).filter("pivot").drop("pivot")


_EPISODE = "array<struct<opened:date,closed:date,status:string,seeded:boolean,peak_shares:double,cost:double,realized:double>>"


def _walk() -> str:
    """The fold of a pair's moves, in order: s holds the open episode and the ended ones, m is the next move."""
    state = ("open", "opened", "seeded", "shares", "peak", "cost", "realized", "done")

    def to(**new: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {new.get(k, f's.{k}')}" for k in state) + ")"

    def ended(status: str, day: str, realized: str) -> str:
        return f"array_append(s.done, named_struct('opened', s.opened, 'closed', {day}, 'status', {status}, 'seeded', s.seeded, 'peak_shares', s.peak, 'cost', s.cost, 'realized', {realized}))"

    known, last_leg = "(m.price IS NOT NULL AND NOT isnan(m.price))", "s.realized + s.shares * (m.price - s.cost)"
    fresh = {"open": "true", "opened": "m.d", "seeded": "m.kind <> 'new'", "shares": "m.shares", "peak": "m.shares", "cost": "m.price", "realized": "0D"}
    none = "0D"
    steps = (
        ("m.kind = 'exit' AND NOT s.open", "s"),
        (f"m.kind = 'exit' AND {known}", to(open="false", done=ended("'closed'", "m.d", last_leg))),
        ("m.kind = 'exit'", to(open="false", done=ended("'unpriced_close'", "m.d", "s.realized"))),
        (f"NOT {known} OR m.shares IS NULL OR isnan(m.shares)", "s"),
        ("NOT s.open", to(**fresh)),
        ("m.kind = 'new'", to(**fresh, done=ended("'superseded'", "m.d", last_leg))),
        ("m.kind = 'hold'", "s"),
        ("m.shares > s.shares", to(shares="m.shares", peak="greatest(s.peak, m.shares)", cost="(s.cost * s.shares + (m.shares - s.shares) * m.price) / m.shares")),
    )
    trim = to(shares="m.shares", realized="s.realized + (s.shares - m.shares) * (m.price - s.cost)")
    start = f"named_struct('open', false, 'opened', CAST(NULL AS date), 'seeded', false, 'shares', {none}, 'peak', {none}, 'cost', {none}, 'realized', {none}, 'done', CAST(array() AS {_EPISODE}))"
    left = ended("'holding'", "CAST(NULL AS date)", "s.realized")
    return f"aggregate(moves, {start}, (s, m) -> CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in steps)} ELSE {trim} END, s -> CASE WHEN s.open THEN {left} ELSE s.done END)"


def episodes(moves: DataFrame) -> DataFrame:
    """Holding episodes of each (holder, stock) from dated moves (holder, stock, d, seq, kind, shares, price).

    kind: new, add, trim, hold or exit. An exit closes at its price, or stays unpriced without one; other moves without
    a price are skipped. A new position over an open one supersedes it, and the old one's shares are realised at that
    price; hold leaves an open position as it is; add, trim or hold without one seeds it. The moves of one pair are
    folded in order, in the JVM (their number is bounded by reports).
    """
    one = F.struct("d", "seq", "kind", F.col("shares").cast("double").alias("shares"), F.col("price").cast("double").alias("price"))
    walked = moves.groupBy("holder", "stock").agg(F.array_sort(F.collect_list(one)).alias("moves")).select("holder", "stock", F.explode(F.expr(_walk())).alias("e"))
    paid = F.col("e.cost") * F.col("e.peak_shares")
    return walked.select("holder", "stock", "e.*", F.when(paid > 0, F.col("e.realized") / paid).alias("ret"))


def profiles(eps: DataFrame, least: int = 10) -> DataFrame:
    """By holder: closed and open episodes, win rate and median return of the rankable ones, and a status."""
    rank = (F.col("status") == "closed") & ~F.col("seeded") & F.col("ret").isNotNull()
    g = eps.groupBy("holder").agg(
        F.count(F.lit(1)).alias("episodes"), F.count(F.when(F.col("status") == "holding", 1)).alias("holding"), F.count(F.when(rank, 1)).alias("rankable"),
        F.avg(F.when(rank, (F.col("ret") > 0).cast("double"))).alias("win_rate"), F.median(F.when(rank, F.col("ret"))).alias("median_ret"),
    )
    status = F.when(F.col("rankable") >= least, "ranked").when(F.col("rankable") > 0, "low_sample").when(F.col("holding") == F.col("episodes"), "holding_only").otherwise("no_closed")
    return g.withColumn("metrics_status", status)


def paper_fills(picks: DataFrame, bars: DataFrame, hold: int, band: float = 0.1, commission: float = 0.00025, stamp: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """picks (code, d) filled at the next open and left at the open `hold` days later, by day ordinals of the code's bars.

    No fill without a bar, with no volume, or opening at the limit; net return after costs on both sides.
    """
    w = W.partitionBy("code").orderBy("d")
    b = bars.withColumn("entry_open", F.lead("open", 1).over(w)).withColumn("entry_vol", F.lead("vol", 1).over(w)).withColumn("exit_open", F.lead("open", hold + 1).over(w)).withColumn("exit_vol", F.lead("vol", hold + 1).over(w))
    d = picks.join(b.select("code", "d", "close", "entry_open", "entry_vol", "exit_open", "exit_vol"), ["code", "d"])
    reason = (
        F.when(F.col("entry_open").isNull(), "no_bar").when((F.col("entry_open") <= 0) | (F.col("entry_vol") <= 0), "suspended").when(F.col("entry_open") >= F.col("close") * (1 + band) - 1e-9, "limit_up")
        .when(F.col("exit_open").isNull(), "exit_no_bar").when((F.col("exit_open") <= 0) | (F.col("exit_vol") <= 0), "exit_suspended").otherwise("filled")
    )
    buy, sell = commission + slippage, commission + stamp + slippage
    net = F.when(F.col("reason") == "filled", F.col("exit_open") * (1 - sell) / (F.col("entry_open") * (1 + buy)) - 1)
    return d.withColumn("reason", reason).withColumn("net", net).select("code", "d", "reason", "net")


def event_hold(events: DataFrame, bars: DataFrame, max_hold: int = 20, chase: int = 3) -> DataFrame:
    """(code, entered, left, status, ret): buy at the next tradable open after an entry event, leave at the next tradable
    open after an exit event or after max_hold calendar days, never on the day of entry, and never two at once.

    Decisions depend on what was done before, so a code's events are walked in order: one code to a group.
    """
    code = bars.schema["code"].dataType.simpleString()
    both = events.select("code", "d", F.col("kind"), F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("vol")).unionByName(bars.select("code", "d", F.lit("bar").alias("kind"), F.col("open").cast("double").alias("open"), F.col("vol").cast("double").alias("vol")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf[pdf["kind"] == "bar"].sort_values("d")
        days, opens, vols = b["d"].tolist(), b["open"].to_numpy(), b["vol"].to_numpy()
        tradable = (opens > 0) & (vols > 0)
        at, ahead = np.array(days, dtype="datetime64[D]"), [None] * (len(days) + 1)
        for k in range(len(days) - 1, -1, -1):  # the next tradable bar from each one on, in one pass backwards
            ahead[k] = k if tradable[k] else ahead[k + 1]
        after = lambda day: int(np.searchsorted(at, np.datetime64(day), "right"))
        nxt = lambda day: ahead[after(day)]
        ev = sorted(((d, 0 if k == "entry" else 1) for d, k in zip(pdf["d"], pdf["kind"], strict=True) if k in ("entry", "exit")))
        rows, free = [], None
        for d, what in ev:
            if what or (free is not None and d < free):
                continue
            first, k = after(d), nxt(d)
            if k is None or k - first > chase:
                rows.append((pdf["code"].iloc[0], d, None, "unfilled", None))
                free = d
                continue
            out = [x for x, w in ev if w and x >= days[k]]
            ends = [nxt(out[0])] if out else []
            ends.append(nxt(days[k] + timedelta(days=max_hold)))
            ends = [e for e in ends if e is not None and e > k]
            if not ends:
                rows.append((pdf["code"].iloc[0], days[k], None, "window_end", None))
                break
            e = min(ends)
            rows.append((pdf["code"].iloc[0], days[k], days[e], "closed", opens[e] / opens[k] - 1))
            free = days[e]
        return pd.DataFrame(rows, columns=["code", "entered", "left", "status", "ret"])

    return both.groupBy("code").applyInPandas(run, f"code {code}, entered date, left date, status string, ret double")


def walk_forward(days: DataFrame, folds: int, embargo: int, holdout: int) -> DataFrame:
    """(d, role): the last `holdout` trading days are held out, `embargo` days before them and between folds belong to none."""
    n = days.agg(F.count(F.lit(1)).alias("_n"))
    d = days.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("d"))).join(F.broadcast(n), F.lit(True))
    size = F.floor((F.col("_n") - holdout) / folds)
    fold, inside = F.floor((F.col("_i") - 1) / size), F.pmod(F.col("_i") - 1, size)
    role = F.when(F.col("_i") > F.col("_n") - holdout, "holdout").when((fold >= folds) | (inside >= size - embargo), "embargo").otherwise(F.concat(F.lit("fold_"), fold.cast("string")))
    return d.select("d", role.alias("role"))


def first_signal_day(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """events (stock, available, score): one row for each stock and first available day, at the next trading day."""
    g = events.groupBy("stock", "available").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("rows"))
    days = C.trading_days(calendar).select(F.col("d").alias("signal_day"), F.col("n").alias("_k"))
    n = C.ordinals(calendar).select(F.col("day").alias("_day"), "n")
    first = calendar.agg(F.min("d").alias("_first"))
    g = g.join(F.broadcast(n), F.col("available").cast("date") == F.col("_day"), "left").join(F.broadcast(first), F.lit(True))
    g = g.withColumn("_k", F.when(F.col("available") < F.col("_first"), 1).otherwise(F.col("n") + 1))
    return g.join(F.broadcast(days), "_k", "left").select("stock", "available", "score", "rows", "signal_day")


def holder_exits(reports: DataFrame) -> DataFrame:
    """reports (stock, period, holder, shares): those who are in a period and not in the stock's next one."""
    nxt = reports.select("stock", "period").distinct().withColumn("next_period", F.lead("period").over(W.partitionBy("stock").orderBy("period"))).filter("next_period IS NOT NULL")
    later = reports.select("stock", F.col("period").alias("next_period"), "holder").distinct()
    return reports.join(nxt, ["stock", "period"]).join(later, ["stock", "next_period", "holder"], "left_anti").select("stock", "holder", "period", "next_period", "shares")


def concentration(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Change of holders' number from one report to the next, and the run of falls."""
    prev = F.lag(count).over(W.partitionBy(*keys).orderBy("d"))
    d = df.withColumn("change", F.col(count) / F.nullif(prev, F.lit(0)) - 1)
    return X.run_length(d, keys, ["d"], F.col("change") < 0, "falls")
