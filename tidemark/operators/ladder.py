"""Market days by their limits, relative strength, samples of rallies, trades with delays and excess over a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import price as P
from tidemark.session import in_tasks


def limit_days(days: DataFrame, limits: DataFrame, cutoff: str = "093059") -> DataFrame:
    """days (d) with the day's limit-ups, rate of broken ones, promotion rate, ladder, highest rung and early ones.

    limits (code, d, kind U, D or Z, times, first_time without leading zeros). A day without any limit row has no source
    and stays NULL; the promotion rate is that of second and later rungs to the limit-ups of the source day before, NULL
    without any. The ladder is `{}` on a source day without limit-ups, and leaves out rows of unknown rung.
    """
    up = F.col("kind") == "U"
    rung = limits.filter(up & F.col("times").isNotNull()).groupBy("d", "times").agg(F.count(F.lit(1)).alias("n"))
    steps = rung.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("times", "n"))).alias("_l"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("_l", lambda x: F.concat(F.lit('"'), x["times"].cast("string"), F.lit('":'), x["n"].cast("string"))), ","), F.lit("}"))
    day = limits.groupBy("d").agg(
        F.count(F.when(up, 1)).alias("up"), F.count(F.when(F.col("kind") == "D", 1)).alias("down"), F.count(F.when(F.col("kind") == "Z", 1)).alias("broken"),
        F.count(F.when(up & (F.col("times") >= 2), 1)).alias("_on"), F.coalesce(F.max(F.when(up, F.col("times"))), F.lit(0)).cast("long").alias("highest"),
        F.count(F.when(up & (F.lpad(F.col("first_time").cast("string"), 6, "0") <= cutoff), 1)).alias("early"),
    )
    before = F.lag("up").over(W.partitionBy(F.lit(0)).orderBy("d"))  # days only: bounded by years
    day = day.withColumn("promotion", F.col("_on") / F.nullif(before, F.lit(0))).withColumn("broken_rate", F.col("broken") / F.nullif(F.col("up") + F.col("broken"), F.lit(0)))
    day = day.join(steps, "d", "left").withColumn("ladder", F.coalesce(text, F.lit("{}"))).drop("_l", "_on")
    return days.select("d").distinct().join(day, "d", "left")


def relative_strength(series: DataFrame, keys: list[str], benchmark: DataFrame, spans: list[int], level: str) -> DataFrame:
    """series (keys, level, d, close) with rs_n for each span: its move over n rows less the benchmark's over n of its
    days, and rank_n within the level and day; NULL without the whole span, and unranked then. benchmark (d, close)."""
    own, days = W.partitionBy(*keys).orderBy("d"), W.partitionBy(F.lit(0)).orderBy("d")
    move = lambda w, n: F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1
    b = benchmark.select("d", *[move(days, n).alias(f"_b{n}") for n in spans])
    d = series.select(*series.columns, *[move(own, n).alias(f"_s{n}") for n in spans]).join(b, "d", "left")
    for n in spans:
        d = d.withColumn(f"rs_{n}", F.col(f"_s{n}") - F.col(f"_b{n}"))
        d = d.withColumn(f"rank_{n}", F.when(F.col(f"rs_{n}").isNotNull(), F.rank().over(W.partitionBy(level, "d").orderBy(F.desc_nulls_last(f"rs_{n}")))).cast("long"))
    return d.drop(*[f"_{x}{n}" for n in spans for x in "sb"])


def spaced(positions: Column, gap: int) -> Column:
    """Those of the positions that stay, in order, when each kept one hides all before its own place plus gap."""
    step = lambda s, p: F.when((F.size(s) == 0) | (p >= F.element_at(s, -1) + gap), F.array_append(s, p)).otherwise(s)
    return F.aggregate(F.array_sort(positions), F.array().cast("array<long>"), step)


def base_days(lows: int, low: float = 0.85, high: float = 1.25) -> Column:
    """Closes of the `lows` bars before that lie within low to high times the bar's low."""
    before = F.collect_list("close").over(W.partitionBy("code").orderBy("d").rowsBetween(-lows, -1))
    return F.size(F.filter(before, lambda c: (c >= F.col("low") * low) & (c <= F.col("low") * high))).cast("long")


def rally_negatives(bars: DataFrame, positives: DataFrame, side: int = 20, ahead: int = 250, gain: float = 0.6, purge: int = 250, base: int = 40, history: int = 120, gap: int = 20) -> DataFrame:
    """(code, bottom): pivot lows that no rally followed, to be set beside the rallies of positives (code, bottom).

    The low of `side` bars around it, more than `purge` bars from any positive of the code, with `base` days in its base,
    all `ahead` bars known and a gain below `gain`; of these each hides those less than `gap` bars on.

    Positives are stacked with the bars and meet them in the same sort. Bars are counted first, so pass a written table: tasks
    are of a bounded number of bars.
    """
    w = W.partitionBy("code").orderBy("d")
    around, after = w.rowsBetween(-side, side), w.rowsBetween(1, ahead)
    marks = positives.select("code", F.col("bottom").alias("d"), F.lit(True).alias("_hit")).dropna()
    d = bars.select("code", "d", "low", "high", "close", F.lit(True).alias("_bar")).unionByName(marks, allowMissingColumns=True)
    d = in_tasks(d, bars.count(), "code").withColumn("_hit", F.max("_hit").over(W.partitionBy("code", "d"))).filter("_bar").withColumn("i", F.row_number().over(w).cast("long"))
    at = F.when(F.col("_hit"), F.col("i"))
    # backwards first, while rows are narrow
    d = d.withColumn("_next", F.last(at, True).over(W.partitionBy("code").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)))
    d = d.select(
        "code", "d", "i", "low", base_days(history).alias("_base"), F.max("high").over(after).alias("_peak"), F.count(F.lit(1)).over(after).alias("_n"),
        F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_was"), "_next",
        ((F.col("low") == F.min("low").over(around)) & (F.count(F.lit(1)).over(around) == 2 * side + 1)).alias("_pivot"),
    )
    far = (F.col("_was").isNull() | (F.col("i") - F.col("_was") > purge)) & (F.col("_next").isNull() | (F.col("_next") - F.col("i") > purge))
    c = d.filter(F.col("_pivot") & far & (F.col("_base") >= base) & (F.col("_n") == ahead) & (F.col("low") > 0) & (F.col("_peak") / F.col("low") - 1 < gain))
    kept = c.groupBy("code").agg(spaced(F.collect_list("i"), gap).alias("_k"), F.collect_list(F.struct("i", "d")).alias("_c"))
    return kept.select("code", F.explode(F.filter("_c", lambda x: F.array_contains("_k", x["i"]))["d"]).alias("bottom"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, rows): how many rows pass all steps up to each; NULL does not pass. One pass over df."""
    ok, out = F.lit(True), [F.struct(F.lit(0).alias("step"), F.lit("all").alias("name"), F.count(F.lit(1)).alias("rows"))]
    for k, (name, cond) in enumerate(steps, 1):
        ok = ok & F.coalesce(cond, F.lit(False))
        out.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.count(F.when(ok, 1)).alias("rows")))
    return df.agg(F.array(*out).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def held_trades(signals: DataFrame, bars: DataFrame, band: Column, hold: int, delay: int = 3) -> DataFrame:
    """signals (code, d) bought on the next bar and sold `hold` bars later, both at the guarded average price of the day.

    A buy waits at most `delay` more bars while the code is suspended or closes at its upper limit, else it is
    `unfilled`; a sale waits as long as it must while suspended or at the lower limit, else it is `open`. Trades of one
    code may overlap. Which bar a sale falls on is worked out once for each bar, and met by an equi-join on its number.
    """
    w, back = W.partitionBy("code").orderBy("d"), W.partitionBy("code").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    b = P.guarded_vwap(P.limit_flags(bars, band)).withColumn("i", F.row_number().over(w).cast("long"))
    here = F.struct("i", "d", F.col("vwap").alias("px"))
    free = lambda limit: ~F.col("suspended") & ~F.coalesce(F.col(limit), F.lit(False))
    b = b.select("code", "d", "i", F.first(F.when(free("limit_up"), here), True).over(w.rowsBetween(1, 1 + delay)).alias("buy"), F.last(F.when(free("limit_down"), here), True).over(back).alias("sell"))
    bought = signals.select("code", "d").join(b.select("code", "d", "buy"), ["code", "d"]).withColumn("i", F.col("buy.i") + hold)
    d = bought.join(b.select("code", "i", "sell"), ["code", "i"], "left")
    status = F.when(F.col("buy").isNull(), "unfilled").when(F.col("sell").isNull(), "open").otherwise("closed")
    return d.select("code", "d", status.alias("status"), F.col("buy.d").alias("bought"), F.col("sell.d").alias("sold"), (F.col("sell.px") / F.nullif(F.col("buy.px"), F.lit(0.0)) - 1).alias("ret"))


def by_calendar_day(series: DataFrame) -> DataFrame:
    """series (d, close) on every calendar day of its range, each with the newest close known by then."""
    span = series.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("d"))
    w = W.partitionBy(F.lit(0)).orderBy("d").rowsBetween(W.unboundedPreceding, 0)  # days only: bounded by years
    return span.join(series, "d", "left").select("d", F.last("close", True).over(w).alias("close"))


def enriched(episodes: DataFrame, benchmark: DataFrame, passive: DataFrame) -> DataFrame:
    """episodes (holder, opened, closed, status, seeded, ret) with alpha, passive and rankable.

    alpha: ret less the benchmark's move between its newest closes by the two ends; NULL where one is before its first
    or after its last day. passive (holder): holders that follow an index. Rankable: closed, not seeded, not passive,
    alpha known. The benchmark is one row a day, so its calendar is small enough to broadcast.
    """
    b = F.broadcast(by_calendar_day(benchmark))
    d = episodes.join(b.select(F.col("d").alias("opened"), F.col("close").alias("_a")), "opened", "left").join(b.select(F.col("d").alias("closed"), F.col("close").alias("_b")), "closed", "left")
    d = d.join(passive.select("holder").distinct().withColumn("_p", F.lit(True)), "holder", "left").withColumn("passive", F.coalesce("_p", F.lit(False)))
    d = d.withColumn("alpha", F.col("ret") - (F.col("_b") / F.nullif(F.col("_a"), F.lit(0.0)) - 1))
    return d.withColumn("rankable", (F.col("status") == "closed") & ~F.col("seeded") & ~F.col("passive") & F.col("alpha").isNotNull()).drop("_a", "_b", "_p")


def count_updates(held: DataFrame, events: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of held whose column is not the number of their events: keys, held value and counted one; no events are NULL."""
    n = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("counted"))
    return held.select(*keys, F.col(column).alias("held")).join(n, keys, "left").filter(~F.col("held").eqNullSafe(F.col("counted")))


def special_paths(required: DataFrame, names: DataFrame, flags: DataFrame) -> DataFrame:
    """(d, path, missing): how the special codes of a day can be told: `names` where a snapshot of names was taken on
    that day, else `flags` where every required code has a known flag, else NULL, with the number of codes without one.

    required (d, code): codes of the day; names (d, code, name); flags (d, code, flag).
    """
    known = flags.filter("flag IS NOT NULL").select("d", "code").distinct().withColumn("_k", F.lit(True))
    day = required.select("d", "code").distinct().join(known, ["d", "code"], "left").groupBy("d").agg(F.count(F.when(F.col("_k").isNull(), 1)).alias("missing"))
    d = day.join(names.select("d").distinct().withColumn("_n", F.lit(True)), "d", "left")
    return d.select("d", F.when(F.col("_n"), "names").when(F.col("missing") == 0, "flags").alias("path"), "missing")


def special_members(required: DataFrame, names: DataFrame, flags: DataFrame, prefix: str = r"^S?\*?ST") -> DataFrame:
    """(d, code, path): special codes of the days that special_paths() can tell, by the name's prefix or the flag."""
    p = special_paths(required, names, flags)
    one = names.filter(F.upper(F.trim("name")).rlike(prefix)).select("d", "code", F.lit("names").alias("path"))
    two = flags.filter("flag").select("d", "code", F.lit("flags").alias("path"))
    return one.unionByName(two).distinct().join(p.select("d", "path"), ["d", "path"]).select("d", "code", "path")


def edge_gates(df: DataFrame, claim_trades: int, claim_folds: int, trades: int, drawdown: float, holdout: float = 0.0) -> DataFrame:
    """df (claimable, folds, trades, ret, max_drawdown, holdout_ret) with verdict: short_window before any other reason,
    then passed if the held-out return, the drawdown, the trades and the return all do, else unmet. NULL passes nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    power = yes(F.col("claimable")) & yes(F.col("trades") >= claim_trades) & yes(F.col("folds") >= claim_folds)
    edge = yes(F.col("holdout_ret") > holdout) & yes(F.col("max_drawdown") <= drawdown) & yes(F.col("trades") >= trades) & yes(F.col("ret") > 0)
    return df.withColumn("verdict", F.when(~power, "short_window").when(edge, "passed").otherwise("unmet"))
