"""Trades sold by the first of several rules, with delays where a code cannot be traded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import price as P
from tidemark.session import in_tasks


def sell_rule_trades(signals: DataFrame, bars: DataFrame, band: Column, hold: int, exits: list[tuple[str, Column]] | None = None, trail: float | None = None, delay: int = 3) -> DataFrame:
    """One row for each different signal (code, d) that is a bar: status, when and how it was bought and sold, and what it made.

    Bought on the next bar at the day's guarded average price; a buy waits at most `delay` more bars while the code is
    suspended or closes at its upper limit. Sold by whatever comes first after the buy: a bar on which a condition of exits
    holds (the first in the list names it), a close more than `trail` below the highest close since the buy, or `hold` bars;
    of those on one bar exits come before the trail, and that before `hold`. A sale waits as long as it must while the code is
    suspended or at its lower limit.

    status: `pending` (no next bar yet), `unfilled` (reason: what blocked the last bar tried), `open` (no rule met by the last
    bar: latest and ret to it, and left, the bars still to go), `blocked` (due, but never tradable since; reason: what blocks the
    last bar) or `closed`. drop is the lowest low from the buy to the sale (or last bar) against the buy price, 0 at most. A
    price of 0 or less gives no return. Trades of one code may overlap; repeated signals are one.

    Everything is frames over one code's bars: the bars ahead of a buy are an array of at most hold + 1, walked once. Signals
    are stacked with the bars and meet them in the same sort. Bars are counted first, so pass a written table: tasks are of a
    bounded number of bars.
    """
    w = W.partitionBy("code").orderBy("d")
    down = W.partitionBy("code").orderBy(F.desc("d"))
    back, later = down.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, -1)
    soon, ahead = w.rowsBetween(1, 1 + delay), w.rowsBetween(0, hold)
    asked = signals.select("code", "d", F.lit(True).alias("_signal")).dropna()
    b = in_tasks(bars.withColumn("_bar", F.lit(True)).unionByName(asked, allowMissingColumns=True), bars.count(), "code")
    b = b.withColumn("_signal", F.max("_signal").over(W.partitionBy("code", "d"))).filter("_bar")
    b = P.guarded_vwap(P.limit_flags(b, band))
    rule = F.lit(None).cast("string")
    for name, met in reversed(exits or []):
        rule = F.when(met, name).otherwise(rule)
    stop = lambda limit, name: F.when(F.col("suspended"), "suspended").when(F.coalesce(F.col(limit), F.lit(False)), name)
    b = b.withColumns({"i": F.row_number().over(w).cast("long"), "_rule": rule, "_no_buy": stop("limit_up", "limit_up"), "_no_sell": stop("limit_down", "limit_down")})
    b = b.withColumn("_sell", F.last(F.when(F.col("_no_sell").isNull(), F.struct("i", "d", F.col("vwap").alias("px"))), True).over(back))
    b = b.withColumns({
        # the bars that share a sale lie before it, so this is the lowest low from a bar to its sale
        "_tail": F.min("low").over(W.partitionBy("code", "_sell.i").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)),
        "_exit": F.last(F.when(F.col("_rule").isNotNull(), F.struct("i", F.col("_rule").alias("rule"))), True).over(later),
        "_end": F.first(F.struct("i", "d", F.col("vwap").alias("px"), F.col("_no_sell").alias("why"))).over(back),
    })
    b = b.withColumn("_ahead", F.collect_list(F.struct("i", "low", "close", F.col("_sell").alias("sell"), F.col("_tail").alias("tail"))).over(ahead))
    here = F.struct("i", "d", F.col("vwap").alias("px"), F.col("_exit").alias("exit"), F.col("_ahead").alias("ahead"))
    b = b.withColumns({"_buy": F.first(F.when(F.col("_no_buy").isNull(), here), True).over(soon), "_why": F.last("_no_buy", True).over(soon)})
    t = b.filter("_signal").select("code", "d", "i", F.col("_buy").alias("buy"), F.col("_why").alias("why"), F.col("_end").alias("end"))

    due = F.col("buy.i") + hold
    fallen = F.lit(None).cast("long")
    if trail is not None:
        start = F.struct(F.col("buy.ahead")[0]["close"].alias("top"), F.lit(None).cast("long").alias("at"))
        top = lambda s, x: F.greatest(s["top"], x["close"])
        fallen = F.aggregate(F.expr("slice(buy.ahead, 2, size(buy.ahead))"), start, lambda s, x: F.struct(top(s, x).alias("top"), F.coalesce(s["at"], F.when(x["close"] < top(s, x) * (1 - trail), x["i"])).alias("at")))["at"]
    t = t.withColumn("_fallen", fallen).withColumn("planned", F.when(F.col("buy").isNotNull(), F.least(F.col("buy.exit.i"), F.col("_fallen"), due)))
    t = t.withColumn("by", F.when(F.col("planned") == F.col("buy.exit.i"), F.col("buy.exit.rule")).when(F.col("planned") == F.col("_fallen"), "trail").when(F.col("planned").isNotNull(), "hold"))
    t = t.withColumn("at", F.when(F.col("planned") <= F.col("end.i"), F.try_element_at("buy.ahead", (F.col("planned") - F.col("buy.i") + 1).cast("int"))))
    status = F.when(F.col("i") == F.col("end.i"), "pending").when(F.col("buy").isNull(), "unfilled").when(F.col("at").isNull(), "open").when(F.col("at.sell").isNull(), "blocked").otherwise("closed")
    t = t.withColumn("status", status)
    px = F.when(F.col("buy.px") > 0, F.col("buy.px"))
    is_in = lambda *s: F.col("status").isin(*s)
    passed = F.array_min(F.transform(F.when(is_in("open"), F.col("buy.ahead")).otherwise(F.slice("buy.ahead", F.lit(1), (F.col("planned") - F.col("buy.i") + 1).cast("int"))), lambda x: x["low"]))
    lowest = F.when(is_in("closed"), F.least(passed, F.col("at.tail"))).when(is_in("open"), passed)
    latest = F.when(is_in("closed"), F.col("at.sell.px")).when(is_in("open") & (F.col("end.px") > 0), F.col("end.px"))
    return t.select(
        "code", "d", "status", F.col("buy.d").alias("bought"), F.when(is_in("closed"), F.col("at.sell.d")).alias("sold"), F.when(is_in("closed", "blocked"), F.col("by")).alias("by"),
        F.when(is_in("unfilled"), F.col("why")).when(is_in("blocked"), F.col("end.why")).alias("reason"), (F.col("buy.i") - F.col("i") - 1).alias("buy_delay"), F.when(is_in("closed"), F.col("at.sell.i") - F.col("planned")).alias("sell_delay"),
        F.when(is_in("open"), F.col("planned") - F.col("end.i")).alias("left"), (latest / px - 1).alias("ret"), F.least(lowest / px - 1, F.when(lowest.isNotNull() & px.isNotNull(), F.lit(0.0))).alias("drop"),
    )
