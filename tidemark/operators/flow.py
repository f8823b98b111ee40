"""Flow operators: annotated net flow, quiet days, sector and market panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import windows as X


def annotate(df: DataFrame, keys: list[str], prior: int = 120, cum: int = 20, surge: float = 2.5, run: int = 5, quiet: float = 3.0) -> DataFrame:
    """df (keys, d, net, pct) with streak, z, px_cum, cum_net, cum_cnt and regime.

    The streak counts days of one sign of net, signed. z compares net with the `prior` days before, all of them known.
    px_cum compounds pct inside the streak. A surge comes before accumulation, which is silent while |px_cum| < quiet
    and driving when the price moved with the flow; NULL net has a NULL regime.
    """
    o, w = ["d"], X.over(keys, ["d"], -(cum - 1), 0)
    spec = {"full_z_mean": ("avg", "net", -prior, -1), "full_z_sd": ("stddev_samp", "net", -prior, -1)}
    d = X.frames(df, keys, o, spec).withColumns({"_s": X.sign(F.col("net")), "_i": F.row_number().over(X.over(keys, o)), "cum_net": F.sum("net").over(w), "cum_cnt": F.count("net").over(w)})
    d = d.withColumn("z", F.when(F.col("full_z_sd") > 0, (F.col("net") - F.col("full_z_mean")) / F.col("full_z_sd")))
    new = (F.col("_i") == 1) | ~F.col("_s").eqNullSafe(F.lag("_s").over(X.over(keys, o)))
    d = d.withColumn("_new", new).withColumn("_start", F.max(F.when(F.col("_new"), F.col("_i"))).over(X.over(keys, o, None, 0)))
    d = d.withColumn("streak", (F.col("_s") * (F.col("_i") - F.col("_start") + 1)).cast("long")).drop("full_z_mean", "full_z_sd", "_new")
    step = F.when(F.col("pct") > -100, F.ln(1 + F.col("pct") / 100))
    inside = W.partitionBy(*keys, "_start").orderBy(*o).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("px_cum", (F.exp(F.sum(step).over(inside)) - 1) * 100)
    n, z, p, k = F.col("net"), F.col("z"), F.col("px_cum"), F.col("streak")
    regime = (
        F.when(n.isNull(), F.lit(None).cast("string")).when((z >= surge) & (n > 0), "surge_in").when((z <= -surge) & (n < 0), "surge_out")
        .when((k >= run) & (F.abs(p) < quiet), "accum_in_silent").when((k >= run) & (p >= quiet), "accum_in_driving")
        .when((k <= -run) & (F.abs(p) < quiet), "accum_out_silent").when((k <= -run) & (p <= -quiet), "accum_out_driving").otherwise("neutral")
    )
    return d.withColumn("regime", regime).drop("_s", "_i", "_start")


def quiet_days(df: DataFrame, keys: list[str], most: float = 1.0) -> DataFrame:
    """quiet_in and quiet_out: days in a row with |pct| below `most` and net flow of that sign."""
    calm = F.abs("pct") < most
    d = X.run_length(df, keys, ["d"], calm & (F.col("net") > 0), "quiet_in")
    return X.run_length(d, keys, ["d"], calm & (F.col("net") < 0), "quiet_out")


def sector_panel(df: DataFrame, sector: str, n: int = 5) -> DataFrame:
    """(sector, d): members, advancing and declining, net, its rank of the day, n-day cumulated net and breadth."""
    day = df.groupBy(sector, "d").agg(
        F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("pct") > 0, 1)).alias("adv"), F.count(F.when(F.col("pct") < 0, 1)).alias("dec"), F.sum("net").alias("net"), F.sum("amount").alias("amount")
    )
    day = day.withColumn("net_rank", F.rank().over(W.partitionBy("d").orderBy(F.desc_nulls_last("net"))).cast("long"))
    day = day.withColumn("cum_net", F.sum("net").over(X.over([sector], ["d"], -(n - 1), 0)))
    day = day.withColumn("share", F.col("amount") / F.nullif(F.sum("amount").over(W.partitionBy("d")), F.lit(0.0)))
    return day.withColumn("breadth", F.col("adv") / F.nullif(F.col("adv") + F.col("dec"), F.lit(0)))


def market_panel(df: DataFrame, sector: str, top: int = 3) -> DataFrame:
    """(d): breadth, ratio of advancing to declining, turnover, its change, and the strongest codes as JSON."""
    day = df.groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pct") > 0, 1)).alias("adv"), F.count(F.when(F.col("pct") < 0, 1)).alias("dec"), F.sum("amount").alias("amount"), F.count_distinct(sector).alias("sectors")
    )
    w = W.partitionBy("d").orderBy(F.desc_nulls_last("pct"), F.col("code"))
    best = df.filter("pct IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).groupBy("d").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rn", "code"))), lambda x: x["code"])).alias("strongest"))
    days = W.partitionBy(F.lit(0)).orderBy("d")  # days only: bounded by years
    out = day.join(best, "d", "left").withColumn("adv_dec", F.col("adv") / F.nullif(F.col("dec"), F.lit(0)))
    return out.withColumn("amount_change", F.col("amount") - F.lag("amount").over(days))


def behaviour(cum: Column, ret: Column, known: Column, calm: float = 3.0) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when((cum > 0) & (ret <= -calm), "absorbing").when((cum > 0) & (F.abs(ret) < calm), "building").when(cum > 0, "chasing").when((cum < 0) & (ret >= calm), "distributing").when((cum < 0) & (F.abs(ret) < calm), "leaking").when(cum < 0, "fleeing").otherwise("neutral")


def horizon(df: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Latest row of each key with cum_net and window return over `days` known rows, and the behaviour they show."""
    w = X.over(keys, ["d"], -(days - 1), 0)
    known = (F.count("net").over(w) == days) & (F.count(F.lit(1)).over(w) == days)
    d = df.withColumn("known", known).withColumn("cum_net", F.when(known, F.sum("net").over(w))).withColumn("ret", F.when(known, F.sum("pct").over(w)))
    d = d.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("d")))).filter("_rn = 1").drop("_rn")
    return d.withColumn("behaviour", behaviour(F.col("cum_net"), F.col("ret"), F.col("known")))


def seat_fold(df: DataFrame, fold: list[str], rank: list[str], net: str, side: str, reason: str) -> DataFrame:
    """Board rows folded by exact key: distinct sides and reasons joined, number of boards, and net with min = max checked.

    The nth repeat of a row (by rank) is an event of its own, so equal rows on one board do not melt together.
    """
    seq = F.row_number().over(W.partitionBy(*fold, side, reason).orderBy(*rank))
    d = df.withColumn("event_seq", seq.cast("long"))
    g = d.groupBy(*fold, "event_seq").agg(
        F.array_join(F.sort_array(F.collect_set(side)), ",").alias("sides"), F.array_join(F.sort_array(F.collect_set(reason)), "|").alias("reasons"), F.count(F.lit(1)).alias("board_count"), F.min(net).alias("net_lo"), F.max(net).alias("net_hi")
    )
    return g.withColumn("consistent", F.col("net_lo") == F.col("net_hi"))
