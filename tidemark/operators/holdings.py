"""Holding episodes on three bases of cost: the window's average price, its last close, and the seats' own price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.relational import asof_join

BASES = ("c1", "c2", "c3")
#: Days before the first report of a stock that count as its window.
FIRST = 92


def window_prices(reports: DataFrame, bars: DataFrame, seats: DataFrame) -> DataFrame:
    """(code, d, start, c1, c2, c3): prices of the window (start, d] that ends with each report (code, d).

    A window begins with the report before, the first one FIRST days earlier. c1 is the closes' average by volume, c2 the last
    close at or before the report (of the window or not), c3 the closes' average by the seats' absolute net purchase (seats:
    code, d, net; several a day add up), NULL without any. Windows of a code do not overlap, so each bar belongs to the next
    report on or after its day: both are stacked and sorted once. Repeated reports are one.
    """
    w = W.partitionBy("code").orderBy("d")
    r = reports.select("code", "d").filter("code IS NOT NULL AND d IS NOT NULL").distinct().withColumn("start", F.coalesce(F.lag("d").over(w), F.date_sub("d", FIRST)))
    put = seats.groupBy("code", "d").agg(F.sum(F.abs("net")).alias("seat"))
    b = bars.select("code", "d", "close", "vol").join(put, ["code", "d"], "left")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("close", "double"), ("vol", "double"), ("seat", "double"))]
    stack = b.select("code", "d", F.lit(0).alias("_side"), F.lit(None).cast("struct<d: date, start: date>").alias("_r"), F.col("close").cast("double").alias("close"), F.col("vol").cast("double").alias("vol"), F.col("seat").cast("double").alias("seat"))
    stack = stack.unionByName(r.select("code", "d", F.lit(1).alias("_side"), F.struct("d", "start").alias("_r"), *none))
    # from the last day back, so that the next report is carried along; a frame to the end would begin anew for every row
    back = W.partitionBy("code").orderBy(F.desc("d"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0)
    own = stack.withColumn("_w", F.last("_r", True).over(back)).filter((F.col("_side") == 0) & (F.col("d") > F.col("_w.start")))
    average = lambda by: F.sum(F.col("close") * F.col(by)) / F.nullif(F.sum(F.when(F.col("close").isNotNull(), F.col(by))), F.lit(0.0))
    sums = own.groupBy("code", F.col("_w.d").alias("d")).agg(average("vol").alias("c1"), average("seat").alias("c3"))
    last = asof_join(r, bars.filter("close IS NOT NULL").select("code", F.col("d").alias("day"), F.col("close").alias("c2")), ["code"], "d", "day", ["c2"])
    return last.join(sums, ["code", "d"], "left").select("code", "d", "start", "c1", "c2", "c3")


def _state(s: Column, **new: Column) -> Column:
    """The state s with some fields changed."""
    kinds = {"open": "boolean", "opened": "date", "seeded": "boolean", "shares": "double", "peak": "double", "adds": "bigint", "trims": "bigint"}
    kinds |= {f"{x}_{b}": "double" for x in ("cost", "gain") for b in BASES}
    return F.struct(*[new.get(f, s[f]).cast(t).alias(f) for f, t in kinds.items()], new.get("done", s["done"]).alias("done"))


def _ended(s: Column, status: str, day: Column, gains: dict[str, Column]) -> Column:
    one = F.struct(
        s["opened"].alias("opened"), day.cast("date").alias("closed"), F.lit(status).alias("status"), s["seeded"].alias("seeded"), s["peak"].alias("peak"), s["adds"].alias("adds"), s["trims"].alias("trims"),
        *[s[f"cost_{b}"].alias(f"cost_{b}") for b in BASES], *[gains[b].cast("double").alias(f"gain_{b}") for b in BASES],
    )
    return F.concat(s["done"], F.array(one))


def cost_episodes(moves: DataFrame) -> DataFrame:
    """Episodes of each (holder, stock) from dated moves (holder, stock, d, seq, kind, shares, change, c1, c2, c3).

    kind: new, add, trim, hold or exit. All three bases are carried through one fold in the order of (d, seq); where c2 or c3
    is missing or 0, c1 stands in. An exit closes at the window's prices, or leaves the last part unpriced without c1; every
    other move without c1 is skipped. new opens an episode, and one that is still open is superseded at these prices; add, trim
    or hold without an open one open it as seeded. add raises the cost by its change (if it and the new shares are above 0),
    trim realises its change, or all shares if that is less; shares are those of the move, or else what the change makes of
    them. hold changes nothing. What is open at the end is `holding`. A cost of 0 realises nothing at the end of an episode.

    Columns: opened, closed, status, seeded, peak, adds, trims, cost_c1 to cost_c3 and gain_c1 to gain_c3. The moves of a pair
    are bounded by its reports and are folded in the JVM.
    """
    num = lambda c: F.col(c).cast("double").alias(c)
    one = F.struct("d", "seq", "kind", num("shares"), num("change"), *[num(b) for b in BASES])
    pairs = moves.groupBy("holder", "stock").agg(F.array_sort(F.collect_list(one)).alias("moves"))
    zero, no, none = F.lit(0.0), F.lit(False), F.lit(None)
    ended = "array<struct<opened: date, closed: date, status: string, seeded: boolean, peak: double, adds: bigint, trims: bigint, " + ", ".join(f"{x}_{b}: double" for x in ("cost", "gain") for b in BASES) + ">>"
    fields = {"open": no, "opened": none, "seeded": no, "shares": zero, "peak": zero, "adds": F.lit(0), "trims": F.lit(0)} | {f"{x}_{b}": zero for x in ("cost", "gain") for b in BASES}
    blank = F.struct(*[v.alias(k) for k, v in fields.items()], F.array().cast(ended).alias("done"))
    start = _state(blank)

    def step(s: Column, m: Column) -> Column:
        c1 = F.when(~F.isnan(m["c1"]), m["c1"])
        price = {b: F.when(m[b].isNull() | F.isnan(m[b]) | (m[b] == 0), c1).otherwise(m[b]) for b in BASES[1:]} | {"c1": c1}
        # what the rest of the shares made at these prices
        out = {b: s[f"gain_{b}"] + F.when((price[b] != 0) & (s[f"cost_{b}"] != 0), s["shares"] * (price[b] - s[f"cost_{b}"])).otherwise(0.0) for b in BASES}
        held = {b: s[f"gain_{b}"] for b in BASES}
        left = {"open": no}
        closed = _state(s, **left, done=_ended(s, "closed", m["d"], out))
        unpriced = _state(s, **left, done=_ended(s, "unpriced_close", m["d"], held))
        begun = {"open": F.lit(True), "opened": m["d"], "seeded": m["kind"] != "new", "shares": F.coalesce(m["shares"], zero), "peak": F.coalesce(m["shares"], zero), "adds": F.lit(0), "trims": F.lit(0)}
        begun |= {f"cost_{b}": price[b] for b in BASES} | {f"gain_{b}": zero for b in BASES}
        fresh, instead = _state(s, **begun), _state(s, **begun, done=_ended(s, "superseded", m["d"], out))
        delta = F.coalesce(m["change"], zero)
        more = F.coalesce(m["shares"], s["shares"] + delta)
        cost = {f"cost_{b}": F.when((more > 0) & (delta > 0), (s[f"cost_{b}"] * s["shares"] + delta * price[b]) / more).otherwise(s[f"cost_{b}"]) for b in BASES}
        added = _state(s, shares=more, peak=F.greatest(s["peak"], more), adds=s["adds"] + 1, **cost)
        sold = F.least(F.abs(delta), s["shares"])
        trimmed = _state(s, shares=F.coalesce(m["shares"], s["shares"] - sold), trims=s["trims"] + 1, **{f"gain_{b}": s[f"gain_{b}"] + sold * (price[b] - s[f"cost_{b}"]) for b in BASES})
        known = m["kind"].isin("new", "add", "trim", "hold")
        exit_ = m["kind"] == "exit"
        return (
            F.when(exit_ & ~s["open"], s).when(exit_ & c1.isNull(), unpriced).when(exit_, closed).when(c1.isNull() | ~F.coalesce(known, no), s)
            .when(~s["open"], fresh).when(m["kind"] == "new", instead).when(m["kind"] == "add", added).when(m["kind"] == "trim", trimmed).otherwise(s)
        )

    finish = lambda s: F.when(s["open"], _ended(s, "holding", none, {b: s[f"gain_{b}"] for b in BASES})).otherwise(s["done"])
    return pairs.select("holder", "stock", F.explode(F.aggregate("moves", start, step, finish)).alias("e")).select("holder", "stock", "e.*")
