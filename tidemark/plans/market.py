"""Queries of calendar, price, technical and flow operators, each beside its SQL (None: sequential state, tested apart)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import calendar as C
from tidemark.operators import flow as L
from tidemark.operators import price as P
from tidemark.operators import technical as T
from tidemark.operators import windows as X
from tidemark.sources.bars import EVENT_BARS_SQL, LINE_BARS_SQL, event_bars, line_bars
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def off(c, n: int):
    """c rounded to n digits, ties moved aside: engines round exact halves of binary numbers differently."""
    return F.round(F.col(c) + 3 * 10.0 ** -(n + 3) if isinstance(c, str) else c + 3 * 10.0 ** -(n + 3), n)


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- calendar


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS iso, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, isoyear(o_orderdate) * 100 + week(o_orderdate) AS wk, year(o_orderdate) * 100 + month(o_orderdate) AS mon FROM orders")
def cal_conversions(spark, sf):
    d = F.to_date("o_orderdate")
    k = C.period_keys(d)
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("compact"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), k["week"].cast("long").alias("wk"), k["month"].cast("long").alias("mon"))


@query(f"""WITH {EVENT_BARS_SQL}, cal AS (SELECT DISTINCT d FROM bars), r AS (SELECT min(d) AS lo, max(d) AS hi FROM cal), f AS (SELECT code, min(d) - 1 AS since, max(d) AS until FROM bars GROUP BY code)
SELECT code, since, until, CASE WHEN since BETWEEN lo AND hi AND until BETWEEN lo AND hi THEN (SELECT count(*) FROM cal WHERE cal.d > since AND cal.d <= until) END AS days FROM f, r""")
def cal_trading_days_since(spark, sf):
    b = event_bars(spark, sf)
    f = b.groupBy("code").agg(F.date_sub(F.min("d"), 1).alias("since"), F.max("d").alias("until"))
    return C.days_since(f, C.trading_days(b), "since", "until")


@query(f"WITH {LINE_BARS_SQL} SELECT isoyear(d) * 100 + week(d) AS period, max(d) AS period_end FROM (SELECT DISTINCT d FROM bars) GROUP BY 1")
def cal_week_ends(spark, sf):
    return C.period_ends(C.trading_days(line_bars(spark, sf)), "week").withColumn("period", F.col("period").cast("long"))


@query("""SELECT q, CASE month(q) WHEN 3 THEN make_date(year(q), 4, 30) WHEN 6 THEN make_date(year(q), 8, 31) WHEN 9 THEN make_date(year(q), 10, 31) ELSE make_date(year(q) + 1, 4, 30) END AS deadline
FROM (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q FROM orders)""")
def cal_report_deadlines(spark, sf):
    q = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    return table(spark, sf, "orders").select(q.alias("q")).distinct().select("q", C.report_deadline(F.col("q")).alias("deadline"))


@query("SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') AS available FROM orders")
def cal_available_at(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.date_format(C.available_at(F.to_date("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias("available"))


@query("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM orders WHERE CAST(o_orderdate AS DATE) + 2 <= DATE '1996-06-30' GROUP BY 1")
def cal_point_in_time(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderdate IS NOT NULL").withColumns({"event": F.to_date("o_orderdate"), "available": F.date_add(F.to_date("o_orderdate"), 2)})
    return C.pit(o, F.lit("1996-06-30").cast("date"), "available", "event").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1), h AS (SELECT d FROM o WHERE n < 0.4 * (SELECT avg(n) FROM o) AND isodow(d) <= 5)
SELECT CAST(x AS DATE) AS d, coalesce(o.n, 0) AS orders FROM generate_series((SELECT min(d) FROM o), (SELECT max(d) FROM o), INTERVAL 1 DAY) t(x) LEFT JOIN o ON o.d = CAST(x AS DATE) WHERE isodow(x) <= 5 AND CAST(x AS DATE) NOT IN (SELECT d FROM h)""")
def cal_open_days_by_rule(spark, sf):
    """Weekdays over the orders' time, less days that orders show as holidays (under four tenths of the mean day)."""
    o = table(spark, sf, "orders").filter("o_orderdate IS NOT NULL").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    mean = o.agg(F.avg("n").alias("mean"))
    holidays = o.join(F.broadcast(mean), F.col("n") < 0.4 * F.col("mean")).filter(F.weekday("d") < 5)
    days = C.open_days(o.agg(F.min("d").alias("first"), F.max("d").alias("last")), holidays)
    return days.join(o, "d", "left").select("d", F.coalesce("n", F.lit(0)).cast("long").alias("orders"))


# --- prices

_PRE = f"""WITH {LINE_BARS_SQL}, pre AS (SELECT *, CASE WHEN (code + day(d)) % 9 = 0 THEN NULL WHEN (code + day(d)) % 4 = 0 THEN round(prev * 0.8, 4) WHEN (code + day(d)) % 31 = 1 THEN prev * 9 ELSE prev END AS pre_close FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY d) AS prev FROM bars)),
kinds AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY d) = 1 THEN 'first_day' WHEN prev IS NULL OR pre_close IS NULL OR close IS NULL THEN 'missing_input' WHEN abs(pre_close - prev) <= 0.005 THEN 'no_event' WHEN prev / nullif(pre_close, 0) IS NULL OR prev / nullif(pre_close, 0) NOT BETWEEN 0.2 AND 5 THEN 'out_of_bounds' ELSE 'adjusted' END AS ratio_kind FROM pre),
ratios AS (SELECT *, CASE WHEN ratio_kind IN ('first_day', 'no_event') THEN 1.0 WHEN ratio_kind = 'adjusted' THEN prev / pre_close END AS ratio FROM kinds),
patched AS (SELECT *, CASE WHEN ratio_kind = 'missing_input' OR ratio_kind = 'out_of_bounds' THEN CASE WHEN code % 2 = 0 THEN 1.0 END ELSE ratio END AS ratio2 FROM ratios),
hfq AS (SELECT *, CASE WHEN max(CASE WHEN ratio2 IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN exp(sum(ln(coalesce(ratio2, 1.0))) OVER w) END AS hfq FROM patched WINDOW w AS (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING)),
qfq AS (SELECT *, hfq / nullif(last_value(hfq) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS qfq FROM hfq)"""


def _ratios(spark, sf):
    b = line_bars(spark, sf).withColumn("prev", F.lag("close").over(P.by_day()))
    k = F.col("code") + F.dayofmonth("d")
    pre = F.when(k % 9 == 0, F.lit(None).cast("double")).when(k % 4 == 0, F.round(F.col("prev") * 0.8, 4)).when(k % 31 == 1, F.col("prev") * 9).otherwise(F.col("prev"))
    return P.adjustment_ratio(b.withColumn("pre_close", pre).drop("prev"))


def _factors(spark, sf):
    gap = F.col("ratio_kind").isin("missing_input", "out_of_bounds")
    r = _ratios(spark, sf).withColumn("ratio", F.when(gap, F.when(F.col("code") % 2 == 0, 1.0)).otherwise(F.col("ratio")))
    return P.forward_factor(P.backward_factor(r))


@query(f"{_PRE} SELECT code, d, ratio_kind, round(ratio, 6) AS ratio FROM ratios")
def price_adjustment_ratio(spark, sf):
    return _ratios(spark, sf).select("code", "d", "ratio_kind", F.round("ratio", 6).alias("ratio"))


@query(f"{_PRE} SELECT code, d, CASE WHEN hfq < 1e9 THEN round(ln(hfq) + 3e-6, 3) END AS log_hfq FROM hfq")
def price_backward_factor(spark, sf):
    return _factors(spark, sf).select("code", "d", F.when(F.col("hfq") < 1e9, off(F.ln("hfq"), 3)).alias("log_hfq"))


@query(f"{_PRE} SELECT code, d, round(ln(qfq) + 3e-6, 3) AS log_qfq FROM qfq WHERE hfq IS NOT NULL AND qfq > 1e-9")
def price_forward_factor(spark, sf):
    return _factors(spark, sf).filter("hfq IS NOT NULL AND qfq > 1e-9").select("code", "d", off(F.ln("qfq"), 3).alias("log_qfq"))


@query(f"{_PRE} SELECT code, count(*) AS n, round(max(abs(close * qfq - close)) FILTER (WHERE d = last_d), 6) AS anchor_gap, count(*) FILTER (WHERE qfq IS NULL) AS null_factors, round(sum(vol * 100), 2) AS units FROM (SELECT *, max(d) OVER (PARTITION BY code) AS last_d FROM qfq) GROUP BY code")
def price_rebased_checks(spark, sf):
    f = _factors(spark, sf)
    r = P.rebased_bars(f).join(f.select("code", "d", F.col("close").alias("raw"), "qfq"), ["code", "d"])
    return r.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.when(F.col("d") == F.col("anchor"), F.abs(F.col("close") - F.col("raw")))), 6).alias("anchor_gap"), F.count(F.when(F.col("qfq").isNull(), 1)).alias("null_factors"), F.round(F.sum("vol"), 2).alias("units"))


@query(f"""{_PRE}, res AS (SELECT code, (close / nullif(lag(close) OVER w, 0) - 1) * 100 - (hfq * close / nullif(lag(hfq * close) OVER w, 0) - 1) * 100 AS r FROM hfq WINDOW w AS (PARTITION BY code ORDER BY d))
SELECT code, round(median(abs(r)), 5) AS med, round(quantile_cont(abs(r), 0.9), 5) AS p90, count(r) AS n FROM res GROUP BY code""")
def price_identity_check(spark, sf):
    w = W.partitionBy("code").orderBy("d")
    adj = F.col("hfq") * F.col("close")
    ret = lambda x: (x / F.nullif(F.lag(x).over(w), F.lit(0.0)) - 1) * 100
    r = _factors(spark, sf).select("code", (ret(F.col("close")) - ret(adj)).alias("r"))
    return r.groupBy("code").agg(F.round(F.median(F.abs("r")), 5).alias("med"), F.round(F.percentile(F.abs("r"), 0.9), 5).alias("p90"), F.count("r").alias("n"))


@query(f"""WITH {LINE_BARS_SQL}, x AS (SELECT *, amount / nullif(vol, 0) / 100 AS a0, amount / nullif(vol, 0) AS b0 FROM bars), y AS (SELECT *, CASE WHEN a0 BETWEEN close * 0.5 AND close * 1.5 AND a0 BETWEEN low * 0.95 AND high * 1.05 THEN a0 END AS a, CASE WHEN b0 BETWEEN close * 0.5 AND close * 1.5 AND b0 BETWEEN low * 0.95 AND high * 1.05 THEN b0 END AS b FROM x)
SELECT code, d, vwap_kind, round(vwap0, 3) AS vwap FROM (SELECT code, d, CASE WHEN a IS NOT NULL AND (b IS NULL OR abs(a - close) <= abs(b - close)) THEN 'lots' WHEN b IS NOT NULL THEN 'units' ELSE 'close' END AS vwap_kind, CASE WHEN a IS NOT NULL AND (b IS NULL OR abs(a - close) <= abs(b - close)) THEN a WHEN b IS NOT NULL THEN b ELSE close END + 3e-6 AS vwap0 FROM y)""")
def price_guarded_vwap(spark, sf):
    return P.guarded_vwap(line_bars(spark, sf)).select("code", "d", "vwap_kind", off("vwap", 3).alias("vwap"))


@query(f"""WITH {LINE_BARS_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY d) AS p, CASE WHEN code % 10 < 6 THEN 0.1 WHEN code % 10 < 8 THEN 0.2 WHEN code % 10 = 9 THEN NULL ELSE 0.3 END AS b FROM bars)
SELECT code, d, CASE WHEN p IS NOT NULL AND b IS NOT NULL THEN close >= round(p * (1 + b), 2) - 0.005 END AS limit_up, CASE WHEN p IS NOT NULL AND b IS NOT NULL THEN close <= round(p * (1 - b), 2) + 0.005 END AS limit_down, vol <= 0 AS suspended FROM p""")
def price_limit_flags(spark, sf):
    k = F.col("code") % 10
    band = F.when(k < 6, 0.1).when(k < 8, 0.2).when(k == 8, 0.3)
    return P.limit_flags(line_bars(spark, sf), band).select("code", "d", "limit_up", "limit_down", "suspended")


@query("""SELECT l_suppkey AS code, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) , 2) AS buy, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS sell, round(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 0) - coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0), 2) AS delta,
count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) AS unknown FROM lineitem GROUP BY 1""")
def price_tick_delta(spark, sf):
    v = lambda s: F.sum(F.when(F.col("l_returnflag") == s, F.col("l_extendedprice")))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.round(v("A"), 2).alias("buy"), F.round(v("R"), 2).alias("sell"), F.round(z(v("A")) - z(v("R")), 2).alias("delta"), F.count(F.when(~F.col("l_returnflag").isin("A", "R"), 1)).alias("unknown"))


@query(None)
def price_chip_distribution(spark, sf):
    b = event_bars(spark, sf).withColumn("turnover", F.least(F.col("vol") / 10.0, F.lit(1.0)))
    return P.chip_distribution(b)


# --- technical states


@query(f"""WITH {LINE_BARS_SQL}, ends AS (SELECT isoyear(d) * 100 + week(d) AS p, max(d) AS pe FROM bars GROUP BY 1) SELECT code, pe AS d, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, sum(vol) AS vol
FROM bars JOIN ends ON p = isoyear(d) * 100 + week(d) GROUP BY 1, 2""")
def tech_resample_week(spark, sf):
    b = line_bars(spark, sf)
    return T.resample(b, C.trading_days(b), "week").select("code", "d", "open", "high", "low", "close", "vol")


@query(f"""WITH {LINE_BARS_SQL}, ends AS (SELECT year(d) * 100 + month(d) AS p, max(d) AS pe FROM bars GROUP BY 1) SELECT code, pe AS d, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, sum(vol) AS vol
FROM bars JOIN ends ON p = year(d) * 100 + month(d) GROUP BY 1, 2""")
def tech_resample_month(spark, sf):
    b = line_bars(spark, sf)
    return T.resample(b, C.trading_days(b), "month").select("code", "d", "open", "high", "low", "close", "vol")


@query(f"WITH {LINE_BARS_SQL} SELECT code, d, CASE WHEN count(close) OVER w = 20 THEN round(avg(close) OVER w + 3e-7, 4) END AS sma FROM bars WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def tech_sma(spark, sf):
    return line_bars(spark, sf).select("code", "d", off(X.full_mean("close", ["code"], ["d"], 20), 4).alias("sma"))


_FEAT = f"""WITH {LINE_BARS_SQL}, m AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS ma, abs(close - lag(close) OVER o) AS mv, lag(close, 20) OVER o AS back, max(high) OVER w AS hi, min(low) OVER w AS lo, count(close) OVER w AS n,
 CASE WHEN count(vol) OVER p = 20 THEN vol / nullif(avg(vol) OVER p, 0) END AS vol_ratio FROM bars WINDOW o AS (PARTITION BY code ORDER BY d), w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY code ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
feat AS (SELECT code, d, close, close / nullif(ma, 0) - 1 AS ma_dist, ma / nullif(lag(ma, 5) OVER o, 0) - 1 AS ma_slope, close / nullif(back, 0) - 1 AS mom, CASE WHEN n = 20 THEN (close - lo) / nullif(hi - lo, 0) END AS range_pct, vol_ratio,
 CASE WHEN count(mv) OVER w = 20 THEN abs(close - back) / nullif(sum(mv) OVER w, 0) END AS er FROM m WINDOW o AS (PARTITION BY code ORDER BY d), w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(f"{_FEAT} SELECT code, d, round(ma_dist + 3e-8, 5) + 0.0 AS ma_dist, round(ma_slope + 3e-8, 5) + 0.0 AS ma_slope, round(mom + 3e-8, 5) + 0.0 AS mom, round(range_pct + 3e-8, 5) + 0.0 AS range_pct, round(vol_ratio + 3e-8, 5) + 0.0 AS vol_ratio, round(er + 3e-8, 5) + 0.0 AS er FROM feat")
def tech_features(spark, sf):
    return T.features(line_bars(spark, sf)).select("code", "d", *[off(c, 5).alias(c) for c in ("ma_dist", "ma_slope", "mom", "range_pct", "vol_ratio", "er")])


_SIG = "(1 / (1 + exp(-greatest(least({}, 50.0), -50.0))))"
_LABEL = (
    _FEAT
    + f""", g AS (SELECT *, pow({_SIG.format("(range_pct - 0.33) * -10")}, 1.0) AS p_low, pow({_SIG.format("(range_pct - 0.33) * 10")} * {_SIG.format("(range_pct - 0.67) * -10")}, 0.5) AS p_mid, pow({_SIG.format("(range_pct - 0.67) * 10")}, 1.0) AS p_high,
 pow({_SIG.format("(ma_slope + 0.005) * -100")} * {_SIG.format("mom * -10")}, 0.5) AS t_down, pow({_SIG.format("(abs(ma_slope) - 0.005) * -100")}, 1.0) AS t_flat, pow({_SIG.format("(ma_slope - 0.005) * 100")} * {_SIG.format("mom * 10")}, 0.5) AS t_up
 FROM feat WHERE range_pct IS NOT NULL AND ma_slope IS NOT NULL AND mom IS NOT NULL),
lab AS (SELECT code, d, CASE greatest(p_low, p_mid, p_high) WHEN p_low THEN 'low' WHEN p_mid THEN 'mid' ELSE 'high' END AS position, CASE greatest(t_down, t_flat, t_up) WHEN t_down THEN 'down' WHEN t_flat THEN 'flat' ELSE 'up' END AS trend,
 exp(greatest(p_low, p_mid, p_high) / 0.25) / (exp(p_low / 0.25) + exp(p_mid / 0.25) + exp(p_high / 0.25)) AS pp FROM g),
named AS (SELECT *, CASE WHEN position = 'low' AND trend = 'up' THEN 'turning_up' WHEN position = 'high' AND trend = 'down' THEN 'turning_down' WHEN trend = 'flat' THEN 'base_' || position ELSE trend || '_' || position END AS label FROM lab)"""
)


@query(f"{_LABEL} SELECT code, d, position, trend, round(pp, 5) AS position_p, label FROM named")
def tech_axis_labels(spark, sf):
    return T.labelled(T.features(line_bars(spark, sf))).select("code", "d", "position", "trend", F.round("position_p", 5).alias("position_p"), "label")


@query(f"""{_LABEL}, l AS (SELECT code, d, list(trend) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seen FROM named)
SELECT code, d, CASE WHEN len(seen) > 0 THEN list_reverse_sort(list_transform(list_distinct(seen), lambda v: {{'n': len(list_filter(seen, lambda x: x = v)), 'f': -list_position(seen, v), 'v': v}}))[1].v END AS context FROM l""")
def tech_majority_context(spark, sf):
    return T.labelled(T.features(line_bars(spark, sf))).select("code", "d", T.majority_before("trend", 10).alias("context"))


@query(f"""WITH {LINE_BARS_SQL}, x AS (SELECT *, CASE WHEN count(close) OVER p = 60 THEN max(high) OVER p END AS top, CASE WHEN count(close) OVER p = 60 THEN min(low) OVER p END AS bot, vol / nullif(avg(vol) OVER v, 0) AS vr FROM bars
 WINDOW p AS (PARTITION BY code ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY code ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, coalesce(close <= bot + (top - bot) * 0.67, false) AS quiet FROM x), r AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM q),
s AS (SELECT *, CASE WHEN quiet THEN sum(quiet::INT) OVER (PARTITION BY code, run ORDER BY d ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM r)
SELECT code, d FROM (SELECT *, lag(streak) OVER (PARTITION BY code ORDER BY d) AS ps FROM s) WHERE close > top AND ps >= 2 AND vr >= 1.2""")
def tech_breakout(spark, sf):
    return T.breakout(line_bars(spark, sf), base=2).filter("breakout").select("code", "d")


@query(f"""WITH {EVENT_BARS_SQL}, c AS (SELECT *, abs(close - open) / nullif(high - low, 0) AS b, (high - greatest(open, close)) / nullif(high - low, 0) AS u, (least(open, close) - low) / nullif(high - low, 0) AS lo FROM bars)
SELECT code, d, CASE WHEN high - low = 0 THEN 'flat' WHEN b <= 0.1 AND lo >= 0.6 THEN 'dragonfly' WHEN b <= 0.1 AND u >= 0.6 THEN 'gravestone' WHEN b <= 0.1 THEN 'doji' WHEN b >= 0.9 AND close > open THEN 'full_up' WHEN b >= 0.9 THEN 'full_down' WHEN lo >= 0.6 AND b <= 0.35 THEN 'hammer' WHEN u >= 0.6 AND b <= 0.35 THEN 'shooting_star' WHEN close > open THEN 'up' ELSE 'down' END AS candle FROM c""")
def tech_candles(spark, sf):
    return T.candle(event_bars(spark, sf)).select("code", "d", "candle")


@query(f"""WITH {EVENT_BARS_SQL}, s AS (SELECT code, d, row_number() OVER (PARTITION BY code ORDER BY d) AS i, CASE WHEN close > open THEN 'u' WHEN close < open THEN 'd' ELSE 'f' END AS l FROM bars)
SELECT a.code, a.d FROM s a WHERE a.l = 'u' AND EXISTS (SELECT 1 FROM s b JOIN s c ON b.code = c.code AND c.i < b.i WHERE b.code = a.code AND b.i < a.i AND b.l = 'd' AND c.l = 'd' AND c.i > a.i - 5)""")
def tech_pattern(spark, sf):
    b = event_bars(spark, sf).withColumn("l", F.when(F.col("close") > F.col("open"), "u").when(F.col("close") < F.col("open"), "d").otherwise("f"))
    return b.withColumn("hit", T.pattern(b, "l", ["d", "d", "u"], 5)).filter("hit").select("code", "d")


@query(f"""WITH {LINE_BARS_SQL}, r AS (SELECT code, d, CASE WHEN lag(close) OVER o > 0 AND close > 0 THEN ln(close / lag(close) OVER o) END AS r FROM bars WINDOW o AS (PARTITION BY code ORDER BY d)), v AS (SELECT code, d, CASE WHEN count(r) OVER w = 10 THEN stddev_samp(r) OVER w END AS rv FROM r WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
l AS (SELECT code, d, rv, list_filter(list(rv) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS l FROM v)
SELECT code, d, CASE WHEN rv IS NOT NULL AND len(l) = 40 THEN CASE WHEN len(list_filter(l, lambda x: x < rv)) / 40.0 < 0.5 THEN 'low_vol' ELSE 'high_vol' END END AS regime FROM l""")
def tech_volatility_regime(spark, sf):
    o = W.partitionBy("code").orderBy("d")
    prev = F.lag("close").over(o)
    b = line_bars(spark, sf).withColumn("r", F.when((prev > 0) & (F.col("close") > 0), F.ln(F.col("close") / prev)))
    w = X.over(["code"], ["d"], -9, 0)
    b = b.withColumn("rv", F.when(F.count("r").over(w) == 10, F.stddev_samp("r").over(w)))
    p = X.strict_percentile("rv", ["code"], ["d"], 40)
    return b.select("code", "d", F.when(p < 0.5, "low_vol").when(p >= 0.5, "high_vol").alias("regime"))


@query(f"""WITH {EVENT_BARS_SQL}, a AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY d) AS p FROM bars), x AS (SELECT *, (least(open, close) - low) / nullif(low, 0) * 100 AS x2, (close - p) / nullif(p, 0) * 100 AS x3, (open - p) / nullif(p, 0) * 100 AS x4, (close - open) / nullif(open, 0) * 100 AS x5, (high - greatest(open, close)) / nullif(greatest(open, close), 0) * 100 AS x7 FROM a),
y AS (SELECT *, CASE WHEN p IS NOT NULL THEN 1.2 * greatest(x7 + x2, x3, x5 + x2, x5 + x7, x2, x7, x4) END AS act FROM x)
SELECT code, d, coalesce(act > 60 AND lag(act) OVER (PARTITION BY code ORDER BY d) <= 60 AND x3 BETWEEN -20 AND 1000, false) AS entry, coalesce(act < 30, false) AS exit FROM y""")
def formula_activity_breakout(spark, sf):
    return T.activity_breakout(event_bars(spark, sf), 60.0, 30.0).select("code", "d", "entry", "exit")


@query(None)
def formula_panel(spark, sf):
    return T.formula_panel(line_bars(spark, sf))


@query(f"""WITH {LINE_BARS_SQL}, i AS (SELECT code, d, close, row_number() OVER (PARTITION BY code ORDER BY d) AS i FROM bars)
SELECT code, d, CASE WHEN count(close) OVER w = 20 THEN round(regr_slope(close, i) OVER w + 3e-6, 3) END AS slope FROM i WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def tech_regression_slope(spark, sf):
    return line_bars(spark, sf).select("code", "d", off(T.slope(F.col("close"), 20)[0], 3).alias("slope"))


# --- flow

_NET = f"""WITH {LINE_BARS_SQL}, f AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, sum(CASE l_returnflag WHEN 'A' THEN l_extendedprice WHEN 'R' THEN -l_extendedprice ELSE 0 END) AS net FROM lineitem GROUP BY 1, 2),
flow AS (SELECT b.code, b.d, b.close, b.amount, f.net, (b.close / nullif(lag(b.close) OVER (PARTITION BY b.code ORDER BY b.d), 0) - 1) * 100 AS pct, b.code % 7 AS sector FROM bars b JOIN f ON f.code = b.code AND f.d = b.d)"""


def _flow(spark, sf):
    v = F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(0.0)
    f = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d")).agg(F.sum(v).alias("net"))
    b = line_bars(spark, sf).join(f, ["code", "d"])
    pct = (F.col("close") / F.nullif(F.lag("close").over(W.partitionBy("code").orderBy("d")), F.lit(0.0)) - 1) * 100
    return b.select("code", "d", "close", "amount", "net", pct.alias("pct"), (F.col("code") % 7).alias("sector"))


@query(f"""{_NET}, i AS (SELECT *, CASE WHEN net > 0 THEN 1 WHEN net < 0 THEN -1 WHEN net = 0 THEN 0 END AS s FROM flow), j AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) - row_number() OVER (PARTITION BY code, s ORDER BY d) AS isl FROM i),
k AS (SELECT *, s * row_number() OVER (PARTITION BY code, s, isl ORDER BY d) AS streak, (exp(sum(CASE WHEN pct > -100 THEN ln(1 + pct / 100) END) OVER (PARTITION BY code, s, isl ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1) * 100 AS px,
 CASE WHEN count(net) OVER p = 40 AND stddev_samp(net) OVER p > 0 THEN (net - avg(net) OVER p) / stddev_samp(net) OVER p END AS z, sum(net) OVER c AS cum_net, count(net) OVER c AS cum_cnt FROM j WINDOW p AS (PARTITION BY code ORDER BY d ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT code, d, streak, round(z + 3e-6, 3) + 0.0 AS z, round(cum_net, 2) AS cum_net, cum_cnt, CASE WHEN net IS NULL THEN NULL WHEN z >= 2.5 AND net > 0 THEN 'surge_in' WHEN z <= -2.5 AND net < 0 THEN 'surge_out' WHEN streak >= 3 AND abs(px) < 3 THEN 'accum_in_silent' WHEN streak >= 3 AND px >= 3 THEN 'accum_in_driving'
 WHEN streak <= -3 AND abs(px) < 3 THEN 'accum_out_silent' WHEN streak <= -3 AND px <= -3 THEN 'accum_out_driving' ELSE 'neutral' END AS regime FROM k""")
def flow_annotate(spark, sf):
    return L.annotate(_flow(spark, sf), ["code"], prior=40, run=3).select("code", "d", "streak", off("z", 3).alias("z"), F.round("cum_net", 2).alias("cum_net"), "cum_cnt", "regime")


@query(f"""{_NET}, q AS (SELECT code, d, coalesce(abs(pct) < 20 AND net > 0, false) AS f FROM flow), r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT code, d, CASE WHEN f THEN sum(f::INT) OVER (PARTITION BY code, run ORDER BY d ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS quiet_in FROM r""")
def flow_quiet_days(spark, sf):
    return L.quiet_days(_flow(spark, sf), ["code"], 20.0).select("code", "d", "quiet_in")


@query(f"""{_NET}, s AS (SELECT sector, d, count(*) AS members, count(*) FILTER (WHERE pct > 0) AS adv, count(*) FILTER (WHERE pct < 0) AS dec, round(sum(net), 2) AS net, sum(amount) AS amount FROM flow GROUP BY 1, 2)
SELECT sector, d, members, adv, dec, net, rank() OVER (PARTITION BY d ORDER BY net DESC NULLS LAST) AS net_rank, round(sum(net) OVER (PARTITION BY sector ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2) AS cum_net, round(amount / nullif(sum(amount) OVER (PARTITION BY d), 0), 6) AS share, round(adv / nullif(adv + dec, 0), 6) AS breadth FROM s""")
def flow_sector_panel(spark, sf):
    p = L.sector_panel(_flow(spark, sf), "sector")
    return p.select("sector", "d", "members", "adv", "dec", F.round("net", 2).alias("net"), "net_rank", F.round("cum_net", 2).alias("cum_net"), F.round("share", 6).alias("share"), F.round("breadth", 6).alias("breadth"))


@query(f"""{_NET}, day AS (SELECT d, count(*) AS n, count(*) FILTER (WHERE pct > 0) AS adv, count(*) FILTER (WHERE pct < 0) AS dec, sum(amount) AS amount, count(DISTINCT sector) AS sectors FROM flow GROUP BY d),
best AS (SELECT d, '[' || string_agg(code::VARCHAR, ',' ORDER BY rn) || ']' AS strongest FROM (SELECT d, code, row_number() OVER (PARTITION BY d ORDER BY pct DESC NULLS LAST, code) AS rn FROM flow WHERE pct IS NOT NULL) WHERE rn <= 3 GROUP BY d)
SELECT day.d, n, adv, dec, sectors, strongest, round(adv / nullif(dec, 0), 6) AS adv_dec, round(amount - lag(amount) OVER (ORDER BY day.d), 2) AS amount_change FROM day LEFT JOIN best ON best.d = day.d""")
def flow_market_panel(spark, sf):
    return L.market_panel(_flow(spark, sf), "sector").select("d", "n", "adv", "dec", "sectors", "strongest", F.round("adv_dec", 6).alias("adv_dec"), F.round("amount_change", 2).alias("amount_change"))


@query(f"""{_NET}, h AS (SELECT *, count(net) OVER w = 10 AND count(*) OVER w = 10 AS known, sum(net) OVER w AS cn, sum(pct) OVER w AS rt, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS rn FROM flow WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT code, d, known, CASE WHEN known THEN round(cn, 2) END AS cum_net, CASE WHEN known THEN round(rt, 4) END AS ret, CASE WHEN NOT known THEN 'unknown' WHEN cn > 0 AND rt <= -3 THEN 'absorbing' WHEN cn > 0 AND abs(rt) < 3 THEN 'building' WHEN cn > 0 THEN 'chasing' WHEN cn < 0 AND rt >= 3 THEN 'distributing' WHEN cn < 0 AND abs(rt) < 3 THEN 'leaking' WHEN cn < 0 THEN 'fleeing' ELSE 'neutral' END AS behaviour FROM h WHERE rn = 1""")
def flow_horizon_behaviour(spark, sf):
    return L.horizon(_flow(spark, sf), ["code"], 10).select("code", "d", "known", F.round("cum_net", 2).alias("cum_net"), F.round("ret", 4).alias("ret"), "behaviour")


@query(f"""{_NET}, s AS (SELECT sector, d, sum(net) AS net FROM flow GROUP BY 1, 2), days AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS back FROM (SELECT DISTINCT d FROM s)), w AS (SELECT s.sector, s.d, s.net, back FROM s JOIN days USING (d) WHERE back <= 5), t AS (SELECT sector, sum(net) AS total FROM w GROUP BY 1 ORDER BY total DESC NULLS LAST, sector LIMIT 4)
SELECT w.sector, w.d, round(net, 2) AS net, round(sum(net) OVER (PARTITION BY w.sector ORDER BY w.d ROWS UNBOUNDED PRECEDING), 2) AS cum FROM w JOIN t ON t.sector = w.sector""")
def flow_heatmap(spark, sf):
    s = _flow(spark, sf).groupBy("sector", "d").agg(F.sum("net").alias("net"))
    days = s.select("d").distinct().orderBy(F.desc("d")).limit(5)
    w = s.join(F.broadcast(days), "d")
    top = w.groupBy("sector").agg(F.sum("net").alias("total")).orderBy(F.desc_nulls_last("total"), "sector").limit(4)
    return w.join(F.broadcast(top.select("sector")), "sector").select("sector", "d", F.round("net", 2).alias("net"), F.round(F.sum("net").over(X.over(["sector"], ["d"], None, 0)), 2).alias("cum"))


@query(f"""{_NET}, s AS (SELECT sector, d, sum(net) AS net FROM flow GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY net DESC, sector) AS rk FROM s), days AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS back FROM (SELECT DISTINCT d FROM s))
SELECT a.sector, a.rk AS rank_now, b.rk AS rank_then, b.rk - a.rk AS gain FROM r a JOIN days x ON x.d = a.d AND x.back = 1 LEFT JOIN (SELECT r.sector, r.rk FROM r JOIN days USING (d) WHERE back = 6) b ON b.sector = a.sector""")
def flow_rotation(spark, sf):
    s = _flow(spark, sf).groupBy("sector", "d").agg(F.sum("net").alias("net"))
    r = s.withColumn("rk", F.rank().over(W.partitionBy("d").orderBy(F.desc("net"), "sector")).cast("long"))
    two = s.select("d").distinct().orderBy(F.desc("d")).limit(6).agg(F.max("d").alias("now"), F.min("d").alias("then"))
    x = r.join(F.broadcast(two), (F.col("d") == F.col("now")) | (F.col("d") == F.col("then")))
    now, then = x.filter("d = now").select("sector", F.col("rk").alias("rank_now")), x.filter("d = then").select("sector", F.col("rk").alias("rank_then"))
    return now.join(then, "sector", "left").withColumn("gain", F.col("rank_then") - F.col("rank_now"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_quantity, l_linestatus, l_returnflag ORDER BY l_orderkey, l_linenumber) AS event_seq FROM lineitem)
SELECT l_suppkey, l_partkey, l_quantity, event_seq, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS sides, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS reasons, count(*) AS board_count, min(l_discount) = max(l_discount) AS consistent FROM e GROUP BY 1, 2, 3, 4""")
def flow_seat_fold(spark, sf):
    f = L.seat_fold(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey", "l_quantity"], ["l_orderkey", "l_linenumber"], "l_discount", "l_linestatus", "l_returnflag")
    return f.select("l_suppkey", "l_partkey", "l_quantity", "event_seq", "sides", "reasons", "board_count", "consistent")
