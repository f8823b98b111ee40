"""Queries of formulas and further domain operators, each beside its SQL (None: sequential state, tested apart)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import domain as D
from tidemark.operators import formulas as M
from tidemark.plans.market import off
from tidemark.sources.bars import EVENT_BARS_SQL, LINE_BARS_SQL, event_amounts, event_bars, line_bars
from tidemark.session import saved, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_MEAN = lambda n, x="close": f"CASE WHEN count({x}) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg({x}) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_SUM = lambda x, n: f"sum(({x})::INT) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_CROSS = lambda a, b: f"coalesce({a} > {b} AND lag({a}) OVER o <= lag({b}) OVER o, false)"
_SINCE = lambda x: f"coalesce(i - max(CASE WHEN {x} THEN i END) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING), 1000000)"
_ORDER = "WINDOW o AS (PARTITION BY code ORDER BY d)"
_TURNS = f"""WITH {LINE_BARS_SQL}, n AS (SELECT *, row_number() OVER o AS i, {", ".join(f"{_MEAN(k)} AS m{k}" for k in (3, 7, 13, 27))}, lag(close) OVER o AS pc, lag(high) OVER o AS ph, lag(low) OVER o AS pl FROM bars {_ORDER}),
l AS (SELECT *, CASE WHEN m3 IS NOT NULL THEN (m3 + coalesce(m7, 0) + coalesce(m13, 0) + coalesce(m27, 0)) / (1 + (m7 IS NOT NULL)::INT + (m13 IS NOT NULL)::INT + (m27 IS NOT NULL)::INT) WHEN i = 1 THEN close ELSE pc * 2 / 3 + close / 3 END AS line, close - open AS body, CASE WHEN coalesce(pc, close) <> 0 THEN close / coalesce(pc, close) ELSE 1 END AS step FROM n),
x0 AS (SELECT code, d, i, high, close, line, (high + low + 2 * open + 6 * close) / 10 AS x, body < 0 OR (body > 0 AND close < coalesce(ph, close)) OR (body >= 0 AND high - close >= body AND step < 1.02) OR (body = 0 AND high - close >= close - low AND step < 1.05) AS weak,
 (body > 0 AND step > 0.94) OR (body < 0 AND close > coalesce(pl, low)) OR (body <= 0 AND close - low >= -body AND step > 0.98) OR (body = 0 AND close - low >= high - close AND step > 0.95) AS firm FROM l),
""" + ",\n".join(f"x{k + 1} AS (SELECT * REPLACE (CASE WHEN {_CROSS('x', 'line')} AND weak THEN line * 0.98 WHEN {_CROSS('line', 'x')} AND firm THEN line * 1.02 ELSE x END AS x) FROM x{k} {_ORDER})" for k in range(10)) + f""",
turns AS (SELECT code, d, i, high, close, {_CROSS("x", "line")} AS buy, {_CROSS("line", "x")} AS sell FROM x10 {_ORDER})"""


@query(f"{_TURNS} SELECT code, d, buy AS entry, sell AS exit FROM turns")
def formula_raw_crossing(spark, sf):
    return M.signals(line_bars(spark, sf), "raw_crossing")


@query(f"""{_TURNS}, s AS (SELECT *, {_SINCE("sell")} AS sold, {_SINCE("buy")} AS bought, {_MEAN(20)} AS a20, {_MEAN(60)} AS a60, {_MEAN(90)} AS a90, max(high) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS top FROM turns),
r AS (SELECT *, sum(CASE WHEN sold < bought THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS grp, lag(a60, 20) OVER o AS b60, lag(a90, 20) OVER o AS b90 FROM s {_ORDER}),
q AS (SELECT *, CASE WHEN sold < bought THEN row_number() OVER (PARTITION BY code, grp, sold < bought ORDER BY d) ELSE 0 END AS run FROM r),
w AS (SELECT *, {_SUM("buy AND sold > 0 AND sold <= 3", 90)} AS fast, {_SUM("buy AND sold > 0", 90)} AS total, {_SUM("sold < bought", 45)} AS downs, {_SUM("buy AND sold > 10", 90)} AS slow, max(run) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 44 PRECEDING AND CURRENT ROW) AS longest,
 max(CASE WHEN buy THEN sold ELSE 0 END) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS latest FROM q)
SELECT code, d, coalesce(sold < bought AND sold <= 3 AND fast >= 1 AND fast * 100 >= total * 40 AND longest <= 8 AND downs / 45 <= 0.6 AND latest <= 20 AND slow <= 2 AND a20 > a60 AND a60 > a90 AND close > a90 AND close > 0.97 * a60 AND a60 > b60 AND a90 > b90 AND close / top BETWEEN 0.78 AND 0.995, false) AS entry, sell AS exit FROM w""")
def formula_pullback_confirm(spark, sf):
    return M.signals(line_bars(spark, sf), "pullback_confirm")


@query(f"""WITH {LINE_BARS_SQL}, n AS (SELECT code, d, close, row_number() OVER o AS i, {", ".join(f"{_MEAN(k)} AS m{k}" for k in (5, 90, 145))} FROM bars {_ORDER}),
c AS (SELECT *, {_CROSS("close", "m145")} AS up, {_CROSS("m90", "m145")} OR {_CROSS("m145", "m90")} AS met, coalesce(m5 > lag(m5) OVER o, false) AS rose, coalesce(close > m145, false) AS above, coalesce(close < m145, false) AS below, coalesce(m5 >= m90, false) AS high5 FROM n {_ORDER}),
s AS (SELECT *, {_SINCE("up")} AS since_up, {_SINCE("below")} AS since_below, {_SINCE("high5")} AS since5, {_SUM("rose", 10)} AS roses, {_SUM("above", 45)} AS aboves, {_SUM("met", 45)} AS mets FROM c)
SELECT code, d, coalesce(since5 >= 45 AND m5 < m90 AND roses >= 7 AND since_up <= 10 AND above AND since_below > since_up AND aboves = since_up + 1 AND close <= 1.06 * greatest(m90, m145) AND close <= 1.1 * m145 AND mets = 0, false) AS entry, below AS exit FROM s""")
def formula_average_base(spark, sf):
    return M.signals(line_bars(spark, sf), "average_base")


@query(None)
def formula_volume_base(spark, sf):
    return M.signals(line_bars(spark, sf), "volume_base")


@query(f"""{_TURNS}, late AS (SELECT code, d, {_MEAN(145)} AS m, close FROM bars), e AS (SELECT code, d, 'raw_crossing' AS f FROM turns WHERE buy UNION ALL SELECT code, d, 'raw_exit' FROM turns WHERE sell UNION ALL SELECT code, d, 'exit_of_average' FROM late WHERE close < m)
SELECT x.f AS a, y.f AS b, count(*) AS shared FROM e x JOIN e y ON x.code = y.code AND x.d = y.d AND x.f < y.f GROUP BY 1, 2""")
def formula_overlaps(spark, sf):
    b = line_bars(spark, sf)
    turns = saved(M.signals(b, "raw_crossing").filter("entry OR exit"), "turns")
    exits = turns.select("code", "d", F.col("exit").alias("entry"))
    return M.overlaps({"raw_crossing": turns, "exit_of_average": M.signals(b, "average_base").select("code", "d", F.col("exit").alias("entry")), "raw_exit": exits})


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'code:' || c_custkey ELSE 'name:' || lower(trim(c_name)) END AS holder_key, CASE WHEN c_custkey % 3 = 0 THEN 'institution' WHEN c_custkey % 5 = 1 THEN CASE WHEN c_acctbal > 0 THEN 'institution' ELSE 'person' END WHEN c_mktsegment = 'BUILDING' THEN 'person' ELSE 'institution' END AS kind,
CASE WHEN c_custkey % 3 = 0 THEN 'vendor_code' WHEN c_custkey % 5 = 1 THEN 'vendor_org_flag' ELSE 'holder_type_proxy' END AS grade FROM customer WHERE c_acctbal IS NOT NULL""")
def holder_identity(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal IS NOT NULL")
    k = F.col("c_custkey")
    key, kind, grade = D.identity_key(F.when(k % 3 == 0, k.cast("string")), F.col("c_name"), F.when(k % 5 == 1, F.col("c_acctbal") > 0), F.when(F.col("c_mktsegment") == "BUILDING", "person"))
    return c.select("c_custkey", key.alias("holder_key"), kind.alias("kind"), grade.alias("grade"))


@query(f"""WITH {LINE_BARS_SQL}, r AS (SELECT DISTINCT code, last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) AS e FROM bars), w AS (SELECT code, e, coalesce(lag(e) OVER (PARTITION BY code ORDER BY e), e - 92) AS s FROM r)
SELECT w.code, w.s AS start, w.e AS end, round((SELECT sum(close * vol) / nullif(sum(vol), 0) FROM bars b WHERE b.code = w.code AND b.d > w.s AND b.d <= w.e) + 3e-6, 3) AS vwap, (SELECT arg_max(close, d) FROM bars b WHERE b.code = w.code AND b.d <= w.e) AS close FROM w""")
def holding_period_windows(spark, sf):
    b = line_bars(spark, sf)
    r = b.select("code", F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("d")).distinct()
    return D.period_windows(r, b).select("code", "start", "end", off("vwap", 3).alias("vwap"), "close")


@query("SELECT l_suppkey, year(l_shipdate) AS y, CASE WHEN bool_and(l_quantity > 1.5) THEN round(sum(CASE WHEN l_quantity > 1.5 THEN l_extendedprice END), 2) END AS total FROM lineitem GROUP BY 1, 2")
def flow_sum_if_all_known(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_quantity") > 1.5, F.col("l_extendedprice")))
    return li.groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("y")).agg(F.round(D.sum_if_all("v"), 2).alias("total"))


@query(f"""WITH {EVENT_BARS_SQL}, ch AS (SELECT DISTINCT code - 1 AS old, code AS new, DATE '2024-01-12' AS eff FROM bars WHERE code % 5 = 1), asked AS (SELECT code, d FROM bars WHERE d <= DATE '2024-01-25' UNION SELECT code, d FROM (SELECT code, max(d) + 1 AS d FROM bars GROUP BY code)),
x AS (SELECT a.code, a.d, ch.old, ch.old IS NOT NULL AND a.d < ch.eff AS early, EXISTS (SELECT 1 FROM asked t WHERE t.code = ch.old AND t.d = a.d) AS twin FROM asked a LEFT JOIN ch ON ch.new = a.code),
y AS (SELECT *, CASE WHEN early AND twin THEN NULL WHEN early THEN old ELSE code END AS asof_code FROM x), z AS (SELECT *, EXISTS (SELECT 1 FROM bars b WHERE b.code = asof_code AND b.d = y.d) AS bar FROM y)
SELECT code, d, asof_code, CASE WHEN early AND twin THEN 'backfill_duplicate' WHEN early AND bar THEN 'backfill_remapped' WHEN early THEN 'unresolved' WHEN bar THEN 'confirmed' WHEN d = (SELECT max(d) FROM bars) + 1 THEN 'pending' ELSE 'unresolved' END AS status FROM z""")
def identity_resolution(spark, sf):
    b = event_bars(spark, sf)
    ch = b.filter("code % 5 = 1").select((F.col("code") - 1).alias("old"), F.col("code").alias("new"), F.lit("2024-01-12").cast("date").alias("effective")).distinct()
    asked = b.filter("d <= DATE'2024-01-25'").select("code", "d").union(b.groupBy("code").agg(F.date_add(F.max("d"), 1).alias("d"))).distinct()
    return D.resolve_identity(asked, ch, b)


@query(f"""WITH {EVENT_BARS_SQL}, r AS (SELECT code, d, percent_rank() OVER (PARTITION BY d ORDER BY amount) AS a, percent_rank() OVER (PARTITION BY d ORDER BY vol) AS v FROM bars)
SELECT code, d, CASE WHEN a < 0.2 THEN 'micro' WHEN a < 0.5 THEN 'small' WHEN a < 0.8 THEN 'mid' ELSE 'large' END AS cap_band, CASE WHEN v < 0.33 THEN 'low' WHEN v < 0.67 THEN 'mid' ELSE 'high' END AS turnover_band FROM r""")
def segments_by_day(spark, sf):
    return D.segments(event_amounts(spark, sf), "amount", "vol").select("code", "d", "cap_band", "turnover_band")


@query("SELECT CASE WHEN c_nationkey < 3 THEN 'nation' WHEN c_acctbal < 0 THEN 'balance' ELSE 'kept' END AS reason, count(*) AS rows FROM customer GROUP BY 1")
def universe_evidence(spark, sf):
    return D.universe_evidence(table(spark, sf, "customer"), {"nation": F.col("c_nationkey") < 3, "balance": F.col("c_acctbal") < 0})


@query("SELECT l_suppkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS l1, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS l2, max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS l3 FROM lineitem GROUP BY 1")
def board_level_pivot(spark, sf):
    return D.level_pivot(table(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", "l_partkey", [1, 2, 3])


@query("""SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY) t(x) WHERE CAST(x AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate IS NOT NULL) ORDER BY 1 LIMIT 40""")
def plan_due_days(spark, sf):
    settled = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.to_date("o_orderdate").alias("d"))
    return D.due_days(settled, F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"), 40)


@query("""WITH q AS (SELECT DISTINCT o_custkey AS k, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS quarter FROM orders), s AS (SELECT k, min(quarter) AS lo, max(quarter) AS hi FROM q GROUP BY k),
every AS (SELECT s.k, x.quarter FROM s JOIN (SELECT DISTINCT last_day(CAST(date_trunc('quarter', g) + INTERVAL 2 MONTH AS DATE)) AS quarter FROM generate_series(DATE '1990-01-01', DATE '2005-12-31', INTERVAL 1 MONTH) t(g)) x ON x.quarter BETWEEN lo AND hi)
SELECT k, quarter FROM every WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.k = every.k AND q.quarter = every.quarter)""")
def plan_missing_quarters(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    return D.missing_quarters(o, "k", "day")


@query("SELECT c_custkey, coalesce(c_acctbal > 5000, false) AS rich, coalesce(c_acctbal < 0, false) AS poor, coalesce(abs(c_nationkey - 10) <= 2, false) AS central FROM customer")
def condition_dsl(spark, sf):
    spec = {"rich": {"indicator": "c_acctbal", "op": "above", "threshold": 5000}, "poor": {"indicator": "c_acctbal", "op": "below", "threshold": 0}, "central": {"indicator": "c_nationkey", "op": "flat", "threshold": 10, "band": 2}}
    return table(spark, sf, "customer").select("c_custkey", *[D.condition(s).alias(n) for n, s in spec.items()])


@query("""WITH raw AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT k, max(d) AS f FROM (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 = 0) GROUP BY k), r AS (SELECT k, min(d) AS lo, max(d) AS hi FROM raw GROUP BY k)
SELECT r.k, coalesce(f + 1, lo) AS start, hi AS end FROM r LEFT JOIN f ON f.k = r.k WHERE coalesce(f + 1, lo) <= hi""")
def plan_catch_up(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    return D.catch_up_plan(o.filter("o_orderkey % 3 = 0"), o, "k", "d")


@query("""SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 12))::BIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substr(h, 13, 12))::BIGINT::HUGEINT)::VARCHAR AS snapshot FROM (SELECT sha256(coalesce(n_nationkey::VARCHAR, '~') || '|' || coalesce(n_name, '~')) AS h FROM nation)""")
def snapshot_fingerprint(spark, sf):
    return D.snapshot_hash(table(spark, sf, "nation"), ["n_nationkey"], ["n_name"])


@query("""WITH c AS (SELECT l_suppkey AS key, year(l_shipdate) AS period, count(*) AS raw, count(*) FILTER (WHERE l_returnflag <> 'R' OR l_suppkey % 3 > 0) AS accepted FROM lineitem GROUP BY 1, 2), b AS (SELECT *, max(accepted) OVER (PARTITION BY key ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM c)
SELECT key, period, raw, accepted, baseline, CASE WHEN raw = 0 THEN 'fetch' WHEN accepted < raw THEN 'accept' WHEN baseline IS NOT NULL AND accepted < 0.9 * baseline THEN 'refetch_truncated' ELSE 'ok' END AS action FROM b""")
def population_verdict(spark, sf):
    ok = (F.col("l_returnflag") != "R") | (F.col("l_suppkey") % 3 > 0)
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").cast("long").alias("period")).agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(ok, 1)).alias("accepted"))
    return D.population_verdict(c)


