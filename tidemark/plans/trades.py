"""Queries of simulated trades, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import trades as R
from tidemark.plans.market import off
from tidemark.session import in_tasks, saved
from tidemark.sources.bars import LINE_BARS_SQL, line_bars

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"""WITH {LINE_BARS_SQL}, v AS (SELECT *, amount / nullif(vol * 100, 0) AS a, amount / nullif(vol, 0) AS b, lag(close) OVER (PARTITION BY code ORDER BY d) AS p, row_number() OVER (PARTITION BY code ORDER BY d) AS i, count(*) OVER (PARTITION BY code) AS n FROM (SELECT * REPLACE (CASE WHEN (code + day(d)) % 11 = 0 THEN 0 ELSE vol END AS vol) FROM bars)),
g AS (SELECT *, CASE WHEN a BETWEEN close * 0.5 AND close * 1.5 AND a BETWEEN low * 0.95 AND high * 1.05 THEN a END AS ga, CASE WHEN b BETWEEN close * 0.5 AND close * 1.5 AND b BETWEEN low * 0.95 AND high * 1.05 THEN b END AS gb FROM v),
x AS (SELECT code, d, i, n, low, close, CASE WHEN ga IS NOT NULL AND (gb IS NULL OR abs(ga - close) <= abs(gb - close)) THEN ga ELSE coalesce(gb, close) END AS px, CASE WHEN vol <= 0 THEN 'suspended' WHEN close >= round(p * 1.2, 2) - 0.005 THEN 'limit_up' END AS nb, CASE WHEN vol <= 0 THEN 'suspended' WHEN close <= round(p * 0.8, 2) + 0.005 THEN 'limit_down' END AS ns,
 CASE WHEN day(d) = 28 THEN 'month_end' WHEN close > p * 1.15 THEN 'jump' END AS rule FROM g),
s AS (SELECT code, d, i, n FROM x WHERE i % 5 = 0 OR i = n), f AS (SELECT s.code, s.d, s.i, s.n, min(b.i) FILTER (WHERE b.nb IS NULL) AS bi, arg_max(b.nb, b.i) AS why FROM s LEFT JOIN x b ON b.code = s.code AND b.i BETWEEN s.i + 1 AND s.i + 4 GROUP BY 1, 2, 3, 4),
y AS (SELECT f.code, f.d, bi, c.i AS ci, c.close, max(c.close) OVER (PARTITION BY f.code, f.d ORDER BY c.i) AS top, c.low FROM f JOIN x c ON c.code = f.code AND c.i BETWEEN bi AND bi + 8),
tr AS (SELECT code, d, min(ci) FILTER (WHERE ci > bi AND close < top * 0.75) AS ti FROM y GROUP BY 1, 2), ex AS (SELECT f.code, f.d, min(c.i) AS ei, arg_min(c.rule, c.i) AS rule FROM f JOIN x c ON c.code = f.code AND c.i > bi AND c.rule IS NOT NULL GROUP BY 1, 2),
pl AS (SELECT f.*, ei, ti, rule, CASE WHEN bi IS NOT NULL THEN least(ei, ti, bi + 8) END AS pi FROM f LEFT JOIN tr USING (code, d) LEFT JOIN ex USING (code, d)), se AS (SELECT pl.code, pl.d, min(c.i) AS si FROM pl JOIN x c ON c.code = pl.code AND c.i >= pi AND c.ns IS NULL WHERE pi <= pl.n GROUP BY 1, 2),
st AS (SELECT pl.*, si, CASE WHEN i = n THEN 'pending' WHEN bi IS NULL THEN 'unfilled' WHEN pi > n THEN 'open' WHEN si IS NULL THEN 'blocked' ELSE 'closed' END AS status FROM pl LEFT JOIN se USING (code, d)),
lo AS (SELECT st.code, st.d, min(c.low) AS low FROM st JOIN x c ON c.code = st.code AND c.i BETWEEN bi AND CASE status WHEN 'closed' THEN si WHEN 'open' THEN st.n END GROUP BY 1, 2)
SELECT st.code, st.d, status, b.d AS bought, c.d AS sold, CASE WHEN status IN ('closed', 'blocked') THEN CASE WHEN pi = ei THEN st.rule WHEN pi = ti THEN 'trail' ELSE 'hold' END END AS by, CASE status WHEN 'unfilled' THEN why WHEN 'blocked' THEN z.ns END AS reason, bi - st.i - 1 AS buy_delay, CASE WHEN status = 'closed' THEN si - pi END AS sell_delay,
 CASE WHEN status = 'open' THEN pi - st.n END AS left, round(CASE status WHEN 'closed' THEN c.px WHEN 'open' THEN z.px END / b.px - 1 + 3e-7, 4) AS ret, round(CASE WHEN lo.low / b.px IS NOT NULL THEN least(lo.low / b.px - 1, 0) END + 3e-7, 4) AS drop
FROM st LEFT JOIN x b ON b.code = st.code AND b.i = bi LEFT JOIN x c ON c.code = st.code AND c.i = si AND status = 'closed' LEFT JOIN x z ON z.code = st.code AND z.i = st.n LEFT JOIN lo ON lo.code = st.code AND lo.d = st.d""")
def paper_sell_rule_trades(spark, sf):
    """Every fifth bar is a signal; sold on the 28th of a month, after a jump, a quarter below the top, or after eight bars."""
    w = W.partitionBy("code").orderBy("d")
    b = saved(line_bars(spark, sf), "bars")
    b = in_tasks(b, b.count(), "code")
    b = b.withColumn("vol", F.when((F.col("code") + F.dayofmonth("d")) % 11 == 0, 0.0).otherwise(F.col("vol"))).withColumn("p", F.lag("close").over(w))
    last = F.row_number().over(W.partitionBy("code").orderBy(F.desc("d"))) == 1
    picks = b.withColumn("k", (F.row_number().over(w) % 5 == 0) | last).filter("k").select("code", "d")
    exits = [("month_end", F.dayofmonth("d") == 28), ("jump", F.col("close") > F.col("p") * 1.15)]
    return R.sell_rule_trades(picks, b, F.lit(0.2), 8, exits, 0.25).withColumns({"ret": off("ret", 4), "drop": off("drop", 4)})
