"""Queries of limit days, relative strength, rally samples and delayed trades, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ladder as R
from tidemark.operators import windows as X
from tidemark.plans.market import off
from tidemark.session import in_tasks, saved, table
from tidemark.sources.bars import LINE_BARS_SQL, line_bars

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"""WITH {LINE_BARS_SQL}, m AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY d) AS p FROM bars), k AS (SELECT *, CASE WHEN close >= p * 1.05 THEN 'U' WHEN high >= p * 1.05 THEN 'Z' WHEN close <= p * 0.95 THEN 'D' END AS kind FROM m),
g AS (SELECT *, sum(CASE WHEN kind = 'U' THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM k), c AS (SELECT *, sum((kind = 'U')::INT) OVER (PARTITION BY code, run ORDER BY d ROWS UNBOUNDED PRECEDING)::BIGINT AS times FROM g), l AS (SELECT code, d, kind, times, 90000 + (code * 997 + day(d) * 131) % 60000 AS first_time FROM c WHERE kind IS NOT NULL AND day(d) % 5 > 0),
y AS (SELECT d, count(*) FILTER (WHERE kind = 'U') AS up, count(*) FILTER (WHERE kind = 'D') AS down, count(*) FILTER (WHERE kind = 'Z') AS broken, count(*) FILTER (WHERE kind = 'U' AND times >= 2) AS nxt, coalesce(max(times) FILTER (WHERE kind = 'U'), 0) AS highest, count(*) FILTER (WHERE kind = 'U' AND lpad(first_time::VARCHAR, 6, '0') <= '093059') AS early FROM l GROUP BY d),
t AS (SELECT d, '{{' || string_agg('"' || times || '":' || n, ',' ORDER BY times) || '}}' AS ladder FROM (SELECT d, times, count(*) AS n FROM l WHERE kind = 'U' GROUP BY 1, 2) GROUP BY d),
z AS (SELECT y.*, nxt / nullif(lag(up) OVER (ORDER BY y.d), 0) AS promotion, broken / nullif(up + broken, 0) AS broken_rate, coalesce(ladder, '{{}}') AS ladder FROM y LEFT JOIN t ON t.d = y.d)
SELECT b.d, up, down, broken, highest, early, round(promotion + 3e-8, 5) AS promotion, round(broken_rate + 3e-8, 5) AS broken_rate, ladder FROM (SELECT DISTINCT d FROM bars) b LEFT JOIN z ON z.d = b.d""")
def flow_limit_days(spark, sf):
    b = line_bars(spark, sf).withColumn("_p", F.lag("close").over(W.partitionBy("code").orderBy("d")))
    up = F.col("_p") * 1.05
    kind = F.when(F.col("close") >= up, "U").when(F.col("high") >= up, "Z").when(F.col("close") <= F.col("_p") * 0.95, "D")
    k = X.run_length(b.withColumn("kind", kind), ["code"], ["d"], F.col("kind") == "U", "times")
    first = 90000 + (F.col("code") * 997 + F.dayofmonth("d") * 131) % 60000
    limits = k.filter("kind IS NOT NULL AND day(d) % 5 > 0").select("code", "d", "kind", "times", first.alias("first_time"))
    return R.limit_days(b, limits).withColumn("promotion", off("promotion", 5)).withColumn("broken_rate", off("broken_rate", 5))


@query(f"""WITH {LINE_BARS_SQL}, s AS (SELECT code % 7 AS sector, code % 7 % 2 AS level, d, avg(close) AS close FROM bars GROUP BY 1, 2, 3), m AS (SELECT d, avg(close) AS close FROM bars GROUP BY d),
b AS (SELECT d, close / lag(close, 20) OVER w - 1 AS b20, close / lag(close, 60) OVER w - 1 AS b60 FROM m WINDOW w AS (ORDER BY d)), x AS (SELECT *, close / lag(close, 20) OVER w - 1 AS s20, close / lag(close, 60) OVER w - 1 AS s60 FROM s WINDOW w AS (PARTITION BY sector ORDER BY d)),
r AS (SELECT sector, level, x.d, s20 - b20 AS r20, s60 - b60 AS r60 FROM x LEFT JOIN b ON b.d = x.d)
SELECT sector, level, d, round(r20 + 3e-7, 4) AS rs_20, CASE WHEN r20 IS NOT NULL THEN rank() OVER (PARTITION BY level, d ORDER BY r20 DESC NULLS LAST) END AS rank_20, round(r60 + 3e-7, 4) AS rs_60, CASE WHEN r60 IS NOT NULL THEN rank() OVER (PARTITION BY level, d ORDER BY r60 DESC NULLS LAST) END AS rank_60 FROM r""")
def flow_relative_strength(spark, sf):
    b = line_bars(spark, sf)
    k = F.col("code") % 7
    s = b.groupBy(k.alias("sector"), (k % 2).alias("level"), "d").agg(F.avg("close").alias("close"))
    d = R.relative_strength(s, ["sector"], b.groupBy("d").agg(F.avg("close").alias("close")), [20, 60], "level").drop("close")
    return d.withColumn("rs_20", off("rs_20", 4)).withColumn("rs_60", off("rs_60", 4))


@query(f"""WITH RECURSIVE {LINE_BARS_SQL}, x AS (SELECT code, d, low, close, row_number() OVER o AS i, min(low) OVER a AS lo, count(*) OVER a AS n, max(high) OVER f AS peak, count(*) OVER f AS m FROM bars WINDOW o AS (PARTITION BY code ORDER BY d), a AS (PARTITION BY code ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), f AS (PARTITION BY code ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
c AS (SELECT code, d, i FROM x WHERE n = 7 AND low = lo AND m = 20 AND low > 0 AND peak / low - 1 < 0.6 AND NOT EXISTS (SELECT 1 FROM x p WHERE p.code = x.code AND p.i % 97 = 5 AND p.code % 2 = 0 AND abs(p.i - x.i) <= 10) AND (SELECT count(*) FROM x h WHERE h.code = x.code AND h.i BETWEEN x.i - 30 AND x.i - 1 AND h.close BETWEEN x.low * 0.85 AND x.low * 1.25) >= 5),
nx AS (SELECT a.code, a.i, min(b.i) AS nx FROM c a LEFT JOIN c b ON b.code = a.code AND b.i >= a.i + 8 GROUP BY 1, 2), k AS (SELECT code, min(i) AS i FROM c GROUP BY code UNION ALL SELECT k.code, nx.nx FROM k JOIN nx ON nx.code = k.code AND nx.i = k.i WHERE nx.nx IS NOT NULL)
SELECT c.code, c.d AS bottom FROM c JOIN k ON k.code = c.code AND k.i = c.i""")
def rally_negatives(spark, sf):
    b = saved(line_bars(spark, sf), "bars")
    i = F.row_number().over(W.partitionBy("code").orderBy("d"))
    hits = in_tasks(b, b.count(), "code").withColumn("i", i).filter("i % 97 = 5 AND code % 2 = 0").select("code", F.col("d").alias("bottom"))
    return R.rally_negatives(b, hits, side=3, ahead=20, gain=0.6, purge=10, base=5, history=30, gap=8)


@query(f"""WITH {LINE_BARS_SQL}, x AS (SELECT *, lead(close, 5) OVER (PARTITION BY code ORDER BY d) AS nxt FROM bars)
SELECT 0 AS step, 'all' AS name, count(*) AS rows FROM x UNION ALL SELECT 1, 'rising', count(*) FROM x WHERE close > open UNION ALL SELECT 2, 'complete', count(*) FROM x WHERE close > open AND nxt IS NOT NULL UNION ALL SELECT 3, 'gain', count(*) FROM x WHERE close > open AND nxt > close * 1.1""")
def rally_funnel(spark, sf):
    b = line_bars(spark, sf).withColumn("nxt", F.lead("close", 5).over(W.partitionBy("code").orderBy("d")))
    return R.funnel(b, [("rising", F.col("close") > F.col("open")), ("complete", F.col("nxt").isNotNull()), ("gain", F.col("nxt") > F.col("close") * 1.1)])


@query(f"""WITH {LINE_BARS_SQL}, v AS (SELECT *, amount / nullif(vol * 100, 0) AS a, amount / nullif(vol, 0) AS b, lag(close) OVER (PARTITION BY code ORDER BY d) AS p, row_number() OVER (PARTITION BY code ORDER BY d) AS i FROM bars),
g AS (SELECT *, CASE WHEN a BETWEEN close * 0.5 AND close * 1.5 AND a BETWEEN low * 0.95 AND high * 1.05 THEN a END AS ga, CASE WHEN b BETWEEN close * 0.5 AND close * 1.5 AND b BETWEEN low * 0.95 AND high * 1.05 THEN b END AS gb FROM v),
x AS (SELECT code, d, i, CASE WHEN ga IS NOT NULL AND (gb IS NULL OR abs(ga - close) <= abs(gb - close)) THEN ga ELSE coalesce(gb, close) END AS px, vol > 0 AND NOT coalesce(close >= round(p * 1.2, 2) - 0.005, false) AS can_buy, vol > 0 AND NOT coalesce(close <= round(p * 0.8, 2) + 0.005, false) AS can_sell FROM g),
s AS (SELECT code, d, i FROM x WHERE i % 5 = 0), f AS (SELECT s.code, s.d, min(b.i) AS bi FROM s LEFT JOIN x b ON b.code = s.code AND b.can_buy AND b.i BETWEEN s.i + 1 AND s.i + 4 GROUP BY 1, 2), e AS (SELECT f.code, f.d, bi, min(c.i) AS si FROM f LEFT JOIN x c ON c.code = f.code AND c.can_sell AND c.i >= bi + 6 GROUP BY 1, 2, 3)
SELECT e.code, e.d, CASE WHEN bi IS NULL THEN 'unfilled' WHEN si IS NULL THEN 'open' ELSE 'closed' END AS status, b.d AS bought, c.d AS sold, round(c.px / b.px - 1 + 3e-7, 4) AS ret FROM e LEFT JOIN x b ON b.code = e.code AND b.i = bi LEFT JOIN x c ON c.code = e.code AND c.i = si""")
def paper_held_trades(spark, sf):
    b = line_bars(spark, sf)
    picks = b.withColumn("i", F.row_number().over(W.partitionBy("code").orderBy("d"))).filter("i % 5 = 0").select("code", "d")
    return R.held_trades(picks, b, F.lit(0.2), 6).withColumn("ret", off("ret", 4))


@query(f"""WITH {LINE_BARS_SQL}, m AS (SELECT d, avg(close) AS close FROM bars GROUP BY d), e AS (SELECT o_orderkey, o_custkey AS holder, CAST(o_orderdate AS DATE) AS opened, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) + 90 END AS closed, o_orderkey % 7 = 0 AS seeded, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice / 100000 - 1 END AS ret FROM orders),
x AS (SELECT e.*, holder % 10 = 0 AS passive, CASE WHEN opened <= z THEN (SELECT arg_max(close, d) FROM m WHERE d <= opened) END AS a, CASE WHEN closed <= z THEN (SELECT arg_max(close, d) FROM m WHERE d <= closed) END AS b FROM e, (SELECT max(d) AS z FROM m))
SELECT o_orderkey, passive, round(ret - (b / a - 1) + 3e-7, 4) AS alpha, closed IS NOT NULL AND NOT seeded AND NOT passive AND ret - (b / a - 1) IS NOT NULL AS rankable FROM x""")
def holding_enriched(spark, sf):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    closed = F.when(k % 4 > 0, F.date_add(day, 90))
    e = table(spark, sf, "orders").select(k, F.col("o_custkey").alias("holder"), day.alias("opened"), closed.alias("closed"), F.when(closed.isNotNull(), "closed").otherwise("holding").alias("status"), (k % 7 == 0).alias("seeded"), F.when(k % 9 > 0, F.col("o_totalprice") / 100000 - 1).alias("ret"))
    bench = line_bars(spark, sf).groupBy("d").agg(F.avg("close").alias("close"))
    passive = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("holder"))
    return R.enriched(e, bench, passive).select("o_orderkey", "passive", off("alpha", 4).alias("alpha"), "rankable")


@query("""WITH n AS (SELECT o_custkey, count(*) AS counted FROM orders GROUP BY 1), h AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 3 > 0 THEN counted WHEN c_custkey % 2 = 0 THEN coalesce(counted, 0) + 1 END AS held FROM customer LEFT JOIN n ON o_custkey = c_custkey)
SELECT h.o_custkey, held, counted FROM h LEFT JOIN n ON n.o_custkey = h.o_custkey WHERE held IS DISTINCT FROM counted""")
def flow_count_updates(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey")
    k = F.col("c_custkey")
    now = table(spark, sf, "customer").join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")), "c_custkey", "left")
    held = now.select(k.alias("o_custkey"), F.when(k % 3 > 0, F.col("n")).when(k % 2 == 0, F.coalesce("n", F.lit(0)) + 1).alias("times"))
    return R.count_updates(held, o, ["o_custkey"], "times")


_SPECIAL_SQL = f"""{LINE_BARS_SQL}, names AS (SELECT d, code, s_name || CASE WHEN code % 4 = 0 THEN ' X' ELSE '' END AS name FROM bars JOIN supplier ON s_suppkey = code WHERE day(d) % 10 = 0), flags AS (SELECT d, code, CASE WHEN code % 9 > 0 OR day(d) % 3 = 0 THEN code % 5 = 0 END AS flag FROM bars WHERE day(d) % 10 <> 0),
p AS (SELECT b.d, count(*) FILTER (WHERE f.flag IS NULL) AS missing, CASE WHEN day(b.d) % 10 = 0 THEN 'names' WHEN count(*) FILTER (WHERE f.flag IS NULL) = 0 THEN 'flags' END AS path FROM bars b LEFT JOIN flags f ON f.d = b.d AND f.code = b.code GROUP BY b.d)"""


def _special(spark, sf):
    b, day = line_bars(spark, sf).select("d", "code"), F.dayofmonth("d") % 10
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), "s_name")
    names = b.filter(day == 0).join(s, "code").select("d", "code", F.concat("s_name", F.when(F.col("code") % 4 == 0, " X").otherwise("")).alias("name"))
    flags = b.filter(day != 0).withColumn("flag", F.when((F.col("code") % 9 > 0) | (F.dayofmonth("d") % 3 == 0), F.col("code") % 5 == 0))
    return b, names, flags


@query(f"WITH {_SPECIAL_SQL} SELECT d, path, missing FROM p")
def land_special_paths(spark, sf):
    return R.special_paths(*_special(spark, sf))


@query(f"WITH {_SPECIAL_SQL} SELECT p.d, code, path FROM p JOIN names n ON n.d = p.d WHERE path = 'names' AND name LIKE '% X' UNION ALL SELECT p.d, code, path FROM p JOIN flags f ON f.d = p.d WHERE path = 'flags' AND flag")
def land_special_members(spark, sf):
    return R.special_members(*_special(spark, sf), prefix=" X$")


@query("""WITH m AS (SELECT o_custkey, count(*) AS trades, count(DISTINCT year(o_orderdate)) AS folds, max(o_totalprice) / 500000 - 0.4 AS ret, CASE WHEN o_custkey % 7 > 0 THEN min(o_totalprice) / 100000 END AS max_drawdown, avg(o_totalprice) / 150000 - 0.9 AS holdout_ret FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN NOT (o_custkey % 11 > 0 AND trades >= 5 AND folds >= 3) THEN 'short_window' WHEN coalesce(holdout_ret > 0 AND max_drawdown <= 0.5 AND trades >= 8 AND ret > 0, false) THEN 'passed' ELSE 'unmet' END AS verdict FROM m""")
def paper_edge_gates(spark, sf):
    p = F.col("o_totalprice")
    m = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trades"), F.count_distinct(F.year("o_orderdate")).alias("folds"), (F.max(p) / 500000 - 0.4).alias("ret"), (F.min(p) / 100000).alias("_m"), (F.avg(p) / 150000 - 0.9).alias("holdout_ret"))
    m = m.withColumn("max_drawdown", F.when(F.col("o_custkey") % 7 > 0, F.col("_m"))).withColumn("claimable", F.col("o_custkey") % 11 > 0)
    return R.edge_gates(m, 5, 3, 8, 0.5).select("o_custkey", "verdict")
