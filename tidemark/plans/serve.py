"""Read routes as DataFrame functions: lists, charts, boards and drill-downs over the operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import flow as L
from tidemark.operators import relational as R
from tidemark.operators import technical as T
from tidemark.operators import windows as X
from tidemark.plans.market import _LABEL, _NET, _flow, off
from tidemark.sources.bars import LINE_BARS_SQL, line_bars
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE contains(s_name, '1') ORDER BY s_suppkey LIMIT 30 OFFSET 5")
def serve_list(spark, sf):
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return R.search_page(j, "1", ["s_name"], [F.asc("s_suppkey")], 5, 30).select("s_suppkey", "s_name", "n_name", "r_name")


@query(f"WITH {LINE_BARS_SQL}, m AS (SELECT code, d, close, vol, CASE WHEN count(close) OVER w = 5 THEN round(avg(close) OVER w + 3e-7, 4) END AS ma5 FROM bars WHERE code = 3 WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT * FROM m ORDER BY d DESC LIMIT 60")
def serve_chart(spark, sf):
    b = line_bars(spark, sf).filter("code = 3")
    return b.select("code", "d", "close", "vol", off(X.full_mean("close", ["code"], ["d"], 5), 4).alias("ma5")).orderBy(F.desc("d")).limit(60)


@query(f"""{_NET}, last AS (SELECT code, max(d) AS d FROM flow GROUP BY code), fx AS (SELECT *, sum(net) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS net5, max(close) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS top60 FROM flow)
SELECT fx.code, fx.d, fx.close, round(fx.pct + 3e-7, 4) + 0.0 AS pct, round(fx.net5, 2) AS net5, fx.top60, s_name, n_name FROM fx JOIN last ON last.code = fx.code AND last.d = fx.d LEFT JOIN supplier ON s_suppkey = fx.code LEFT JOIN nation ON n_nationkey = s_nationkey""")
def serve_dossier(spark, sf):
    f = _flow(spark, sf).withColumn("net5", F.sum("net").over(X.over(["code"], ["d"], -4, 0))).withColumn("top60", F.max("close").over(X.over(["code"], ["d"], -59, 0)))
    last = R.latest_per_key(f, ["code"], [F.desc("d")])
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = last.join(s, F.col("code") == s["s_suppkey"], "left").join(n, s["s_nationkey"] == n["n_nationkey"], "left")
    return j.select("code", "d", "close", off("pct", 4).alias("pct"), F.round("net5", 2).alias("net5"), "top60", "s_name", "n_name")


@query(f"""{_NET}, s AS (SELECT sector, d, sum(net) AS net, count(*) AS members FROM flow GROUP BY 1, 2), c AS (SELECT *, sum(net) OVER (PARTITION BY sector ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS cum10, row_number() OVER (PARTITION BY sector ORDER BY d DESC) AS rn FROM s)
SELECT sector, d, members, round(net, 2) AS net, round(cum10, 2) AS cum10, rank() OVER (ORDER BY cum10 DESC NULLS LAST) AS place FROM c WHERE rn = 1""")
def serve_flow_board(spark, sf):
    s = _flow(spark, sf).groupBy("sector", "d").agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("members"))
    c = R.latest_per_key(s.withColumn("cum10", F.sum("net").over(X.over(["sector"], ["d"], -9, 0))), ["sector"], [F.desc("d")])
    place = F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("cum10")))  # a row for each sector
    return c.select("sector", "d", "members", F.round("net", 2).alias("net"), F.round("cum10", 2).alias("cum10"), place.cast("long").alias("place"))


@query(f"""{_LABEL}, last AS (SELECT code, arg_max(label, d) AS label, max(d) AS d FROM named GROUP BY code) SELECT label, count(*) AS codes, min(code) AS first_code, max(d) AS latest FROM last GROUP BY label""")
def serve_screener_options(spark, sf):
    n = T.labelled(T.features(line_bars(spark, sf))).groupBy("code").agg(F.max_by("label", "d").alias("label"), F.max("d").alias("d"))
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("codes"), F.min("code").alias("first_code"), F.max("d").alias("latest"))


@query(f"""{_NET}, j AS (SELECT *, CASE WHEN net > 0 THEN 1 WHEN net < 0 THEN -1 WHEN net = 0 THEN 0 END AS s FROM flow), i AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) - row_number() OVER (PARTITION BY code, s ORDER BY d) AS isl FROM j), k AS (SELECT *, s * row_number() OVER (PARTITION BY code, s, isl ORDER BY d) AS streak, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS rn FROM i)
SELECT sector, code, d, streak, round(net, 2) AS net FROM k WHERE rn = 1 AND sector = 2""")
def serve_leaf_drill(spark, sf):
    a = L.annotate(_flow(spark, sf), ["code"], prior=40)
    return R.latest_per_key(a.filter("sector = 2"), ["code"], [F.desc("d")]).select("sector", "code", "d", "streak", F.round("net", 2).alias("net"))


@query(f"""{_NET}, days AS (SELECT d FROM (SELECT DISTINCT d FROM flow) ORDER BY d DESC LIMIT 30) SELECT flow.d, count(*) AS n, count(*) FILTER (WHERE pct > 0) AS adv, round(sum(net), 2) AS net, round(sum(amount), 2) AS amount FROM flow JOIN days ON days.d = flow.d GROUP BY 1""")
def serve_market_recent(spark, sf):
    f = _flow(spark, sf)
    days = f.select("d").distinct().orderBy(F.desc("d")).limit(30)
    return f.join(F.broadcast(days), "d").groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pct") > 0, 1)).alias("adv"), F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("amount"), 2).alias("amount"))
