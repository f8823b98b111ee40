"""Queries of scans, filters, joins, aggregates, windows and set operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators import windows as X
from tidemark.sources.bars import EVENT_BARS_SQL, LINE_BARS_SQL, event_bars, line_bars
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


@query(f"WITH {EVENT_BARS_SQL} SELECT code, d, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, vol, round(amount, 2) AS amount FROM bars")
def bars_daily(spark, sf):
    return event_bars(spark, sf).select("code", "d", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")], "vol", F.round("amount", 2).alias("amount"))


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (1, 2, 5, 7, 10, 40) AND o_orderdate <= TIMESTAMP '1997-06-30'")
def scan_codes_asof(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice").filter(F.col("o_custkey").isin(1, 2, 5, 7, 10, 40) & (F.col("o_orderdate") <= F.lit("1997-06-30").cast("timestamp")))


@query("SELECT DISTINCT o_custkey AS code FROM orders ORDER BY 1 LIMIT 50")
def scan_distinct_codes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("code")).distinct().orderBy("code").limit(50)


@query("SELECT min(o_orderdate) AS coverage_start, max(o_orderdate) AS coverage_end, count(*)::BIGINT AS n FROM orders")
def scan_coverage(spark, sf):
    return table(spark, sf, "orders").agg(F.min("o_orderdate").alias("coverage_start"), F.max("o_orderdate").alias("coverage_end"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_date FROM events WHERE event_type = 'purchase'")
def scan_epoch_local_date(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    local = F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), "Asia/Shanghai"))
    return table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id", local.alias("local_date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def scan_tolerant_dates(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("n/a")
    s = o.select("o_orderkey", raw.alias("s"))
    return s.select("o_orderkey", F.to_date(F.coalesce(F.try_to_timestamp("s", F.lit("yyyy-MM-dd")), F.try_to_timestamp("s", F.lit("yyyyMMdd")))).alias("parsed"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN 'fallback' WHEN substr(k, 1, 2) IN ('10', '11') THEN 'ten' WHEN substr(k, 1, 1) = '1' THEN 'one' WHEN substr(k, 1, 1) IN ('2', '3') THEN 'low' ELSE 'other' END AS board,
  substr(k, 1, 2) IN ('10', '20', '30') AS in_universe FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS k FROM orders)""")
def filter_prefix_universe(spark, sf):
    k = F.col("o_custkey").cast("string")
    two, one = F.substring(k, 1, 2), F.substring(k, 1, 1)
    board = F.when(F.col("o_custkey").isNull(), "fallback").when(two.isin("10", "11"), "ten").when(one == "1", "one").when(one.isin("2", "3"), "low").otherwise("other")
    return table(spark, sf, "orders").select("o_orderkey", board.alias("board"), two.isin("10", "20", "30").alias("in_universe"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name IS NULL OR NOT (p_name LIKE 'ST%' OR p_name LIKE '*ST%' OR contains(p_name, 'red'))")
def filter_name_excludes(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").filter(n.isNull() | ~(n.startswith("ST") | n.startswith("*ST") | n.contains("red"))).select("p_partkey", "p_name")


@query(f"WITH {LINE_BARS_SQL} SELECT code, d FROM bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND vol >= 1e-6 AND amount >= 1e-6 AND high >= open AND high >= close AND high >= low AND low <= open AND low <= close")
def filter_price_quality(spark, sf):
    return line_bars(spark, sf).filter("open > 0 AND high > 0 AND low > 0 AND close > 0 AND vol >= 1e-6 AND amount >= 1e-6 AND high >= greatest(open, close, low) AND low <= least(open, close)").select("code", "d")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 4) END AS clean FROM events")
def filter_nan_to_null(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    e = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    x = F.expr("try_cast(raw AS DOUBLE)")
    return e.select("event_id", F.when(~F.isnan(x), F.round(x, 4)).alias("clean"))


@query("""SELECT a.event_id, a.event_type IS DISTINCT FROM b.event_type AS changed FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1""")
def filter_null_safe_change(spark, sf):
    a, b = table(spark, sf, "events").alias("a"), table(spark, sf, "events").alias("b")
    return a.join(b, F.col("b.event_id") == F.col("a.event_id") + 1, "left").select("a.event_id", (~F.col("a.event_type").eqNullSafe(F.col("b.event_type"))).alias("changed"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def filter_exists_not_exists(spark, sf):
    o = table(spark, sf, "orders")
    big, part = o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_semi").join(part, "c_custkey", "left_anti")


@query(f"WITH {EVENT_BARS_SQL}, days AS (SELECT DISTINCT d FROM bars), codes AS (SELECT DISTINCT code FROM bars) SELECT code, d FROM codes CROSS JOIN days WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.code = codes.code AND b.d = days.d)")
def filter_missing_dates(spark, sf):
    b = event_bars(spark, sf).select("code", "d")
    codes = b.select("code").distinct()
    # the calendar is one row of a few dates, bounded by days, not by rows
    days = b.agg(F.collect_set("d").alias("days"))
    expected = codes.join(F.broadcast(days), F.lit(True)).select("code", F.explode("days").alias("d"))
    return R.missing_keys(expected, b, ["code", "d"])


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def filter_latest_per_key(spark, sf):
    return R.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT * EXCLUDE (p_name, p_type) FROM part")
def filter_exclude_columns(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_type")


@query("SELECT p_partkey, p_brand, p_size, (SELECT count(*) FROM part WHERE p_size = 10) > 5 AS truncated FROM part WHERE p_size = 10 ORDER BY p_partkey LIMIT 5")
def filter_facet_page(spark, sf):
    return R.facet_page(table(spark, sf, "part"), {"p_size": 10, "p_brand": None}, [F.asc("p_partkey")], 5).select("p_partkey", "p_brand", "p_size", "truncated")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '7') OR contains(c_name, '7') ORDER BY c_custkey LIMIT 20 OFFSET 10")
def filter_search_page(spark, sf):
    return R.search_page(table(spark, sf, "customer"), "7", ["c_custkey", "c_name"], [F.asc("c_custkey")], 10, 20).select("c_custkey", "c_name")


@query("""SELECT event_id, list_filter(['missing_value', 'unknown_type', 'negative', 'outlier'], lambda x: (x = 'missing_value' AND value IS NULL) OR (x = 'unknown_type' AND event_type NOT IN ('click', 'view', 'purchase'))
  OR (x = 'negative' AND coalesce(value < 0, false)) OR (x = 'outlier' AND coalesce(abs(value) > 90, false))) AS violations FROM events""")
def filter_candidate_rules(spark, sf):
    v, t = F.col("value"), F.col("event_type")
    rules = {"missing_value": v.isNull(), "unknown_type": ~t.isin("click", "view", "purchase"), "negative": v < 0, "outlier": F.abs(v) > 90}
    return table(spark, sf, "events").select("event_id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()])).alias("violations"))


@query("""WITH q AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)
SELECT c.c_custkey AS code, e.d, q.price FROM customer c CROSS JOIN (SELECT DATE '1995-06-30' AS d UNION ALL SELECT DATE '1997-12-31') e ASOF LEFT JOIN q ON q.code = c.c_custkey AND q.d <= e.d""")
def join_asof(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("qd")).agg(F.max("o_totalprice").alias("price"))
    ask = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.explode(F.array(F.lit("1995-06-30").cast("date"), F.lit("1997-12-31").cast("date"))).alias("d"))
    return R.asof_join(ask, q, ["code"], "d", "qd", ["price"])


_SPANS = "spans AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 200 END AS e, o_orderkey AS k FROM orders), ask AS (SELECT DISTINCT o_custkey AS code, DATE '1996-03-15' AS d FROM orders)"


def _spans(spark, sf):
    o = table(spark, sf, "orders")
    s = F.to_date("o_orderdate")
    return o.select(F.col("o_custkey").alias("code"), F.lit("1996-03-15").cast("date").alias("d")).distinct(), o.select(F.col("o_custkey").alias("code"), s.alias("s"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(s, 200)).alias("e"), F.col("o_orderkey").alias("k"))


@query(f"WITH {_SPANS} SELECT a.code, a.d, (SELECT arg_max(k, {{'s': s, 'k': k}}) FROM spans WHERE spans.code = a.code AND s <= a.d AND (e IS NULL OR e > a.d)) AS k FROM ask a")
def join_interval_newest(spark, sf):
    ask, spans = _spans(spark, sf)
    return R.interval_join(ask, spans, ["code"], "d", "s", "e", ["k"])


@query(f"WITH {_SPANS} SELECT a.code, a.d, (SELECT arg_max(k, {{'s': s, 'k': k}}) FROM spans WHERE spans.code = a.code AND s <= a.d AND (e IS NULL OR e >= a.d)) AS k FROM ask a")
def join_interval_closed(spark, sf):
    ask, spans = _spans(spark, sf)
    return R.interval_join(ask, spans, ["code"], "d", "s", "e", ["k"], closed=True)


@query(f"WITH {LINE_BARS_SQL}, q AS (SELECT DISTINCT code, DATE '1995-12-31' AS s, DATE '1996-03-31' AS e FROM bars) SELECT q.code, q.s, q.e, round(sum(close * vol) / nullif(sum(vol), 0), 4) AS vwap FROM q LEFT JOIN bars b ON b.code = q.code AND b.d > q.s AND b.d <= q.e GROUP BY 1, 2, 3")
def join_range_vwap(spark, sf):
    b = line_bars(spark, sf)
    q = b.select("code").distinct().withColumns({"s": F.lit("1995-12-31").cast("date"), "e": F.lit("1996-03-31").cast("date")})
    return R.window_vwap(b, q, ["code"], "s", "e").withColumn("vwap", F.round("vwap", 4))


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_orderdate = b.o_orderdate AND a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey""")
def join_self_equal_measures(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    a, b = o.withColumnRenamed("o_orderkey", "a"), o.withColumnRenamed("o_orderkey", "b")
    return a.join(b, ["o_orderdate", "o_custkey"]).filter("a < b").select("a", "b")


@query(f"""WITH {EVENT_BARS_SQL}, days AS (SELECT d, lead(d) OVER (ORDER BY d) AS nxt FROM (SELECT DISTINCT d FROM bars)), ends AS (SELECT code, max(d) AS last_d, arg_max(close, d) AS last_close, min(d) AS first_d, arg_min(open, d) AS first_open FROM bars GROUP BY code)
SELECT o.code AS old_code, n.code AS new_code, o.last_d, n.first_d FROM ends o JOIN days ON days.d = o.last_d JOIN ends n ON n.first_d = days.nxt WHERE abs(n.first_open - o.last_close) <= 0.5 * greatest(abs(o.last_close), 1) AND o.code <> n.code""")
def join_succession(spark, sf):
    b = event_bars(spark, sf)
    days = b.select("d").distinct().groupBy().agg(F.array_sort(F.collect_set("d")).alias("x"))  # a calendar: days, not rows
    nxt = days.select(F.inline(F.arrays_zip(F.col("x").alias("last_d"), F.expr("slice(x, 2, size(x))").alias("first_d")))).filter("first_d IS NOT NULL")
    ends = b.groupBy("code").agg(F.max("d").alias("last_d"), F.max_by("close", "d").alias("last_close"), F.min("d").alias("first_d"), F.min_by("open", "d").alias("first_open"))
    o, n = ends.select(F.col("code").alias("old_code"), "last_d", "last_close"), ends.select(F.col("code").alias("new_code"), "first_d", "first_open")
    near = F.abs(F.col("first_open") - F.col("last_close")) <= 0.5 * F.greatest(F.abs("last_close"), F.lit(1.0))
    return o.join(F.broadcast(nxt), "last_d").join(n, "first_d").filter(near & (F.col("old_code") != F.col("new_code"))).select("old_code", "new_code", "last_d", "first_d")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 = 0),
x AS (SELECT k, s, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT k, s, count(*) AS n FROM b GROUP BY 1, 2)
SELECT coalesce(x.k, y.k) AS k, coalesce(x.s, y.s) AS s, coalesce(x.n, 0) AS n_left, coalesce(y.n, 0) AS n_right, least(coalesce(x.n, 0), coalesce(y.n, 0)) AS matched, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS only_left, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS only_right
FROM x FULL JOIN y ON x.k IS NOT DISTINCT FROM y.k AND x.s IS NOT DISTINCT FROM y.s""")
def join_multiset(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return R.multiset_compare(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), ["k", "s"])


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'both' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def join_full_integrity(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    n = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("k").agg(F.count(F.lit(1)).alias("v"))
    return R.full_integrity(n("F"), n("O"), ["k"], "v")


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.08) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))""")
def join_three_way_intersection(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda cond: li.filter(cond).select(F.col("l_suppkey").alias("s_suppkey"))
    near = table(spark, sf, "nation").filter("n_regionkey IN (1, 2)").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(pick("l_returnflag = 'R'"), "s_suppkey", "left_semi").join(pick("l_discount >= 0.08"), "s_suppkey", "left_semi").join(near, "s_nationkey", "left_semi").select("s_suppkey")


@query(f"""WITH {EVENT_BARS_SQL}, r AS (SELECT code, d, rank() OVER (PARTITION BY d ORDER BY amount DESC, code) AS rk FROM bars), e AS (SELECT max(d) AS t FROM bars), p AS (SELECT max(d) AS y FROM bars, e WHERE d < e.t)
SELECT b.code, b.rk AS prev_rank FROM r b, e, p WHERE b.d = p.y AND b.rk <= 20 AND NOT EXISTS (SELECT 1 FROM r a WHERE a.d = e.t AND a.code = b.code AND a.rk <= 20)""")
def join_rank_dropouts(spark, sf):
    b = event_bars(spark, sf)
    r = b.withColumn("rk", F.rank().over(W.partitionBy("d").orderBy(F.desc("amount"), "code"))).filter("rk <= 20")
    two = b.select("d").distinct().orderBy(F.desc("d")).limit(2).agg(F.max("d").alias("t"), F.min("d").alias("y"))
    x = r.join(F.broadcast(two), F.lit(True))
    return x.filter("d = y").select("code", F.col("rk").cast("long").alias("prev_rank")).join(x.filter("d = t").select("code"), "code", "left_anti")


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') IS NOT NULL AS has_open, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, bool_and(o_totalprice > 1000) AS all_big, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_kinds FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def agg_filtered_quantiles(spark, sf):
    p = F.col("o_totalprice")
    return (
        table(spark, sf, "orders").groupBy("o_custkey").agg(
            F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f"), F.sum(F.when(F.col("o_orderstatus") == "O", p)).isNotNull().alias("has_open"), F.round(F.median(p), 4).alias("med"), F.round(F.percentile(p, 0.9), 4).alias("p90"),
            F.bool_and(p > 1000).alias("all_big"), F.count_distinct(F.struct("o_orderstatus", "o_orderpriority")).alias("n_kinds"), F.count(F.lit(1)).alias("n"),
        ).filter("n >= 3").drop("n")
    )


@query("SELECT o_custkey, string_agg(s, ',' ORDER BY s) AS statuses FROM (SELECT DISTINCT o_custkey, o_orderstatus AS s FROM orders) GROUP BY 1")
def agg_ordered_strings(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY 1""")
def agg_top_n_list(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("top3"))


@query("""SELECT l_suppkey, '{' || string_agg('"' || f || '":' || n, ',' ORDER BY f) || '}' AS by_flag FROM (SELECT l_suppkey, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def agg_json_object(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("l_suppkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))))).alias("by_flag"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) AS wavg, CASE WHEN count(DISTINCT l_returnflag) >= 3 THEN round(sum(l_quantity), 2) END AS gated FROM lineitem GROUP BY 1")
def agg_weighted_and_gated(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * q) / F.nullif(F.sum(q), F.lit(0.0)), 4).alias("wavg"), F.when(F.count_distinct("l_returnflag") >= 3, F.round(F.sum(q), 2)).alias("gated"))


@query("""SELECT dim, value, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT 'status' AS dim, o_orderstatus AS value, o_totalprice FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_totalprice FROM orders UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), o_totalprice FROM orders) GROUP BY 1, 2""")
def agg_dimension_rollup(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return R.dimension_rollup(o, ["status", "priority", "year"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")])


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey, c_acctbal) AS t, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WHERE c_acctbal IS NOT NULL)
SELECT c_custkey, round(CASE WHEN n = 1 THEN 50 ELSE (r + (t - 1) / 2.0 - 1) / (n - 1) * 100 END, 4) AS pct FROM r""")
def agg_mid_rank(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal IS NOT NULL").select("c_custkey", F.round(X.mid_rank("c_acctbal", ["c_nationkey"]), 4).alias("pct"))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def agg_facet_counts(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(10)


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey, 2) OVER w AS lag2, lead(o_orderkey) OVER w AS lead1, row_number() OVER w AS rn, first_value(o_orderkey) OVER w AS first_k, sum(1) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS running_n, max(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) AS running_max,
round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS avg3, round(stddev_samp(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 3) AS sd_prev3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark, sf):
    k, o = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    w = X.over(k, o)
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.lag("o_orderkey", 2).over(w).alias("lag2"), F.lead("o_orderkey").over(w).alias("lead1"), F.row_number().over(w).cast("long").alias("rn"), F.first("o_orderkey").over(W.partitionBy(*k).orderBy(*o).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("first_k"),
        F.count(F.lit(1)).over(X.over(k, o, None, 0)).alias("running_n"), F.max("o_totalprice").over(X.over(k, o, None, 0)).alias("running_max"), F.round(F.avg("o_totalprice").over(X.over(k, o, -2, 0)), 4).alias("avg3"), F.round(F.stddev_samp("o_totalprice").over(X.over(k, o, -3, -1)), 3).alias("sd_prev3"),
    )


@query("""SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST)::BIGINT AS rk, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pr, round(c_acctbal / nullif(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 0), 8) AS share,
CASE WHEN percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) < 0.2 THEN 'micro' WHEN percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) < 0.5 THEN 'small' WHEN percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) < 0.8 THEN 'mid' ELSE 'large' END AS band FROM customer WHERE c_acctbal IS NOT NULL""")
def window_ranks_and_bands(spark, sf):
    pr = X.rank_share("c_acctbal", ["c_nationkey"])
    c = table(spark, sf, "customer").filter("c_acctbal IS NOT NULL").withColumn("p", pr)
    share = F.col("c_acctbal") / F.nullif(F.sum("c_acctbal").over(W.partitionBy("c_nationkey")), F.lit(0.0))
    return c.select("c_custkey", F.rank().over(W.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("c_acctbal"))).cast("long").alias("rk"), F.round("p", 6).alias("pr"), F.round(share, 8).alias("share"), X.band(F.col("p"), [0.2, 0.5, 0.8], ["micro", "small", "mid", "large"]).alias("band"))


@query(f"""WITH {EVENT_BARS_SQL}, s AS (SELECT code, d, sign(close - open)::BIGINT AS s, row_number() OVER (PARTITION BY code ORDER BY d) AS a FROM bars), i AS (SELECT *, a - row_number() OVER (PARTITION BY code, s ORDER BY d) AS island FROM s)
SELECT code, d, s * row_number() OVER (PARTITION BY code, s, island ORDER BY d) AS streak FROM i""")
def window_signed_streak(spark, sf):
    b = event_bars(spark, sf).withColumn("x", F.col("close") - F.col("open"))
    return X.signed_streak(b, ["code"], ["d"], "x").select("code", "d", "streak")


@query(f"""WITH {EVENT_BARS_SQL}, f AS (SELECT code, d, close > open AS f FROM bars), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT code, d, CASE WHEN f THEN sum(f::INT) OVER (PARTITION BY code, run ORDER BY d ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS up_days FROM g""")
def window_run_length(spark, sf):
    return X.run_length(event_bars(spark, sf), ["code"], ["d"], F.col("close") > F.col("open"), "up_days").select("code", "d", "up_days")


@query(f"""WITH {LINE_BARS_SQL}, w AS (SELECT code, d, close, list(close) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l FROM bars)
SELECT code, d, CASE WHEN len(l) = 60 THEN round(len(list_filter(l, lambda v: v < close)) / 60.0, 6) END AS pctile FROM w""")
def window_strict_percentile(spark, sf):
    return line_bars(spark, sf).select("code", "d", F.round(X.strict_percentile("close", ["code"], ["d"], 60), 6).alias("pctile"))


@query(f"""WITH {LINE_BARS_SQL} SELECT code, d, CASE WHEN count(amount) OVER w = 40 AND stddev_samp(amount) OVER w > 0 THEN round((amount - avg(amount) OVER w) / stddev_samp(amount) OVER w, 4) END AS z FROM bars WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)""")
def window_zscore_prior(spark, sf):
    return line_bars(spark, sf).select("code", "d", F.round(X.zscore_prior("amount", ["code"], ["d"], 40), 4).alias("z"))


@query(f"""WITH {EVENT_BARS_SQL}, w AS (SELECT code, d, vol, list_sort(list(vol) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) AS l FROM bars)
SELECT code, d, vol, CASE WHEN len(l) > 0 THEN (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2.0 END AS med7, CASE WHEN len(l) > 0 AND vol < 0.5 * (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2.0 THEN true ELSE false END AS dip FROM w""")
def window_rolling_median_dips(spark, sf):
    b = event_bars(spark, sf).withColumn("med7", X.rolling_median("vol", ["code"], ["d"], 7))
    return b.select("code", "d", "vol", "med7", F.coalesce(F.col("vol") < 0.5 * F.col("med7"), F.lit(False)).alias("dip"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def sort_top_k(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25)


@query(f"WITH {EVENT_BARS_SQL} SELECT d, code, rn FROM (SELECT d, code, row_number() OVER (PARTITION BY d ORDER BY close / nullif(open, 0) DESC NULLS LAST, code) AS rn FROM bars WHERE vol >= 2) WHERE rn <= 5")
def sort_top_k_per_day(spark, sf):
    w = W.partitionBy("d").orderBy(F.desc_nulls_last(F.col("close") / F.nullif(F.col("open"), F.lit(0.0))), F.col("code"))
    return event_bars(spark, sf).filter("vol >= 2").withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 5").select("d", "code", "rn")


@query(f"WITH {EVENT_BARS_SQL} SELECT code, d FROM (SELECT code, d, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS rn FROM bars) WHERE rn <= 5")
def sort_last_n_rows(spark, sf):
    return R.latest_per_key(event_bars(spark, sf), ["code"], [F.desc("d")], 5).select("code", "d")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_union_distinct(spark, sf):
    a, b = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return a.union(b).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def set_except_all(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter("l_quantity > 25").select(F.col("l_suppkey").alias("k")).exceptAll(li.filter("l_returnflag = 'R'").select("l_suppkey"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def set_intersect(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf, "customer").filter("c_nationkey < 5").select("c_custkey"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v, 'a' AS src FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v, 'b' AS src FROM orders GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k)""")
def set_prefer_else(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    best = lambda d, s: d.groupBy("k").agg(F.max("o_totalprice").alias("v")).withColumn("src", F.lit(s))
    return R.prefer(best(o.filter("o_orderstatus = 'P'"), "a"), best(o, "b"), ["k"])
