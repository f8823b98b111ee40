"""Queries of research and audit operators, each beside its SQL (None: sequential state, tested apart)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators import calendar as C
from tidemark.operators import research as S
from tidemark.operators import technical as T
from tidemark.plans.market import off
from tidemark.sources.bars import EVENT_BARS_SQL, LINE_BARS_SQL, event_bars, line_bars
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_OUT = "o AS (SELECT code, d, row_number() OVER w AS bar, lead(open) OVER w AS entry, lead(close, 6) OVER w AS exit FROM bars WINDOW w AS (PARTITION BY code ORDER BY d)), out AS (SELECT *, entry IS NULL OR exit IS NULL AS censored, CASE WHEN entry > 0 THEN exit / entry - 1 END AS ret FROM o)"


@query(f"WITH {EVENT_BARS_SQL}, {_OUT} SELECT code, d, bar, round(entry, 4) AS entry, round(exit, 4) AS exit, censored, round(ret + 3e-9, 6) AS ret, ret > 0 AS win FROM out")
def casebook_outcome(spark, sf):
    o = S.outcome(event_bars(spark, sf), 5)
    return o.select("code", "d", "bar", F.round("entry", 4).alias("entry"), F.round("exit", 4).alias("exit"), "censored", off("ret", 6).alias("ret"), "win")


@query(f"WITH {LINE_BARS_SQL}, {_OUT} SELECT code, count(*) AS n, round(avg((ret > 0)::INT) + 3e-9, 6) AS win_rate, round(median(ret) + 3e-8, 5) AS median_ret FROM out WHERE ret IS NOT NULL GROUP BY code")
def casebook_baseline_by_code(spark, sf):
    b = S.baseline(S.outcome(line_bars(spark, sf), 5), ["code"])
    return b.select("code", "n", off("win_rate", 6).alias("win_rate"), off("median_ret", 5).alias("median_ret"))


@query(f"WITH {LINE_BARS_SQL}, {_OUT} SELECT d, count(*) AS n, round(avg((ret > 0)::INT) + 3e-9, 6) AS win_rate, round(median(ret) + 3e-8, 5) AS median_ret FROM out WHERE ret IS NOT NULL GROUP BY d")
def casebook_baseline_by_day(spark, sf):
    b = S.baseline(S.outcome(line_bars(spark, sf), 5), ["d"])
    return b.select("d", "n", off("win_rate", 6).alias("win_rate"), off("median_ret", 5).alias("median_ret"))


@query(f"""WITH RECURSIVE {LINE_BARS_SQL}, {_OUT}, sig AS (SELECT code, bar, ret FROM out WHERE ret IS NOT NULL AND bar % 7 IN (0, 1)), g AS (SELECT code, min(bar) AS last, 1 AS n FROM sig GROUP BY code UNION ALL SELECT g.code, (SELECT min(s.bar) FROM sig s WHERE s.code = g.code AND s.bar > g.last + 5), g.n + 1 FROM g WHERE EXISTS (SELECT 1 FROM sig s WHERE s.code = g.code AND s.bar > g.last + 5)),
eff AS (SELECT code, max(n) AS n_eff_sig FROM g GROUP BY code), s AS (SELECT code, count(*) AS n_sig, count(*) FILTER (WHERE ret > 0) AS wins FROM sig GROUP BY code), b AS (SELECT code, count(*) AS n_days, avg((ret > 0)::INT) AS base_wr, floor((count(*) - 1) / 6.0) + 1 AS n_eff_base FROM out WHERE ret IS NOT NULL GROUP BY code),
x AS (SELECT s.code, n_sig, wins, n_eff_sig, n_eff_base, wins / n_sig AS wr, base_wr, 1 / (1 / n_eff_sig + 1 / n_eff_base) AS n_pair FROM s JOIN b ON b.code = s.code JOIN eff ON eff.code = s.code)
SELECT code, n_sig, wins, n_eff_sig::BIGINT AS n_eff_sig, n_eff_base::BIGINT AS n_eff_base, round(n_pair + 3e-7, 4) AS n_pair, round(wr - base_wr + 3e-8, 5) + 0.0 AS excess, round((wr + {S.Z * S.Z} / (2 * n_eff_sig)) / (1 + {S.Z * S.Z} / n_eff_sig) - {S.Z} * sqrt(wr * (1 - wr) / n_eff_sig + {S.Z * S.Z} / (4.0 * n_eff_sig * n_eff_sig)) / (1 + {S.Z * S.Z} / n_eff_sig) + 3e-8, 5) + 0.0 AS wilson_lo,
round({S.Z} * sqrt(wr * (1 - wr) / n_eff_sig + base_wr * (1 - base_wr) / n_eff_base) + 3e-8, 5) AS half_width, CASE WHEN n_pair < 10 THEN 'too_few' WHEN n_pair < 30 THEN 'low' WHEN n_pair < 200 THEN 'fair' ELSE 'good' END AS tier FROM x""")
def casebook_pair_stats(spark, sf):
    o = S.outcome(line_bars(spark, sf), 5)
    p = S.pair_stats(o.filter((F.col("bar") % 7).isin(0, 1)), o, 5)
    return p.select("code", "n_sig", "wins", "n_eff_sig", F.col("n_eff_base").cast("long").alias("n_eff_base"), off("n_pair", 4).alias("n_pair"), off("excess", 5).alias("excess"), off("wilson_lo", 5).alias("wilson_lo"), off("half_width", 5).alias("half_width"), "tier")


@query(f"""WITH {LINE_BARS_SQL}, {_OUT}, bag AS (SELECT d, avg(ret) AS r FROM out WHERE ret IS NOT NULL AND ret < 0.5 GROUP BY d), n AS (SELECT d, r, exp(sum(ln(1 + r / 100)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS nav FROM bag)
SELECT d, round(r + 3e-8, 5) AS bag_ret, round(nav + 3e-7, 4) AS nav, round(1 - nav / greatest(max(nav) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 1.0) + 3e-7, 4) AS drawdown FROM n""")
def paper_nav_drawdown(spark, sf):
    o = S.outcome(line_bars(spark, sf), 5).filter("ret < 0.5").withColumn("r", F.col("ret") / 100)
    return S.nav(o, "d", "r").select("d", off(F.col("bag_ret") * 100, 5).alias("bag_ret"), off("nav", 4).alias("nav"), off("drawdown", 4).alias("drawdown"))


@query(f"""WITH RECURSIVE {LINE_BARS_SQL}, x AS (SELECT code, d, low, high, row_number() OVER (PARTITION BY code ORDER BY d) AS i, min(low) OVER a AS lo, count(*) OVER a AS n, max(high) OVER f AS top FROM bars WINDOW a AS (PARTITION BY code ORDER BY d ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), f AS (PARTITION BY code ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)),
p AS (SELECT x.code, x.d, x.i, x.top / x.low - 1 AS gain, min(h.i) AS pi FROM x JOIN x h ON h.code = x.code AND h.i BETWEEN x.i + 1 AND x.i + 60 AND h.high = x.top WHERE x.n = 11 AND x.low = x.lo AND x.low > 0 AND x.top / x.low - 1 >= 0.6 GROUP BY ALL HAVING min(h.i) - x.i >= 5),
nx AS (SELECT a.code, a.i, min(b.i) AS nx FROM p a JOIN p b ON b.code = a.code AND b.i > a.pi GROUP BY 1, 2), k AS (SELECT code, min(i) AS i FROM p GROUP BY code UNION ALL SELECT k.code, nx.nx FROM k JOIN nx ON nx.code = k.code AND nx.i = k.i)
SELECT p.code, p.d AS bottom, x.d AS peak, gain, pi - p.i AS days FROM k JOIN p ON p.code = k.code AND p.i = k.i JOIN x ON x.code = p.code AND x.i = p.pi""")
def rally_episodes(spark, sf):
    return S.rally_scan(line_bars(spark, sf), side=5, ahead=60, gain=0.6, least=5)


@query(f"""WITH {LINE_BARS_SQL}, x AS (SELECT code, d, low, min(low) OVER a AS lo, count(*) OVER a AS n, max(high) OVER f AS peak, count(*) OVER f AS m FROM bars WINDOW a AS (PARTITION BY code ORDER BY d ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), f AS (PARTITION BY code ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING))
SELECT code, d, round(low + 3e-6, 3) AS low, round(peak + 3e-6, 3) AS peak, m = 40 AS complete FROM x WHERE n = 21 AND low = lo""")
def rally_pivot_lows(spark, sf):
    return S.pivot_lows(line_bars(spark, sf), 10, 40).select("code", "d", off("low", 3).alias("low"), off("peak", 3).alias("peak"), "complete")


def _moves(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    w = W.partitionBy("o_custkey", F.col("o_orderkey") % 3).orderBy("d", "o_orderkey")
    k = F.row_number().over(w)
    kind = F.when(k % 5 == 0, "exit").when(k % 5 == 1, "new").when(k % 2 == 0, "add").otherwise("trim")
    price = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1000)
    return o.select(F.col("o_custkey").alias("holder"), (F.col("o_orderkey") % 3).alias("stock"), "d", F.col("o_orderkey").alias("seq"), kind.alias("kind"), (F.col("o_orderkey") % 50 + 1).cast("double").alias("shares"), price.alias("price"))


_EPISODES = """q AS (SELECT *, o_orderkey % 3 AS stock, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS k FROM orders),
m AS (SELECT o_custkey AS holder, stock, k AS rn, CAST(o_orderdate AS DATE) AS d, CASE WHEN k % 5 = 0 THEN 'exit' WHEN k % 5 = 1 THEN 'new' WHEN k % 2 = 0 THEN 'add' ELSE 'trim' END AS kind, (o_orderkey % 50 + 1)::DOUBLE AS n, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS px FROM q),
s AS (SELECT DISTINCT holder, stock, 0::BIGINT AS rn, false AS open, NULL::DATE AS opened, false AS seeded, 0::DOUBLE AS sh, 0::DOUBLE AS peak, 0::DOUBLE AS cost, 0::DOUBLE AS got, NULL::VARCHAR AS status, NULL::DATE AS closed, NULL::DATE AS e_opened, NULL::BOOLEAN AS e_seeded, NULL::DOUBLE AS e_peak, NULL::DOUBLE AS e_cost, NULL::DOUBLE AS e_got FROM m
UNION ALL SELECT holder, stock, rn, CASE WHEN b IN (1, 2) THEN false WHEN b IN (3, 4) THEN true ELSE open END, CASE WHEN b IN (3, 4) THEN d ELSE opened END, CASE WHEN b IN (3, 4) THEN kind <> 'new' ELSE seeded END, CASE WHEN b > 2 THEN n ELSE sh END, CASE b WHEN 3 THEN n WHEN 4 THEN n WHEN 5 THEN greatest(peak, n) ELSE peak END,
 CASE b WHEN 3 THEN px WHEN 4 THEN px WHEN 5 THEN (cost * sh + (n - sh) * px) / n ELSE cost END, CASE b WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 6 THEN got + (sh - n) * (px - cost) ELSE got END, CASE b WHEN 1 THEN 'unpriced_close' WHEN 2 THEN 'closed' WHEN 4 THEN 'superseded' END, d, opened, seeded, peak, cost, CASE WHEN b = 1 THEN got ELSE got + sh * (px - cost) END
 FROM (SELECT s.* EXCLUDE (rn, status, closed, e_opened, e_seeded, e_peak, e_cost, e_got), m.rn, m.d, m.kind, m.n, m.px, CASE WHEN kind = 'exit' AND NOT open THEN 0 WHEN kind = 'exit' AND px IS NULL THEN 1 WHEN kind = 'exit' THEN 2 WHEN px IS NULL THEN 0 WHEN NOT open THEN 3 WHEN kind = 'new' THEN 4 WHEN n > sh THEN 5 ELSE 6 END AS b FROM s JOIN m ON m.holder = s.holder AND m.stock = s.stock AND m.rn = s.rn + 1)),
e AS (SELECT holder, stock, e_opened AS opened, closed, status, e_seeded AS seeded, e_peak AS peak_shares, e_cost AS cost, e_got AS realized FROM s WHERE status IS NOT NULL UNION ALL SELECT holder, stock, opened, NULL, 'holding', seeded, peak, cost, got FROM s WHERE open AND rn = (SELECT max(rn) FROM m WHERE m.holder = s.holder AND m.stock = s.stock)),
episodes AS (SELECT *, CASE WHEN cost * peak_shares > 0 THEN realized / (cost * peak_shares) END AS ret FROM e)"""


@query(f"WITH RECURSIVE {_EPISODES} SELECT * REPLACE (round(cost + 3e-7, 4) AS cost, round(realized + 3e-6, 3) AS realized, round(ret + 3e-9, 6) + 0.0 AS ret) FROM episodes")
def holding_episodes(spark, sf):
    e = S.episodes(_moves(spark, sf))
    return e.withColumns({"cost": off("cost", 4), "realized": off("realized", 3), "ret": off("ret", 6) + 0.0})


@query(f"""WITH RECURSIVE {_EPISODES}, g AS (SELECT holder, count(*) AS episodes, count(*) FILTER (WHERE status = 'holding') AS holding, count(*) FILTER (WHERE r) AS rankable, round(avg((ret > 0)::INT) FILTER (WHERE r), 6) AS win_rate, round(median(ret) FILTER (WHERE r) + 3e-7, 4) + 0.0 AS median_ret FROM (SELECT *, status = 'closed' AND NOT seeded AND ret IS NOT NULL AS r FROM episodes) GROUP BY holder)
SELECT *, CASE WHEN rankable >= 3 THEN 'ranked' WHEN rankable > 0 THEN 'low_sample' WHEN holding = episodes THEN 'holding_only' ELSE 'no_closed' END AS metrics_status FROM g""")
def holding_profiles(spark, sf):
    p = S.profiles(S.episodes(_moves(spark, sf)), least=3)
    return p.withColumns({"win_rate": F.round("win_rate", 6), "median_ret": off("median_ret", 4) + 0.0})


@query(f"""WITH {LINE_BARS_SQL}, x AS (SELECT code, d, close, lead(open) OVER w AS eo, lead(vol) OVER w AS ev, lead(open, 6) OVER w AS xo, lead(vol, 6) OVER w AS xv FROM bars WINDOW w AS (PARTITION BY code ORDER BY d)), p AS (SELECT code, d FROM (SELECT code, d, row_number() OVER (PARTITION BY d ORDER BY amount DESC, code) AS rn FROM bars) WHERE rn <= 3),
r AS (SELECT p.code, p.d, eo, xo, CASE WHEN eo IS NULL THEN 'no_bar' WHEN eo <= 0 OR ev <= 0 THEN 'suspended' WHEN eo >= close * 1.1 - 1e-9 THEN 'limit_up' WHEN xo IS NULL THEN 'exit_no_bar' WHEN xo <= 0 OR xv <= 0 THEN 'exit_suspended' ELSE 'filled' END AS reason FROM p JOIN x ON x.code = p.code AND x.d = p.d)
SELECT code, d, reason, CASE WHEN reason = 'filled' THEN round(xo * (1 - 0.00175) / (eo * (1 + 0.00075)) - 1 + 3e-8, 5) + 0.0 END AS net FROM r""")
def paper_fills(spark, sf):
    b = line_bars(spark, sf)
    w = W.partitionBy("d").orderBy(F.desc("amount"), "code")
    picks = b.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("code", "d")
    return S.paper_fills(picks, b, 5).select("code", "d", "reason", off("net", 5).alias("net"))


@query(None)
def paper_event_hold(spark, sf):
    b = event_bars(spark, sf)
    f = T.activity_breakout(b, 60.0, 30.0)
    ev = f.filter("entry").select("code", "d", F.lit("entry").alias("kind")).unionByName(f.filter("exit").select("code", "d", F.lit("exit").alias("kind")))
    return S.event_hold(ev, b, 10, 3)


@query(f"""WITH {EVENT_BARS_SQL}, c AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars)), x AS (SELECT *, floor((n - 5) / 3.0) AS size FROM c)
SELECT d, CASE WHEN i > n - 5 THEN 'holdout' WHEN floor((i - 1) / size) >= 3 OR (i - 1) % size >= size - 1 THEN 'embargo' ELSE 'fold_' || floor((i - 1) / size)::BIGINT END AS role FROM x""")
def paper_walk_forward(spark, sf):
    return S.walk_forward(C.trading_days(event_bars(spark, sf)).select("d"), 3, 1, 5)


@query("""WITH r AS (SELECT l_partkey % 20 AS stock, year(l_shipdate) AS period, l_suppkey AS holder, sum(l_quantity) AS shares FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT stock, period, lead(period) OVER (PARTITION BY stock ORDER BY period) AS np FROM (SELECT DISTINCT stock, period FROM r))
SELECT r.stock, r.holder, r.period, np AS next_period, r.shares FROM r JOIN n ON n.stock = r.stock AND n.period = r.period AND np IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.stock = r.stock AND q.period = np AND q.holder = r.holder)""")
def holder_exits(spark, sf):
    r = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 20).alias("stock"), F.year("l_shipdate").alias("period"), F.col("l_suppkey").alias("holder")).agg(F.sum("l_quantity").alias("shares"))
    return S.holder_exits(r)


@query("""WITH m AS (SELECT o_custkey % 30 AS stock, date_trunc('month', o_orderdate)::DATE AS d, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1, 2), c AS (SELECT *, n / nullif(lag(n) OVER (PARTITION BY stock ORDER BY d), 0) - 1 AS ch FROM m), f AS (SELECT *, coalesce(ch < 0, false) AS f FROM c), r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY stock ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT stock, d, n, round(ch + 3e-9, 6) AS change, CASE WHEN f THEN sum(f::INT) OVER (PARTITION BY stock, run ORDER BY d ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS falls FROM r""")
def holder_concentration(spark, sf):
    m = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 30).alias("stock"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("d")).agg(F.count_distinct("o_custkey").alias("n"))
    return S.concentration(m, ["stock"], "n").select("stock", "d", "n", off("change", 6).alias("change"), "falls")


@query(f"""WITH {EVENT_BARS_SQL}, e AS (SELECT o_custkey AS stock, CAST(o_orderdate AS DATE) AS available, count(*) AS rows, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY 1, 2), cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)
SELECT e.stock, e.available, e.rows, e.score, c.d AS signal_day FROM e ASOF LEFT JOIN cal c ON c.d > e.available""")
def disclosure_signal_day(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("stock"), F.to_date("o_orderdate").alias("available"), F.col("o_totalprice").alias("score"))
    cal = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct().filter(F.dayofweek("d").between(2, 6))
    return S.first_signal_day(o, cal).select("stock", "available", "rows", F.round("score", 2).alias("score"), "signal_day")


# --- audit


@query("SELECT r_regionkey, r_regionkey || '|' || r_name AS grain, sha256('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}') AS row_hash FROM region")
def land_payload_hash(spark, sf):
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    return r.select("r_regionkey", F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name").alias("grain"), A.payload_hash("r_regionkey", "r_name").alias("row_hash"))


_REJ = """r AS (SELECT event_id, event_type, CASE WHEN user_id IS NULL THEN 'MISSING_FIELDS' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'INVALID_CODE' WHEN value IS NULL THEN 'NULL_NUMERIC' WHEN value < 1 THEN 'INVALID_NUMERIC' WHEN count(*) OVER (PARTITION BY user_id, ts) > 1 THEN 'DUPLICATE_GRAIN' END AS reject_code FROM events)"""


def _rejects(spark, sf):
    rules = [("MISSING_FIELDS", F.col("user_id").isNull()), ("INVALID_CODE", ~F.col("event_type").isin("view", "click", "purchase")), ("NULL_NUMERIC", F.col("value").isNull()), ("INVALID_NUMERIC", F.col("value") < 1)]
    return A.reject_codes(table(spark, sf, "events"), rules, ["user_id", "ts"])


@query(f"WITH {_REJ} SELECT event_id, reject_code FROM r")
def land_reject_codes(spark, sf):
    return _rejects(spark, sf).select("event_id", "reject_code")


@query(f"WITH {_REJ} SELECT event_type, count(*) AS rows, count(reject_code) AS rejected, CASE WHEN count(reject_code) > 0 THEN min(reject_code) WHEN count(*) < 100000 THEN 'BELOW_MIN_ROWS' ELSE 'ACCEPTED' END AS verdict FROM r GROUP BY 1")
def land_batch_verdict(spark, sf):
    return A.batch_verdict(_rejects(spark, sf), ["event_type"], 100_000).select("event_type", "rows", "rejected", "verdict")


@query("""WITH b AS (SELECT o_orderkey, o_orderpriority, o_custkey + 1 AS o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0) SELECT o_orderkey, o_orderpriority, o_custkey FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM b) UNION ALL SELECT * FROM b""")
def land_accept_partition(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    b = o.filter("o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)
    return A.accept(o, b, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "o_custkey")


@query("""WITH t AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT n.k, n.d FROM n LEFT JOIN (SELECT k, max(d) AS f FROM t GROUP BY k) x ON x.k = n.k WHERE f IS NULL OR n.d > f""")
def sink_append_frontier(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    return A.frontier_append(o.filter("o_orderkey % 3 = 0"), o, "k", "d").select("k", "d")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer""")
def sink_merge_on_grain(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return A.merge_on_grain(c, c.filter("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), s AS (SELECT count(*) AS n FROM a JOIN b ON a.k = b.k)
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, s.n AS shared, round(s.n / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - s.n), 6) AS jaccard FROM s""")
def recon_code_sets(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return A.set_similarity(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "k").withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {LINE_BARS_SQL}, a AS (SELECT code, d, close FROM bars WHERE code % 5 <> 0), b AS (SELECT code, d, CASE WHEN code % 7 = 0 THEN close * 1.01 ELSE close END AS close FROM bars WHERE code % 4 <> 0),
j AS (SELECT coalesce(a.d, b.d) AS d, a.close AS x, b.close AS y, a.d IS NOT NULL AS l, b.d IS NOT NULL AS r FROM a FULL JOIN b ON a.code = b.code AND a.d = b.d)
SELECT d, count(*) FILTER (WHERE l AND r) AS both, count(*) FILTER (WHERE NOT r) AS only_left, count(*) FILTER (WHERE NOT l) AS only_right, count(*) FILTER (WHERE l AND r AND abs(x - y) > greatest(1e-6, abs(y) * 1e-4)) AS mismatches, round(median(x / nullif(y, 0)) FILTER (WHERE l AND r), 6) AS ratio FROM j GROUP BY d""")
def recon_bars_by_day(spark, sf):
    b = line_bars(spark, sf).select("code", "d", "close")
    right = b.filter("code % 4 <> 0").withColumn("close", F.when(F.col("code") % 7 == 0, F.col("close") * 1.01).otherwise(F.col("close")))
    return A.bar_reconciliation(b.filter("code % 5 <> 0"), right, ["code", "d"], "close").withColumn("ratio", F.round("ratio", 6))


@query("""SELECT coalesce(a.g, b.g) AS g, old_n, new_n, CASE WHEN coalesce(abs(os - ns) <= 0.01, false) AND old_n = new_n THEN 'exact' WHEN coalesce(abs(os - ns) <= 0.01, false) THEN 'merged' ELSE 'residual' END AS kind
FROM (SELECT l_orderkey AS g, round(sum(l_quantity), 2) AS os, count(*) AS old_n FROM lineitem GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS g, round(sum(q), 2) AS ns, count(*) AS new_n FROM (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber > 1 GROUP BY 1, 2) GROUP BY 1) b ON a.g = b.g""")
def recon_split_merge(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "g")
    new = li.filter("g % 5 <> 0 OR l_linenumber > 1").groupBy("g", "l_returnflag").agg(F.sum("l_quantity").alias("l_quantity"))
    return A.split_match(li, new, ["g"], "l_quantity").select("g", "old_n", "new_n", "kind")


@query("SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def audit_duplicate_grain(spark, sf):
    return A.duplicate_grain(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query(f"""WITH {EVENT_BARS_SQL}, cal AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM bars)), x AS (SELECT code, bars.d AS gap_after, lead(bars.d) OVER w AS gap_until, lead(n) OVER w - n - 1 AS missing FROM bars JOIN cal ON cal.d = bars.d WINDOW w AS (PARTITION BY code ORDER BY n)) SELECT * FROM x WHERE missing > 0""")
def audit_calendar_gaps(spark, sf):
    b = event_bars(spark, sf)
    return A.calendar_gaps(b, C.trading_days(b), "code")


@query("""WITH c AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS rows FROM orders GROUP BY 1), w AS (SELECT d, rows, list_sort(list(rows) OVER w) AS l, stddev_samp(rows) OVER w / nullif(avg(rows) OVER w, 0) < 0.25 AS steady FROM c WINDOW w AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN len(l) > 0 THEN (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2.0 END AS usual FROM w) SELECT d, rows, usual, CASE WHEN coalesce(rows >= 0.5 * usual, true) THEN 'none' WHEN steady THEN 'high' ELSE 'low' END AS severity FROM m""")
def audit_row_dips(spark, sf):
    return A.row_dips(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), "day")


@query(f"""WITH {EVENT_BARS_SQL}, cal AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM bars)), l AS (SELECT code, max(d) AS latest FROM bars GROUP BY code) SELECT code, latest, (SELECT max(n) FROM cal) - n AS lag, (SELECT max(n) FROM cal) - n <= 1 AS within_sla FROM l LEFT JOIN cal ON cal.d = l.latest""")
def audit_watermarks(spark, sf):
    b = event_bars(spark, sf)
    return A.watermark(b, "code", "d", C.trading_days(b), 1)


@query("""WITH a AS (SELECT o_custkey AS k, min(o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_orderstatus) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, CASE WHEN a.k IS NULL THEN 'joined' WHEN b.k IS NULL THEN 'left' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k) WHERE change IS NOT NULL""")
def audit_state_diff(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    v = lambda d: d.groupBy("k").agg(F.min("o_orderstatus").alias("v"))
    return A.state_diff(v(o.filter("o_orderkey % 2 = 0")), v(o.filter("o_orderkey % 3 = 0")), ["k"], "v")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 40 AS dst FROM nation), r AS (SELECT 0 AS root, 0 AS node, 0 AS distance UNION SELECT r.root, e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 4) SELECT root, node, min(distance) AS distance FROM r WHERE node <> root GROUP BY 1, 2""")
def audit_lineage_impact(spark, sf):
    e = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 40).cast("int").alias("dst"))
    return A.lineage_impact(e, spark.range(1).select(F.lit(0).alias("root")), 4)


@query("""WITH b AS (SELECT o_orderkey AS batch_id, o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'landed' END AS status, o_orderdate AS t, o_orderkey % 10 = 0 AS p FROM orders),
x AS (SELECT *, bool_or(p) OVER (PARTITION BY k) AS has, row_number() OVER (PARTITION BY k, status ORDER BY t DESC, batch_id DESC) AS rk FROM b)
SELECT batch_id, k, status, CASE WHEN p OR status = 'landed' OR (status = 'accepted' AND NOT has AND rk = 1) THEN 'keep' WHEN status = 'accepted' THEN 'archive' ELSE 'drop' END AS plan FROM x""")
def audit_retention_plan(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("landed")
    b = o.select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("k"), status.alias("status"), F.col("o_orderdate").alias("t"))
    return A.retention_plan(b, b.filter("batch_id % 10 = 0"), "k", "batch_id", "status", "t")


@query("SELECT 'negative_quantity' AS rule, count(*) AS violations FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'orphan_lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'wide_discount', count(*) FROM lineitem WHERE l_discount > 0.09")
def audit_invariants(spark, sf):
    for t in ("lineitem", "orders"):
        table(spark, sf, t).createOrReplaceTempView(f"inv_{t}")
    return A.invariants(spark, {"negative_quantity": "SELECT 1 FROM inv_lineitem WHERE l_quantity < 0", "orphan_lines": "SELECT 1 FROM inv_lineitem l LEFT ANTI JOIN inv_orders o ON o.o_orderkey = l.l_orderkey", "wide_discount": "SELECT 1 FROM inv_lineitem WHERE l_discount > 0.09"})


@query("""WITH s AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 300 END AS e, o_orderkey AS t FROM orders), x AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s, t) AS nx FROM s), c AS (SELECT k, s, t, CASE WHEN nx IS NOT NULL AND (e IS NULL OR e > nx) THEN nx ELSE e END AS valid_to FROM x) SELECT * FROM c WHERE valid_to IS NULL OR valid_to > s""")
def audit_validity_spans(spark, sf):
    s = F.to_date("o_orderdate")
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), s.alias("s"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(s, 300)).alias("e"), F.col("o_orderkey").alias("t"))
    return A.validity_spans(d, "k", "s", "e", "t").select("k", "s", "t", "valid_to")
