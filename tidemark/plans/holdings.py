"""Queries of holding episodes on three bases of cost, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import holdings as H
from tidemark.plans.market import off
from tidemark.session import saved, table
from tidemark.sources.bars import LINE_BARS_SQL, line_bars

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"""WITH {LINE_BARS_SQL}, r AS (SELECT DISTINCT code, last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) AS d FROM bars WHERE (code + month(d)) % 5 > 0), w AS (SELECT code, d, coalesce(lag(d) OVER (PARTITION BY code ORDER BY d), d - 92) AS start FROM r),
t AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, abs(CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END) AS net FROM lineitem WHERE l_returnflag = 'R')
SELECT w.code, w.d, w.start, round((SELECT sum(close * vol) / nullif(sum(vol), 0) FROM bars b WHERE b.code = w.code AND b.d > w.start AND b.d <= w.d) + 3e-6, 3) AS c1, (SELECT arg_max(close, b.d) FROM bars b WHERE b.code = w.code AND b.d <= w.d) AS c2,
 round((SELECT sum(close * net) / nullif(sum(net), 0) FROM t JOIN bars b ON b.code = t.code AND b.d = t.d WHERE t.code = w.code AND t.d > w.start AND t.d <= w.d) + 3e-6, 3) AS c3 FROM w""")
def holding_window_prices(spark, sf):
    b = saved(line_bars(spark, sf), "bars")
    r = b.filter((F.col("code") + F.month("d")) % 5 > 0).select("code", F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("d"))
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    net = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    p = H.window_prices(r, b, li.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d"), net.alias("net")))
    return p.withColumns({"c1": off("c1", 3), "c3": off("c3", 3)})


_K = ("c1", "c2", "c3")
_OLD = "open, opened, seeded, sh, peak, adds, trims, " + ", ".join(f"k_{c}, g_{c}" for c in _K)


def _episodes_sql() -> str:
    """The moves of each pair walked one by one, with what ended at each step beside the state after it."""
    pick = lambda old, **by: "CASE b " + " ".join(f"WHEN {k[1:]} THEN {v}" for k, v in by.items()) + f" ELSE {old} END"
    more = "coalesce(shares, sh + coalesce(change, 0))"
    sold = "least(abs(coalesce(change, 0)), sh)"
    new = [
        f"{pick('open', _1='false', _2='false', _3='true', _4='true')} AS open", f"{pick('opened', _3='d', _4='d')} AS opened", f"{pick('seeded', _3=chr(39).join(['kind <> ', 'new', '']), _4='false')} AS seeded",
        f"{pick('sh', _3='coalesce(shares, 0)', _4='coalesce(shares, 0)', _5=more, _6=f'coalesce(shares, sh - {sold})')} AS sh", f"{pick('peak', _3='coalesce(shares, 0)', _4='coalesce(shares, 0)', _5=f'greatest(peak, {more})')} AS peak",
        f"{pick('adds', _3='0', _4='0', _5='adds + 1')} AS adds", f"{pick('trims', _3='0', _4='0', _6='trims + 1')} AS trims",
    ]
    for c in _K:
        cost = f"CASE WHEN {more} > 0 AND coalesce(change, 0) > 0 THEN (k_{c} * sh + change * {c}) / {more} ELSE k_{c} END"
        new += [f"{pick(f'k_{c}', _3=c, _4=c, _5=cost)} AS k_{c}", f"{pick(f'g_{c}', _3='0', _4='0', _6=f'g_{c} + {sold} * ({c} - k_{c})')} AS g_{c}"]
    out = ["CASE b WHEN 1 THEN 'unpriced_close' WHEN 2 THEN 'closed' WHEN 4 THEN 'superseded' END AS status", "d AS closed", "opened AS e_opened", "seeded AS e_seeded", "peak AS e_peak", "adds AS e_adds", "trims AS e_trims"]
    for c in _K:
        out += [f"k_{c} AS e_k_{c}", f"CASE WHEN b = 1 THEN g_{c} ELSE g_{c} + CASE WHEN {c} <> 0 AND k_{c} <> 0 THEN sh * ({c} - k_{c}) ELSE 0 END END AS e_g_{c}"]
    blank = "false AS open, NULL::DATE AS opened, false AS seeded, 0::DOUBLE AS sh, 0::DOUBLE AS peak, 0::BIGINT AS adds, 0::BIGINT AS trims, " + ", ".join(f"0::DOUBLE AS k_{c}, 0::DOUBLE AS g_{c}" for c in _K)
    ended = "NULL::VARCHAR AS status, NULL::DATE AS closed, NULL::DATE AS e_opened, NULL::BOOLEAN AS e_seeded, NULL::DOUBLE AS e_peak, NULL::BIGINT AS e_adds, NULL::BIGINT AS e_trims, " + ", ".join(f"NULL::DOUBLE AS e_k_{c}, NULL::DOUBLE AS e_g_{c}" for c in _K)
    step = "CASE WHEN kind = 'exit' AND NOT open THEN 0 WHEN kind = 'exit' AND c1 IS NULL THEN 1 WHEN kind = 'exit' THEN 2 WHEN c1 IS NULL THEN 0 WHEN NOT open THEN 3 WHEN kind = 'new' THEN 4 WHEN kind = 'add' THEN 5 WHEN kind = 'trim' THEN 6 ELSE 0 END"
    shown = lambda k, g: ", ".join(f"round({k}_{c} + 3e-6, 3) AS cost_{c}, round({g}_{c} + 3e-5, 2) + 0.0 AS gain_{c}" for c in _K)
    return f"""WITH RECURSIVE q AS (SELECT *, o_orderkey % 3 AS stock, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS k FROM orders),
m AS (SELECT o_custkey AS holder, stock, k AS rn, CAST(o_orderdate AS DATE) AS d, CASE (k + o_custkey) % 7 WHEN 0 THEN 'exit' WHEN 1 THEN 'new' WHEN 2 THEN 'add' WHEN 3 THEN 'trim' WHEN 4 THEN 'hold' WHEN 5 THEN 'add' ELSE 'trim' END AS kind,
 CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 50 + 1)::DOUBLE END AS shares, CASE WHEN o_orderkey % 19 > 0 THEN (o_orderkey % 23 - 4)::DOUBLE END AS change, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice / 1000 END AS c1,
 CASE WHEN o_orderkey % 11 > 0 THEN CASE WHEN o_orderkey % 5 > 1 THEN o_totalprice / 1100 ELSE o_totalprice / 1000 END END AS c2, CASE WHEN o_orderkey % 11 > 0 THEN CASE WHEN o_orderkey % 7 > 2 THEN o_totalprice / 900 ELSE o_totalprice / 1000 END END AS c3 FROM q),
s AS (SELECT DISTINCT holder, stock, 0::BIGINT AS rn, {blank}, {ended} FROM m UNION ALL SELECT holder, stock, rn, {", ".join(new)}, {", ".join(out)} FROM (SELECT s.holder, s.stock, m.rn, {_OLD}, d, kind, shares, change, c1, c2, c3, {step} AS b FROM s JOIN m ON m.holder = s.holder AND m.stock = s.stock AND m.rn = s.rn + 1))
SELECT holder, stock, e_opened AS opened, closed, status, e_seeded AS seeded, e_peak AS peak, e_adds AS adds, e_trims AS trims, {shown("e_k", "e_g")} FROM s WHERE status IS NOT NULL
UNION ALL SELECT holder, stock, opened, NULL, 'holding', seeded, peak, adds, trims, {shown("k", "g")} FROM s WHERE open AND rn = (SELECT max(rn) FROM m WHERE m.holder = s.holder AND m.stock = s.stock)"""


@query(_episodes_sql())
def holding_cost_episodes(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3).alias("stock"), F.to_date("o_orderdate").alias("d"))
    n, k = F.row_number().over(W.partitionBy("o_custkey", "stock").orderBy("d", "o_orderkey")), F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("exit", "new", "add", "trim", "hold", "add", "trim")])
    kind = F.get(kinds, ((n + F.col("o_custkey")) % 7).cast("int"))
    price = lambda by, here: F.when(here, F.col("o_totalprice") / by)
    moves = o.select(
        F.col("o_custkey").alias("holder"), "stock", "d", k.alias("seq"), kind.alias("kind"), F.when(k % 13 > 0, (k % 50 + 1).cast("double")).alias("shares"), F.when(k % 19 > 0, (k % 23 - 4).cast("double")).alias("change"),
        price(1000, k % 11 > 0).alias("c1"), F.when(k % 5 == 0, 0.0).otherwise(price(1100, k % 5 > 1)).alias("c2"), price(900, k % 7 > 2).alias("c3"),
    )
    e = H.cost_episodes(moves)
    return e.withColumns({f"cost_{c}": off(f"cost_{c}", 3) for c in _K} | {f"gain_{c}": F.round(F.col(f"gain_{c}") + 3e-5, 2) + 0.0 for c in _K})
