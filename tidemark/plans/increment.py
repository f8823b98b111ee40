"""Queries of incremental builds, acceptance and proofs, each beside its SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import flow as L
from tidemark.operators import increment as I
from tidemark.operators import price as P
from tidemark.operators import proof
from tidemark.operators import windows as X
from tidemark.plans import market
from tidemark.plans.market import off
from tidemark.session import in_tasks, run_dir, saved, table
from tidemark.sources.acceptance import Contract, Store
from tidemark.sources.bars import LINE_BARS_SQL, line_bars

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


#: Rows that the panel's windows reach back: 40 before today for z, and the close before the first of them. Late days are looked at again.
BACK, LATE = 41, 20


def annotated(source: DataFrame) -> DataFrame:
    """The annotated panel of (code, d, close, net)."""
    pct = (F.col("close") / F.nullif(F.lag("close").over(W.partitionBy("code").orderBy("d")), F.lit(0.0)) - 1) * 100
    return L.annotate(source.withColumn("pct", pct), ["code"], prior=40, run=3).select("code", "d", "streak", "z", "px_cum", "cum_net", "cum_cnt", "regime")


def _source(spark, sf):
    return market._flow(spark, sf).select("code", "d", "close", "net")


def _before(source: DataFrame) -> DataFrame:
    """What was there before: nothing from June on, and a fifth of the codes late from the last third of May on."""
    return source.filter("d < DATE '1998-06-01' AND NOT (code % 5 = 0 AND d >= DATE '1998-05-20')")


def _grown(spark, sf):
    """(source, panel before, due days, increment)."""
    source = saved(_source(spark, sf), "flow-source")
    panel = saved(annotated(_before(source)), "flow-panel")
    due = saved(I.due_days(source, panel, LATE), "due-days")
    rows = I.increment(annotated, source, due, ["code"], BACK, X.sign(F.col("net")), 1)
    return source, panel, due, rows


_BEFORE_SQL = f"{market._NET}, before AS (SELECT code, d FROM flow WHERE d < DATE '1998-06-01' AND NOT (code % 5 = 0 AND d >= DATE '1998-05-20')), have AS (SELECT DISTINCT d FROM before), due AS (SELECT DISTINCT d FROM flow WHERE d NOT IN (SELECT d FROM have) UNION SELECT d FROM (SELECT d FROM have ORDER BY d DESC LIMIT 20))"


@query(f"{_BEFORE_SQL} SELECT d FROM due")
def flow_due_days(spark, sf):
    source = _source(spark, sf)
    return I.due_days(source, _before(source), LATE)


@query(market.ORACLE["flow_annotate"])
def flow_panel_increment(spark, sf):
    _, panel, due, rows = _grown(spark, sf)
    return I.taken_in(panel, rows, due).select("code", "d", "streak", off("z", 3).alias("z"), F.round("cum_net", 2).alias("cum_net"), "cum_cnt", "regime")


@query(f"{_BEFORE_SQL}, n AS (SELECT count(*) AS n FROM flow) SELECT n AS rows_left, n AS rows_right, 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right, 0::BIGINT AS null_grains, 0::BIGINT AS only_left, 0::BIGINT AS only_right, true AS equal FROM n")
def flow_panel_proof(spark, sf):
    source, panel, due, rows = _grown(spark, sf)
    return proof.panel_proof(I.taken_in(panel, rows, due), annotated(source), ["code", "d"])


@query(f"""{_BEFORE_SQL}, s AS (SELECT code, d, code % 3 AS g FROM flow JOIN due USING (d)), r AS (SELECT * FROM s WHERE NOT (code % 11 = 0 AND d >= DATE '1998-07-01') UNION ALL SELECT * FROM s WHERE code % 13 = 0 AND d < DATE '1998-06-10' UNION ALL SELECT code + 100000, d, 0 FROM s WHERE code % 17 = 0),
k AS (SELECT code, d, count(*) FILTER (WHERE t = 'r') AS r, count(*) FILTER (WHERE t = 's') AS s, count(*) FILTER (WHERE t = 'p') AS p FROM (SELECT code, d, 'r' AS t FROM r UNION ALL SELECT code, d, 's' FROM s UNION ALL SELECT code, d, 'p' FROM before JOIN due USING (d)) GROUP BY 1, 2),
fl AS (SELECT count(*) AS n FROM (SELECT due.d, x.g, count(r.code) AS n FROM due CROSS JOIN (VALUES (0, 3), (1, 4)) x(g, least) LEFT JOIN r ON r.d = due.d AND r.g = x.g GROUP BY due.d, x.g, x.least HAVING count(r.code) < x.least))
SELECT 'null_grain' AS problem, 0::BIGINT AS count UNION ALL SELECT 'repeated_grain', count(*) FROM k WHERE r > 1 UNION ALL SELECT 'missing_key', count(*) FROM k WHERE s > 0 AND r = 0 UNION ALL SELECT 'unexpected_key', count(*) FROM k WHERE r > 0 AND s = 0
UNION ALL SELECT 'lost_key', count(*) FROM k WHERE p > 0 AND r = 0 UNION ALL SELECT 'empty', count(*) FROM due WHERE d NOT IN (SELECT d FROM r) UNION ALL SELECT 'below_floor', n FROM fl""")
def flow_panel_verdict(spark, sf):
    """A batch with faults of each kind: codes left out, repeated and made up."""
    source = _source(spark, sf)
    due = I.due_days(source, _before(source), LATE)
    s = source.select("code", "d", (F.col("code") % 3).alias("g"))
    k = F.col("code")
    rows = s.filter(~((k % 11 == 0) & (F.col("d") >= "1998-07-01"))).unionByName(s.filter((k % 13 == 0) & (F.col("d") < "1998-06-10"))).unionByName(s.filter(k % 17 == 0).withColumns({"code": k + 100000, "g": F.lit(0).cast("long")}))
    rows = rows.join(F.broadcast(due), "d", "left_semi").withColumn("g", F.col("g").cast("int"))
    return I.batch_verdict(rows, _before(source), source.select("code", "d"), due, ["code", "d"], "g", {0: 3, 1: 4})


@query(f"{market._NET}, c AS (SELECT code, d, max(CASE WHEN code % 5 = 0 AND d BETWEEN DATE '1998-05-20' AND DATE '1998-05-31' THEN 1 END) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 41 PRECEDING AND CURRENT ROW) AS hit FROM flow) SELECT DISTINCT d FROM c WHERE hit = 1")
def flow_touched_days(spark, sf):
    source = _source(spark, sf)
    return I.touched_days(source, source.filter("code % 5 = 0 AND d BETWEEN DATE '1998-05-20' AND DATE '1998-05-31'"), ["code"], BACK)


# --- proofs on cut inputs

_CUTS = [dt.date(1996, 7, 15), dt.date(1997, 9, 30)]
_CUT_ROWS = "SELECT x.cut, count(*) FILTER (WHERE bars.d <= x.cut) AS rows, 0::BIGINT AS only_cut, 0::BIGINT AS only_full, NULL::DATE AS first_gap FROM bars, (VALUES (DATE '1996-07-15'), (DATE '1997-09-30')) x(cut) GROUP BY x.cut"


def _cut(plan, inputs, cuts=_CUTS):
    return proof.cut_proof(plan, inputs, cuts, "d").drop("examples")


@query(f"WITH {LINE_BARS_SQL} {_CUT_ROWS}")
def pit_proof_flow(spark, sf):
    return _cut(lambda t: annotated(t["bars"]), {"bars": (_source(spark, sf), "d")})


@query(f"WITH {LINE_BARS_SQL} {_CUT_ROWS}")
def pit_proof_price(spark, sf):
    """Adjustment ratios and backward factors, which must not change when later bars are there."""
    rows = table(spark, sf, "lineitem").count()  # no fewer than bars
    plan = lambda t: P.backward_factor(P.adjustment_ratio(in_tasks(t["bars"], rows, "code"))).select("code", "d", F.round("hfq", 8).alias("hfq"))
    b = in_tasks(line_bars(spark, sf), rows, "code").select("code", "d", "close", F.lag("close").over(W.partitionBy("code").orderBy("d")).alias("pre_close"))
    return _cut(plan, {"bars": (b, "d")})


@query(f"""WITH {LINE_BARS_SQL}, y AS (SELECT x.cut, code, d, CASE WHEN lead(d) OVER w <= x.cut THEN lead(close) OVER w END AS c, lead(close) OVER w AS f FROM bars, (VALUES (DATE '1996-07-15'), (DATE '1997-09-30')) x(cut) WINDOW w AS (PARTITION BY x.cut, code ORDER BY d))
SELECT cut, count(*) AS rows, count(*) FILTER (WHERE c IS DISTINCT FROM f) AS only_cut, count(*) FILTER (WHERE c IS DISTINCT FROM f) AS only_full, min(d) FILTER (WHERE c IS DISTINCT FROM f) AS first_gap FROM y WHERE d <= cut GROUP BY cut""")
def pit_proof_planted(spark, sf):
    """A plan that looks at the next bar, and is caught."""
    plan = lambda t: t["bars"].select("code", "d", F.lead("close").over(W.partitionBy("code").orderBy("d")).alias("next"))
    return _cut(plan, {"bars": (line_bars(spark, sf).select("code", "d", "close"), "d")})


# --- acceptance

_AT = dt.datetime(2020, 1, 2, 9, tzinfo=dt.timezone.utc)
_PARTS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')), a AS (SELECT o_orderpriority AS partition, CASE WHEN o_orderpriority = '2-HIGH' THEN 'second-' ELSE 'first-' END || o_orderpriority AS batch, count(*) FILTER (WHERE o_orderpriority <> '2-HIGH' OR o_orderkey % 2 = 0) AS rows FROM o GROUP BY 1, 2)
SELECT partition, batch, rows, rows AS members, true AS intact FROM a WHERE rows > 0""")
def land_store_members(spark, sf):
    """Batches of orders landed twice, accepted, replaced or turned down, read by their pointers.

    The second batch of 2-HIGH replaces the first; that of 5-LOW repeats grains and is rejected, so the first stays.
    """
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    contract = Contract("orders", "v1", "o_orderpriority", ["o_orderkey"], [("NULL_KEY", F.col("o_orderkey").isNull())])
    store = Store(spark, f"{run_dir(spark)}/store-{uuid.uuid4().hex}", contract)
    put = lambda batch, part, rows: store.accept(store.land(batch, rows, part, "orders", _AT, _AT))
    for part in _PARTS:
        rows = o.filter(F.col("o_orderpriority") == part)
        if rows.isEmpty():
            continue
        for _ in range(2):
            put(f"first-{part}", part, rows)
        if part == "2-HIGH":
            put(f"second-{part}", part, rows.filter("o_orderkey % 2 = 0"))
        if part == "5-LOW":
            put(f"second-{part}", part, rows.unionByName(rows))
    return store.parity()
