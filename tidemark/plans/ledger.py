"""Queries of ledgers and records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledger as G
from tidemark.plans.market import off
from tidemark.session import table
from tidemark.sources.bars import LINE_BARS_SQL, line_bars

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey + o_orderkey % 2 END AS o_custkey FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o.o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_custkey ELSE o.o_custkey END AS o_custkey, s.o_orderkey IS NOT NULL AND o.o_custkey IS DISTINCT FROM s.o_custkey AS changed FROM orders o LEFT JOIN s USING (o_orderkey)""")
def sink_update_changed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return G.update_changed(o, o.filter(k % 3 != 0).withColumn("o_custkey", F.when(k % 5 != 0, F.col("o_custkey") + k % 2)), ["o_orderkey"], "o_custkey")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag FROM lineitem GROUP BY 1")
def agg_constant_value(spark, sf):
    return G.constant_in(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT event_id, CASE WHEN hour(CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR) >= 16 THEN CAST(CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) END AS day FROM events")
def cal_snapshot_day(spark, sf):
    return table(spark, sf, "events").select("event_id", G.snapshot_day(F.col("ts"), 16).alias("day"))


@query(f"""WITH {LINE_BARS_SQL}, f AS (SELECT code, d, CASE WHEN (code + day(d)) % 6 > 0 THEN amount - 20000 END AS net FROM bars), m AS (SELECT s_suppkey AS code, DATE '1990-01-01' AS since, s_nationkey % 3 AS l1, s_nationkey % 6 AS l2, s_nationkey AS l3 FROM supplier UNION ALL SELECT s_suppkey, DATE '1995-01-01', s_nationkey % 2, s_nationkey % 4, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0),
a AS (SELECT f.code, f.d, net, arg_max(l1, since) AS l1, arg_max(l2, since) AS l2, arg_max(l3, since) AS l3 FROM f JOIN m ON m.code = f.code AND since <= d GROUP BY 1, 2, 3), u AS (SELECT 1 AS level, l1::VARCHAR AS name, d, net FROM a UNION ALL SELECT 2, l2::VARCHAR, d, net FROM a UNION ALL SELECT 3, l3::VARCHAR, d, net FROM a)
SELECT level, name, d, round(sum(net) * 1e4, 0) AS net, count(*) AS n_members, count(net) AS n_known FROM u GROUP BY 1, 2, 3""")
def flow_level_rollup(spark, sf):
    b = line_bars(spark, sf)
    f = b.select("code", "d", F.when((F.col("code") + F.dayofmonth("d")) % 6 > 0, F.col("amount") - 20000).alias("net"))
    s = table(spark, sf, "supplier")
    m = lambda day, k1, k2: s.select(F.col("s_suppkey").alias("code"), F.lit(day).cast("date").alias("since"), (F.col("s_nationkey") % k1).alias("l1"), (F.col("s_nationkey") % k2).alias("l2"), F.col("s_nationkey").alias("l3"))
    members = m("1990-01-01", 3, 6).unionByName(m("1995-01-01", 2, 4).filter("code % 2 = 0"))
    return G.level_rollup(members, f, ["l1", "l2", "l3"]).withColumn("net", F.round("net", 0))


_LEDGER_SQL = """ledger AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CASE o_orderkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'empty' ELSE 'partial' END AS status, o_orderkey % 4 AS missing, o_orderkey % 2 AS local_rows, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 HOUR AS fetched_at FROM orders),
fit AS (SELECT *, (status = 'complete' OR (status = 'empty' AND local_rows = 0)) AND missing = 0 AND CAST(fetched_at + INTERVAL 8 HOUR AS DATE) >= day + 3 AS ok FROM ledger)"""


def _ledger(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, "complete").when(k % 3 == 1, "empty").otherwise("partial")
    return table(spark, sf, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("day"), status.alias("status"), (k % 4).alias("missing"), (k % 2).alias("local_rows"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 20 HOURS")).alias("fetched_at"))


@query(f"WITH {_LEDGER_SQL} SELECT DISTINCT day FROM fit WHERE ok")
def ledger_settled_days(spark, sf):
    return G.settled_days(_ledger(spark, sf), 3)


@query(f"""WITH {_LEDGER_SQL}, w AS (SELECT *, min(CASE WHEN ok THEN fetched_at END) OVER (PARTITION BY day) AS f FROM fit)
SELECT day, count(*) AS fetches, date_diff('day', day, CAST(min(f) + INTERVAL 8 HOUR AS DATE)) AS settle_lag, count(*) FILTER (WHERE fetched_at > f AND missing > 0) AS late_missing FROM w GROUP BY day""")
def ledger_settle_statistics(spark, sf):
    return G.settle_statistics(_ledger(spark, sf), 3)


@query("""WITH e AS (SELECT * FROM (VALUES (DATE '1990-01-01', 2, ['1-URGENT']), (DATE '1995-01-01', 5, ['1-URGENT', '5-LOW'])) t(since, min_rows, required)), g AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS rows, list(DISTINCT o_orderpriority) AS groups FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
j AS (SELECT day, rows, groups, min_rows, required, row_number() OVER (PARTITION BY day ORDER BY since DESC) AS rn FROM g JOIN e ON since <= day)
SELECT day, rows, len(groups) AS n_groups, CASE WHEN rows < min_rows THEN 'BELOW_MIN_ROWS' ELSE 'MISSING_GROUP' END AS reason FROM j WHERE rn = 1 AND (rows < min_rows OR NOT list_has_all(groups, required))""")
def audit_incomplete_days(spark, sf):
    eras = spark.sql("SELECT * FROM VALUES (DATE '1990-01-01', 2, array('1-URGENT')), (DATE '1995-01-01', 5, array('1-URGENT', '5-LOW')) AS t(since, min_rows, required)")
    o = table(spark, sf, "orders").filter("o_orderdate IS NOT NULL").withColumn("day", F.to_date("o_orderdate"))
    return G.incomplete_days(o, "day", "o_orderpriority", eras)


@query("""WITH m AS (SELECT o_orderpriority AS part, o_orderkey % 3 AS batch FROM orders), p AS (SELECT part, max(batch) AS batch, count(*) FILTER (WHERE batch = 2) + (part LIKE '1%')::INT AS rows FROM m GROUP BY part)
SELECT p.part, p.batch, p.rows, count(m.batch) AS members, count(m.batch) = p.rows AS intact FROM p LEFT JOIN m ON m.part = p.part AND m.batch = p.batch GROUP BY 1, 2, 3""")
def land_member_parity(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("part"), (F.col("o_orderkey") % 3).alias("batch"))
    p = m.groupBy("part").agg(F.max("batch").alias("batch"), F.count(F.when(F.col("batch") == 2, 1)).alias("n")).select("part", "batch", (F.col("n") + F.col("part").like("1%").cast("int")).alias("rows"))
    return G.member_parity(p, m, ["part"])


@query("""WITH a AS (SELECT c_custkey, round(c_acctbal, 6) AS bal, c_nationkey::DOUBLE AS nat FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 0.01 ELSE 0 END, 6) END AS bal, c_nationkey::DOUBLE + (c_custkey % 13 = 0)::INT AS nat FROM customer WHERE c_custkey % 9 <> 0)
SELECT * FROM (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'only_old' WHEN a.c_custkey IS NULL THEN 'only_new' WHEN a.bal IS DISTINCT FROM b.bal OR a.nat IS DISTINCT FROM b.nat THEN 'changed' END AS kind, CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN CASE WHEN a.bal IS DISTINCT FROM b.bal THEN 'bal' WHEN a.nat IS DISTINCT FROM b.nat THEN 'nat' END END AS field FROM a FULL JOIN b ON a.c_custkey = b.c_custkey) WHERE kind IS NOT NULL""")
def recon_shadow_compare(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    old = c.filter(k % 7 != 0).select(k, F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nat"))
    bal = F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") + F.when(k % 5 == 0, 0.01).otherwise(0.0))
    new = c.filter(k % 9 != 0).select(k, bal.alias("bal"), (F.col("c_nationkey") + (k % 13 == 0).cast("int")).alias("nat"))
    return G.shadow_compare(old, new, ["c_custkey"], ["bal", "nat"])


@query("SELECT c_mktsegment, count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(regexp_full_match(c_nationkey::VARCHAR, '1[0-9].*'), false)) AS out_rows, count(DISTINCT c_nationkey) FILTER (WHERE NOT coalesce(regexp_full_match(c_nationkey::VARCHAR, '1[0-9].*'), false)) AS out_codes FROM customer GROUP BY 1")
def audit_out_of_scope(spark, sf):
    return G.outside(table(spark, sf, "customer"), "c_nationkey", "^1[0-9]", "c_mktsegment")


@query(f"""WITH {LINE_BARS_SQL}, x AS (SELECT code, d AS bottom, low, min(low) OVER a AS m, count(*) OVER a AS n, lead(d, 5) OVER (PARTITION BY code ORDER BY d) AS available FROM bars WINDOW a AS (PARTITION BY code ORDER BY d ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT code, bottom, available FROM x WHERE n = 11 AND low = m""")
def rally_setup_signals(spark, sf):
    return G.setup_signals(line_bars(spark, sf), 5)


@query(f"""WITH {LINE_BARS_SQL}, a AS (SELECT code, d, 1 + (code % 3) / 10.0 + CASE WHEN d >= DATE '1995-06-01' THEN 0.5 ELSE 0 END AS a, 2 + CASE WHEN d >= DATE '1995-06-05' AND code % 2 = 0 THEN 1.0 ELSE 0 END AS b FROM bars),
g AS (SELECT code, d, abs(a / first_value(a) OVER w / (b / first_value(b) OVER w) - 1) AS gap FROM a WINDOW w AS (PARTITION BY code ORDER BY d)), l AS (SELECT *, lag(gap) OVER (PARTITION BY code ORDER BY d) AS was FROM g)
SELECT code, d, round(gap + 3e-8, 5) AS gap, CASE WHEN code % 4 = 0 AND d BETWEEN DATE '1995-05-25' AND DATE '1995-06-14' THEN 'explained' WHEN was > 1e-4 THEN 'drift' ELSE 'unexplained' END AS cause FROM l WHERE gap > 1e-4""")
def price_factor_divergence(spark, sf):
    b = line_bars(spark, sf)
    ours = b.select("code", "d", (1 + (F.col("code") % 3) / 10.0 + F.when(F.col("d") >= "1995-06-01", 0.5).otherwise(0.0)).alias("factor"))
    theirs = b.select("code", "d", (2 + F.when((F.col("d") >= "1995-06-05") & (F.col("code") % 2 == 0), 1.0).otherwise(0.0)).alias("factor"))
    events = b.select("code").distinct().filter("code % 4 = 0").withColumn("ex", F.lit("1995-06-04").cast("date"))
    return G.factor_divergence(ours, theirs, events).select("code", "d", off("gap", 5).alias("gap"), "cause")
