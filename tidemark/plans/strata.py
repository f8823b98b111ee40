"""Queries of strata and matched samples, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import strata as T
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


_EDGES = [("short", 0), ("mid", 5), ("long", 12)]
_STRATA_SQL = f"""{LINE_BARS_SQL}, ep AS (SELECT code, d AS bottom, (code * 7 + day(d)) % 17 AS base_days FROM bars WHERE (code + day(d)) % 9 = 0),
mem AS (SELECT s_suppkey AS code, DATE '1993-01-01' AS since, DATE '1996-12-31' AS until, 'a' || s_nationkey % 3 AS sector FROM supplier UNION ALL SELECT s_suppkey, DATE '1996-06-01', CASE WHEN s_suppkey % 2 = 0 THEN DATE '1998-01-01' END, 'b' || s_nationkey % 2 FROM supplier),
seg AS (SELECT code, d, 'v' || month(d) % 2 AS regime FROM bars WHERE day(d) < 6 AND code % 4 > 0), st AS (SELECT code, d, 'p' || day(d) % 3 AS position FROM bars WHERE day(d) % 4 > 0),
strat AS (SELECT ep.*, (SELECT arg_max(sector, since) FROM mem WHERE mem.code = ep.code AND since <= bottom AND (until IS NULL OR until >= bottom)) AS sector, (SELECT arg_max(regime, d) FROM seg WHERE seg.code = ep.code AND seg.d <= bottom) AS regime, position,
 CASE WHEN base_days >= 12 THEN 'long' WHEN base_days >= 5 THEN 'mid' WHEN base_days >= 0 THEN 'short' END AS base_bucket FROM ep LEFT JOIN st ON st.code = ep.code AND st.d = ep.bottom)"""


def _strata(spark, sf):
    b = line_bars(spark, sf)
    day, k = F.dayofmonth("d"), F.col("code")
    ep = b.filter((k + day) % 9 == 0).select("code", F.col("d").alias("bottom"), ((k * 7 + day) % 17).alias("base_days"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
    span = lambda since, until, sector: s.select("code", F.lit(since).cast("date").alias("since"), until.cast("date").alias("until"), sector.alias("sector"))
    mem = span("1993-01-01", F.lit("1996-12-31"), F.concat(F.lit("a"), F.col("s_nationkey") % 3)).unionByName(span("1996-06-01", F.when(k % 2 == 0, "1998-01-01"), F.concat(F.lit("b"), F.col("s_nationkey") % 2)))
    seg = b.filter((day < 6) & (k % 4 > 0)).select("code", "d", F.concat(F.lit("v"), F.month("d") % 2).alias("regime"))
    st = b.filter(day % 4 > 0).select("code", "d", F.concat(F.lit("p"), day % 3).alias("position"))
    return T.stratified(ep, mem, seg, st, _EDGES, (["sector"], ["regime"], ["position"]))


@query(f"WITH {_STRATA_SQL} SELECT * FROM strat")
def rally_strata(spark, sf):
    return _strata(spark, sf)


@query(f"""WITH {_STRATA_SQL}, pos AS (SELECT * FROM strat WHERE code % 3 = 0), neg AS (SELECT * FROM strat WHERE code % 3 = 1), q AS (SELECT sector, base_bucket, count(*) AS n FROM pos GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY sector, base_bucket ORDER BY sha256('one' || chr(31) || code || chr(31) || bottom::VARCHAR), code, bottom) AS place FROM neg)
SELECT r.code, r.bottom, r.sector, r.base_bucket, place::INTEGER AS place FROM r JOIN q ON q.sector IS NOT DISTINCT FROM r.sector AND q.base_bucket IS NOT DISTINCT FROM r.base_bucket WHERE place <= ceil(n * 0.5)""")
def rally_matched_negatives(spark, sf):
    """Half as many counterparts as there are positives, stratum by stratum."""
    s = saved(_strata(spark, sf), "strata")
    chosen, _ = T.matched(s.filter("code % 3 = 0"), s.filter("code % 3 = 1"), ["sector", "base_bucket"], 0.5, ["code", "bottom"], "one")
    return chosen.select("code", "bottom", "sector", "base_bucket", F.col("n_in_stratum").alias("place"))


@query(f"""WITH {_STRATA_SQL}, x AS (SELECT * FROM strat WHERE code % 10 > 0 UNION ALL SELECT * FROM strat WHERE code % 10 = 1), g AS (SELECT code, bottom, count(*) AS n FROM x GROUP BY 1, 2)
SELECT 'base' AS "check", count(*) FILTER (WHERE NOT coalesce(base_days >= 2, false)) AS bad FROM x UNION ALL SELECT 'sector', count(*) FILTER (WHERE sector IS NULL) FROM x UNION ALL SELECT 'in_time', count(*) FILTER (WHERE bottom > DATE '1998-06-30') FROM x
UNION ALL SELECT 'repeated', count(*) FROM g WHERE n > 1 UNION ALL SELECT 'missing', count(*) FROM ep ANTI JOIN g USING (code, bottom) UNION ALL SELECT 'unexpected', count(*) FROM g ANTI JOIN ep USING (code, bottom)""")
def rally_landing_checks(spark, sf):
    """Strata with a tenth of the codes lost and a tenth doubled."""
    s = saved(_strata(spark, sf), "strata")
    x = s.filter("code % 10 > 0").unionByName(s.filter("code % 10 = 1"))
    checks = {"base": F.col("base_days") >= 2, "sector": F.col("sector").isNotNull(), "in_time": F.col("bottom") <= F.lit("1998-06-30").cast("date")}
    return T.landing_checks(x, checks, ["code", "bottom"], s.select("code", "bottom"))
