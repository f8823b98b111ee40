"""Queries that classify records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import matching as M
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# Old: lines of an order, those of every third order added up by flag. New: the lines, but for some first ones, and dust of some hundredths.
_SIDES = """old AS (SELECT l_orderkey AS g, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_orderkey % 3 <> 0),
new AS (SELECT l_orderkey AS g, l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_orderkey % 7 <> 0 OR l_linenumber > 1 UNION ALL SELECT l_orderkey, l_returnflag, 0.02 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1 UNION ALL SELECT l_orderkey, l_returnflag, 0.01 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 2),
k AS (SELECT *, least(n_old, n_new) AS n_exact, n_old - least(n_old, n_new) AS l, n_new - least(n_old, n_new) AS free, CAST(round(q * 100) AS BIGINT) AS c FROM (SELECT g, f, q, sum(o)::BIGINT AS n_old, sum(1 - o)::BIGINT AS n_new FROM (SELECT *, 1 AS o FROM old UNION ALL SELECT *, 0 FROM new) GROUP BY ALL)),
gr AS (SELECT g, sum(l) AS n_left, sum(free) AS n_free, sum(free * c) - sum(l * c) AS diff FROM k GROUP BY g HAVING sum(l) > 0),
fit AS (SELECT * FROM gr WHERE n_free >= greatest(n_left, 2) AND abs(diff) <= n_left),
cand AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY c, f, i) AS i FROM (SELECT k.g, k.f, c, unnest(range(free)) AS i FROM k JOIN fit USING (g) WHERE c BETWEEN 1 AND diff + 1)),
tried AS (SELECT g, 0::BIGINT AS i, 0::HUGEINT AS s, 0 AS n FROM fit UNION ALL SELECT t.g, cand.i, t.s + cand.c, t.n + 1 FROM tried t JOIN cand ON cand.g = t.g AND cand.i > t.i),
best AS (SELECT fit.g, any_value(n_free) - min(n) AS n_set FROM fit JOIN tried USING (g) WHERE abs(s - diff) <= 1 AND n_free - n >= 2 GROUP BY fit.g)"""


def _sides(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("n"))
    old = li.filter("g % 3 = 0").groupBy("g", "f").agg(F.sum("q").alias("q")).unionByName(li.filter("g % 3 <> 0").select("g", "f", "q"))
    dust = lambda m, n, q: li.filter(f"g % {m} = 0 AND n = {n}").select("g", "f", F.lit(q).alias("q"))
    return old, li.filter("g % 7 <> 0 OR n > 1").select("g", "f", "q").unionByName(dust(5, 1, 0.02)).unionByName(dust(10, 2, 0.01))


def _classified(spark, sf, **hints):
    old, new = _sides(spark, sf)
    return M.classify_keys(old, new, ["g", "f", "q"], ["g"], "q", **hints)


@query(f"""WITH RECURSIVE {_SIDES}
SELECT k.g, k.f, k.q, n_old, n_exact, CASE WHEN best.g IS NOT NULL THEN l ELSE 0 END AS n_merged, CASE WHEN best.g IS NULL THEN l ELSE 0 END AS n_residual, CASE WHEN l > 0 THEN n_set END AS n_parts,
CASE WHEN l = 0 THEN NULL WHEN best.g IS NOT NULL THEN 'merged' WHEN NOT EXISTS (SELECT 1 FROM new WHERE new.g = k.g AND new.f = k.f) THEN 'none' WHEN EXISTS (SELECT 1 FROM new WHERE new.g = k.g AND new.f = k.f AND abs(new.q - k.q) <= 5) THEN 'candidate_close' ELSE 'candidate' END AS left_as
FROM k LEFT JOIN best USING (g) WHERE n_old > 0""")
def recon_key_classes(spark, sf):
    return _classified(spark, sf, candidate=["g", "f"], close=(["q"], 5.0))[0]


@query(f"""WITH RECURSIVE {_SIDES}
SELECT k.g, sum(n_old)::BIGINT AS n_old, sum(n_exact)::BIGINT AS n_exact, sum(CASE WHEN best.g IS NOT NULL THEN l ELSE 0 END)::BIGINT AS n_merged, sum(CASE WHEN best.g IS NULL THEN l ELSE 0 END)::BIGINT AS n_residual, sum(n_new)::BIGINT AS n_new, coalesce(any_value(n_set), 0)::BIGINT AS n_part, true AS balanced FROM k LEFT JOIN best USING (g) GROUP BY k.g""")
def recon_key_balance(spark, sf):
    """Hints of residuals do not bear on sums, so none are asked for."""
    return M.balance(*_classified(spark, sf), ["g"])
