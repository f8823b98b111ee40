"""Queries of scalar functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


@query(r"""SELECT p_partkey, substr(p_name, 1, 4) AS head, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS padded, split_part(p_type, ' ', 1) AS first_word, upper(trim(p_brand)) AS brand, length(p_name) AS n, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') AS low_brand, replace(p_brand, '#', '-') AS dashed FROM part""")
def scalar_strings(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.substring("p_name", 1, 4).alias("head"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("padded"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"), F.upper(F.trim("p_brand")).alias("brand"), F.length("p_name").cast("long").alias("n"),
        F.col("p_brand").rlike("^Brand#[1-3][0-9]$").alias("low_brand"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("dashed"),
    )


@query(r"""SELECT o_orderkey, regexp_replace(t, '[+-]?[0-9]+\.[0-9]+', '{v}', 'g') AS canonical FROM (SELECT o_orderkey, 'paid ' || printf('%.2f', o_totalprice) || ' of order ' || o_orderkey AS t FROM orders)""")
def scalar_canonical_decimals(spark, sf):
    t = F.concat(F.lit("paid "), F.format_string("%.2f", F.col("o_totalprice")), F.lit(" of order "), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", S.canonical_decimals(t).alias("canonical"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal / c_nationkey + 3e-7, 4) + 0.0 END AS ratio, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal) + 3e-8, 5) END AS log_bal, greatest(least(c_acctbal, 5000.0), 0.0) AS clamped, round(abs(c_acctbal), 1) >= 0 AS ok FROM customer")
def scalar_guarded_math(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.round(S.ratio(b, F.col("c_nationkey")) + 3e-7, 4).alias("ratio"), F.round(S.log_or_null(b) + 3e-8, 5).alias("log_bal"), S.clamp(b, 0.0, 5000.0).alias("clamped"), (F.round(F.abs(b), 1) >= 0).alias("ok"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS parsed FROM events")
def scalar_json_and_try_cast(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("x1")).otherwise(F.col("event_id").cast("string"))
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), raw.alias("raw"))
    return e.select("event_id", "k", S.number(F.col("raw")).alias("parsed"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' WHEN regexp_full_match(p_type, '.*STEEL.*') THEN 'steel' WHEN regexp_full_match(p_type, '.*(TIN|BRASS)') THEN 'light' ELSE 'other' END AS class, p_brand IS NULL OR p_brand NOT IN ('Brand#11', 'Brand#22') AS kept FROM part")
def scalar_facets(spark, sf):
    t = F.when(F.col("p_size") == 1, F.lit("@one")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", S.facet(t, {"@one": "one"}, {".*STEEL.*": "steel", ".*(TIN|BRASS)": "light"}, "other").alias("class"), S.keep_unless(F.col("p_brand"), ["Brand#11", "Brand#22"]).alias("kept"))
