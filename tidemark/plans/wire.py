"""Queries of decoders over bytes made from the tables, each beside its SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.session import table
from tidemark.sources import wire

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _encoded(df, column: str):
    """df (key, array of longs) with the array as bytes of the protocol."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wire.encode_numbers(x) for x in b.column(1).to_pylist()], pa.binary())], names=["code", "raw"])

    return df.select("code", column).mapInArrow(run, "code long, raw binary")


@query("""WITH p AS (SELECT o_custkey AS code, list(CAST(round(o_totalprice * 100) AS BIGINT) ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY 1)
SELECT code, k AS pos, l[k] AS cents FROM (SELECT code, l, unnest(range(1, len(l) + 1)) AS k FROM p)""")
def wire_running_deltas(spark, sf):
    """Order values of each customer, sent as deltas and summed up again."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.struct("o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v")).alias("x"))
    l = o.groupBy("code").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias("l"))
    deltas = F.transform(F.col("l"), lambda v, k: v - F.when(k > 0, F.try_element_at("l", k)).otherwise(0))
    d = wire.numbers(_encoded(l.withColumn("deltas", deltas), "deltas"), "raw").filter("numbers_problem IS NULL")
    return d.select("code", F.posexplode(wire.running(F.col("numbers"))).alias("pos", "cents")).withColumn("pos", F.col("pos") + 1)
