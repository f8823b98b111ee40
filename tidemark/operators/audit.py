"""Landing, validation, reconciliation, continuity and lineage operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import windows as X
from tidemark.session import saved


def payload_hash(*cols: str) -> Column:
    """SHA-256 of the row's JSON; a NULL column is left out, so the hash is stable under trailing nulls."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def land(df: DataFrame, batch: str, key: list[str]) -> DataFrame:
    """Rows as landed: batch, payload (JSON), row_hash, and the grain as text."""
    return df.select(F.lit(batch).alias("batch_id"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("grain"), F.to_json(F.struct(*df.columns)).alias("payload"), payload_hash(*df.columns).alias("row_hash"))


def reject_codes(df: DataFrame, rules: list[tuple[str, Column]], grain: list[str]) -> DataFrame:
    """df with reject_code: the first rule that fails, then DUPLICATE_GRAIN; NULL for rows that pass."""
    code = None
    for name, bad in rules:
        bad = F.coalesce(bad, F.lit(False))
        code = F.when(bad, name) if code is None else code.when(bad, name)
    twice = F.count(F.lit(1)).over(W.partitionBy(*grain)) > 1
    return df.withColumn("_n", twice).withColumn("reject_code", code.when(F.col("_n"), "DUPLICATE_GRAIN")).drop("_n")


def batch_verdict(checked: DataFrame, batch: list[str], least: int) -> DataFrame:
    """By batch: rows, rejected rows, the most frequent code (of ties the first by name), and ACCEPTED or the reason against it."""
    g = checked.groupBy(*batch).agg(F.count(F.lit(1)).alias("rows"), F.count("reject_code").alias("rejected"), F.mode("reject_code", True).alias("first_code"))
    return g.withColumn("verdict", F.when(F.col("rejected") > 0, F.col("first_code")).when(F.col("rows") < least, "BELOW_MIN_ROWS").otherwise("ACCEPTED"))


def accept(canonical: DataFrame, batch: DataFrame, partition: list[str]) -> DataFrame:
    """The canonical table with the batch's partitions replaced: what was there before goes, whatever its rows."""
    return canonical.join(batch.select(*partition).distinct(), partition, "left_anti").unionByName(batch)


def set_similarity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes of two code sets, what they share, and Jaccard."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    g = both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("shared"), F.count(F.lit(1)).alias("n_either"))
    return g.withColumn("jaccard", F.col("shared") / F.nullif(F.col("n_either"), F.lit(0))).drop("n_either")


def near(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Within the larger of an absolute tolerance and a share of the larger value; NULL on either side is not near."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))), F.lit(False))


def bar_reconciliation(left: DataFrame, right: DataFrame, key: list[str], value: str, floor: float = 1e-6, share: float = 1e-4) -> DataFrame:
    """By day: bars on both sides, only left, only right, mismatches, and the median ratio that tells units apart."""
    a, b = left.select(*key, F.col(value).alias("a")), right.select(*key, F.col(value).alias("b"))
    j = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    bad = both & (F.abs(F.col("a") - F.col("b")) > F.greatest(F.lit(floor), F.abs("b") * share))
    return j.groupBy("d").agg(
        F.count(F.when(both, 1)).alias("both"), F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"), F.count(F.when(bad, 1)).alias("mismatches"), F.median(F.when(both, F.col("a") / F.nullif(F.col("b"), F.lit(0.0)))).alias("ratio")
    )


def duplicate_grain(df: DataFrame, grain: list[str]) -> DataFrame:
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def calendar_gaps(df: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """(key, gap_after, gap_until, missing): trading days between two neighbouring rows of a key that it lacks."""
    n = df.select(key, "d").distinct().join(F.broadcast(calendar), "d")
    w = W.partitionBy(key).orderBy("n")
    g = n.select(key, F.col("d").alias("gap_after"), F.lead("d").over(w).alias("gap_until"), (F.lead("n").over(w) - F.col("n") - 1).cast("long").alias("missing"))
    return g.filter("missing > 0")


def row_dips(df: DataFrame, day: str, n: int = 7, below: float = 0.5) -> DataFrame:
    """(d, rows, usual, severity): daily row counts against the median of the n days before."""
    c = df.groupBy(F.col(day).alias("d")).agg(F.count(F.lit(1)).alias("rows")).withColumn("_k", F.lit(0))
    usual = X.rolling_median("rows", ["_k"], ["d"], n)
    w = X.over(["_k"], ["d"], -n, -1)
    steady = F.stddev_samp("rows").over(w) / F.nullif(F.avg("rows").over(w), F.lit(0.0)) < 0.25
    c = c.withColumn("usual", usual).withColumn("_steady", steady)
    sev = F.when(F.coalesce(F.col("rows") >= below * F.col("usual"), F.lit(True)), "none").when(F.col("_steady"), "high").otherwise("low")
    return c.select("d", "rows", "usual", sev.alias("severity"))


def watermark(df: DataFrame, group: str, day: str, calendar: DataFrame, sla: int) -> DataFrame:
    """By group: latest day, lag in trading days behind the calendar's last, and whether it is within the sla."""
    last = df.groupBy(group).agg(F.max(day).alias("latest"))
    end = calendar.agg(F.max("n").alias("_end"))
    j = last.join(F.broadcast(calendar), F.col("latest") == F.col("d"), "left").join(F.broadcast(end), F.lit(True))
    return j.select(group, "latest", (F.col("_end") - F.col("n")).cast("long").alias("lag"), (F.col("_end") - F.col("n") <= sla).alias("within_sla"))


def state_diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, before, after, change): joined, left or changed; unchanged keys are not there."""
    a, b = before.select(*key, F.col(value).alias("before"), F.lit(1).alias("_a")), after.select(*key, F.col(value).alias("after"), F.lit(1).alias("_b"))
    j = a.join(b, key, "full")
    change = F.when(F.col("_a").isNull(), "joined").when(F.col("_b").isNull(), "left").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return j.select(*key, "before", "after", change.alias("change")).filter("change IS NOT NULL")


def frontier_append(table: DataFrame, new: DataFrame, key: str, day: str) -> DataFrame:
    """The new rows beyond each key's last day in the table; keys it does not have come whole."""
    last = table.groupBy(key).agg(F.max(day).alias("_f"))
    return new.join(last, key, "left").filter(F.col("_f").isNull() | (F.col(day) > F.col("_f"))).drop("_f")


def merge_on_grain(table: DataFrame, new: DataFrame, grain: list[str]) -> DataFrame:
    """Upsert: rows of new replace those of the same grain."""
    return table.join(new.select(*grain).distinct(), grain, "left_anti").unionByName(new)


def lineage_impact(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance) of everything downstream within `depth` steps; edges (src, dst) of tables, so a small graph."""
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = saved(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(k)), "lineage")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("distance > 0")


def retention_plan(batches: DataFrame, pointers: DataFrame, key: str, batch: str, status: str, at: str) -> DataFrame:
    """(batch, plan): keep pointed batches, the latest accepted one of a key without a pointer, and those in flight."""
    b = batches.join(pointers.select(F.col(batch), F.lit(True).alias("_p")).distinct(), batch, "left")
    has = F.max(F.coalesce("_p", F.lit(False))).over(W.partitionBy(key))
    rank = F.row_number().over(W.partitionBy(key, status).orderBy(F.desc(at), F.desc(batch)))
    b = b.withColumn("_has", has).withColumn("_rk", rank)
    keep = F.coalesce("_p", F.lit(False)) | (F.col(status) == "landed") | ((F.col(status) == "accepted") & ~F.col("_has") & (F.col("_rk") == 1))
    return b.select(batch, key, status, F.when(keep, "keep").when(F.col(status) == "accepted", "archive").otherwise("drop").alias("plan"))


def invariants(spark, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): each rule is a query whose rows are violations. Views must be registered before."""
    out = None
    for name, sql in rules.items():
        one = spark.sql(f"SELECT '{name}' AS rule, count(*) AS violations FROM ({sql})")
        out = one if out is None else out.unionByName(one)
    return out


def split_match(old: DataFrame, new: DataFrame, group: list[str], amount: str) -> DataFrame:
    """By group: exact when sums and counts agree, merged when only the sums do, else residual."""
    a = old.groupBy(*group).agg(F.round(F.sum(amount), 2).alias("old_sum"), F.count(F.lit(1)).alias("old_n"))
    b = new.groupBy(*group).agg(F.round(F.sum(amount), 2).alias("new_sum"), F.count(F.lit(1)).alias("new_n"))
    same = F.coalesce(F.abs(F.col("old_sum") - F.col("new_sum")) <= 0.01, F.lit(False))
    kind = F.when(same & (F.col("old_n") == F.col("new_n")), "exact").when(same, "merged").otherwise("residual")
    return a.join(b, group, "full").withColumn("kind", kind)


def validity_spans(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Spans cut at the next start of the same key; those left empty are dropped."""
    w = W.partitionBy(key).orderBy(start, tie)
    nxt = F.lead(start).over(w)
    cut = F.when(nxt.isNotNull() & (F.col(end).isNull() | (F.col(end) > nxt)), nxt).otherwise(F.col(end))
    return df.withColumn("valid_to", cut).filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col(start)))
