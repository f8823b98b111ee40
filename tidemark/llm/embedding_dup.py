"""Embedding near-dedup by an exact metric range join.

Unit vectors with a cosine of at least c lie within r = sqrt(2 - 2 c) of each other. Within each label, pivots part the
vectors into cells (each vector lives in the cell of its nearest pivot). By the triangle inequality a neighbour of x
can live in another cell j only if d(x, p_j) <= d(x, p_home) + 2 r, and by the same argument on the bisecting
hyperplane only if (d(x, p_j)^2 - d(x, p_home)^2) / (2 d(p_home, p_j)) <= r; x is sent as a guest to those cells with a
number below its home's, so every pair meets exactly once. Cells are joined independently, in pairs of blocks of at
most about BLOCK rows, and give sums of links and local trees, never pairs. Equal vectors count as one with a
multiplicity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import saved

#: Rows for each pivot at least, and pivots in all at most: they are broadcast, dim x 8 bytes each.
CELL, MAX_PIVOTS, BLOCK = 2000, 4096, 2048
#: Distances of rows to pivots that are held at once: five arrays of 8 bytes each, some 40 MB.
GAPS = 1 << 20


def unit_rows(col: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Which vectors are valid, and their unit vectors as float64 bytes (b'' if not)."""
    ok, out = np.zeros(len(col), bool), []
    col = col.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(col.type) else col.cast(pa.large_list(pa.float64()))
    for i, v in enumerate(col):
        x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and len(v.values) and not v.values.null_count else None
        if x is not None and np.isfinite(x).all():
            top = np.abs(x).max()
            if top > 0:
                x = x / top  # so that squares neither overflow nor vanish
                ok[i] = True
                out.append((x / np.sqrt(np.dot(x, x))).tobytes())
                continue
        out.append(b"")
    return ok, out


def _prepared(vecs: DataFrame) -> DataFrame:
    """(vec_id, label, node, dim, unit): node names (label, vector); null where a vector links with nothing."""

    def run(batches):
        for batch in batches:
            ok, unit = unit_rows(batch.column(3))
            bad = pa.array(~ok)
            node = pa.compute.if_else(bad, pa.scalar(None, pa.int64()), batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), node, pa.array([len(u) // 8 for u in unit], pa.int32()), pa.array(unit, pa.binary())], names=["vec_id", "label", "node", "dim", "unit"]
            )

    src = vecs.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.when(F.col("label").isNotNull(), F.xxhash64("label", "embedding")).alias("node"), F.col("embedding"))
    return src.mapInArrow(run, "vec_id long, label string, node long, dim int, unit binary")


def _cells(reps: DataFrame, r: float) -> DataFrame:
    """(label, dim, cell, home, node, mult, unit): every vector at home and as a guest."""
    spark = reps.sparkSession
    sizes = reps.groupBy("label", "dim").count()
    total = reps.count()
    per = max(CELL, -(-total // (MAX_PIVOTS // 2)))
    big = sizes.filter(F.col("count") > per).withColumn("want", F.ceil(F.col("count") / per))  # at most MAX_PIVOTS / 2 groups
    chance = F.col("want") * 2.0 / F.col("count")
    drawn = (
        reps.join(F.broadcast(big), ["label", "dim"])
        .withColumn("u", (F.shiftrightunsigned(F.xxhash64("node"), 11)) * F.lit(2.0**-53))
        .filter(F.col("u") < chance)
        .select("label", "dim", "u", "node", "unit")
    )
    pivots: dict[tuple, list] = {}
    for row in drawn.orderBy("u", "node").limit(MAX_PIVOTS).collect():
        pivots.setdefault((row["label"], row["dim"]), []).append(np.frombuffer(row["unit"]))
    table = {k: np.stack(v) for k, v in pivots.items() if len(v) > 1}
    gaps = {k: np.sqrt(np.maximum(2 - 2 * p @ p.T, 0)) for k, p in table.items()}
    b = spark.sparkContext.broadcast((table, gaps))

    def run(batches):
        table, gaps = b.value
        for batch in batches:
            pdf = batch.to_pandas()
            for key, whole in pdf.groupby(["label", "dim"], sort=False):
                p = table.get((key[0], int(key[1])))
                step = len(whole) if p is None else max(1, GAPS // len(p))
                for lo in range(0, len(whole), step):
                    part = whole.iloc[lo : lo + step]
                    if p is None:
                        cell, row, home = np.zeros(len(part), np.int64), np.arange(len(part)), np.ones(len(part), bool)
                    else:
                        x = np.frombuffer(b"".join(part["unit"])).reshape(len(part), -1)
                        d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
                        at = d.argmin(axis=1)
                        own = d[np.arange(len(x)), at][:, None]
                        gap = gaps[(key[0], int(key[1]))][at]
                        eps = 1e-7  # rounding never loses a guest
                        guest = (d <= own + 2 * r + eps) & (d * d - own * own <= 2 * gap * (r + eps) + eps)
                        guest &= np.arange(len(p))[None, :] < at[:, None]
                        row, cell = np.nonzero(guest)
                        row, cell, home = np.concatenate([np.arange(len(x)), row]), np.concatenate([at, cell]), np.arange(len(x) + len(row)) < len(x)
                    out = part.iloc[row].assign(cell=cell.astype(np.int64), home=home)[["label", "dim", "cell", "home", "node", "mult", "unit"]]
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return reps.select("label", "dim", "node", "mult", "unit").mapInArrow(run, "label string, dim int, cell long, home boolean, node long, mult long, unit binary")


def _local_roots(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node that links of this block pair reach, for the rows a and the columns b."""
    la, lb = a.copy(), b.copy()
    ra, cb = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    m = mask[np.ix_(ra, cb)]
    top = np.iinfo(np.int64).max
    while len(ra):
        na = np.minimum(la[ra], np.where(m, lb[cb][None, :], top).min(axis=1))
        nb = np.minimum(lb[cb], np.where(m, na[:, None], top).min(axis=0))
        if (na == la[ra]).all() and (nb == lb[cb]).all():
            break
        la[ra], lb[cb] = na, nb
    return la, lb


def _joined(cells: DataFrame, least: float) -> DataFrame:
    """(node, links, root): links found in one pair of blocks, and the smallest node reached there."""
    sizes = cells.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).alias("nh"), F.ceil(F.sum((~F.col("home")).cast("long")) / BLOCK).alias("ng")
    )
    placed = cells.join(sizes, ["label", "dim", "cell"]).filter("nh > 0")
    spot = F.xxhash64("node", "cell")
    homes = placed.filter("home").withColumn("blk", F.pmod(spot, F.col("nh"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nh") + F.col("ng") - 1)))
    # pairs of blocks (i, j): i <= j < nh for homes, j >= nh for guests
    homes = homes.withColumn("i", F.when(F.col("to") < F.col("nh"), F.least("blk", "to")).otherwise(F.col("blk"))).withColumn("j", F.when(F.col("to") < F.col("nh"), F.greatest("blk", "to")).otherwise(F.col("to")))
    guests = placed.filter("NOT home").withColumn("blk", F.pmod(spot, F.col("ng")) + F.col("nh")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nh") - 1))).withColumn("j", F.col("blk"))
    cols = ["label", "dim", "cell", "i", "j", "blk", "node", "mult", "unit"]
    dealt = homes.select(*cols).unionByName(guests.select(*cols))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x = np.frombuffer(b"".join(pdf["unit"])).reshape(len(pdf), -1)
        node, mult, blk = pdf["node"].to_numpy(), pdf["mult"].to_numpy(), pdf["blk"].to_numpy()
        a, b = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        mask = x[a] @ x[b].T >= least
        if i == j:
            np.fill_diagonal(mask, False)
            links, root = mask @ mult[a], _local_roots(mask, node[a], node[a])[0]
            out = pd.DataFrame({"node": node[a], "links": links, "root": root})
        else:
            ra, rb = _local_roots(mask, node[a], node[b])
            out = pd.DataFrame({"node": np.concatenate([node[a], node[b]]), "links": np.concatenate([mask @ mult[b], mult[a] @ mask]), "root": np.concatenate([ra, rb])})
        return out[out["links"] > 0]

    return dealt.groupBy("label", "dim", "cell", "i", "j").applyInPandas(run, "node long, links long, root long")


def embedding_links(vecs: DataFrame, least: float = 0.93) -> DataFrame:
    """One row for each row of vecs (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are compared when their labels are equal and not null and their vectors are as long; vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing and stand alone. Equal vectors of a label,
    repeated rows among them, link with each other. A component's id is its smallest vec_id (null if it has none);
    kept: vec_id equals it, null ids are not kept unless alone.
    """
    rows = saved(_prepared(vecs.select("vec_id", "embedding", "label")), "vectors")
    reps = saved(
        rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mult"), F.first("unit").alias("unit")),
        "vectors",
    )
    r = float(np.sqrt(2 - 2 * least))
    cells = saved(_cells(reps, r), "cells")
    found = saved(_joined(cells, least), "links")
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("node", "vec_id", "mult").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(links, "node", "left")
    known = saved(known, "known")
    heads = known.groupBy("comp").agg(F.min("vec_id").alias("head"))
    out = rows.select("vec_id", "node").join(known.select("node", "mult", "links", "comp").join(heads, "comp"), "node", "left")
    return out.select(
        "vec_id",
        F.when(F.col("comp").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"),
        F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("head")).alias("component_id"),
        F.when(F.col("comp").isNull(), True).otherwise(F.coalesce(F.col("vec_id") == F.col("head"), F.lit(False))).alias("kept"),
    )


def op8(vecs: DataFrame) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.93."""
    return embedding_links(vecs)
