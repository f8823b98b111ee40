"""Exact k-means on whole numbers by Yinyang grouping.

Centroids are put into groups once. Every vector carries an upper bound on the distance to its centroid and, for each
group, one lower bound on the distance to the group's other centroids. When centroids move, the bounds move with them: a
vector whose upper bound stays below all its lower bounds keeps its centroid unseen (global filter), else its distance is
worked out and only groups whose lower bound it reaches are looked at (group filter), where surviving centroids are
scanned exactly. Bounds are floats with a margin for rounding and decide only what need not be looked at; distances and
means are whole numbers, so the result is that of a full scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import forget, saved

#: Components reach at most this far from 0 (beyond it they are clamped), so that a distance of 64 of them fits in 64 bits.
REACH = 1 << 27
#: Centroids in a group, about.
PER_GROUP = 10
#: Rounding of a bound: relative, and absolute.
SLACK, LEAST = 1e-9, 1e-6
STATE = "kind string, vec_id long, vec binary, cluster int, distance long, upper double, lower binary, n long, sums array<long>"


def whole_vectors(col: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have dim finite components, and those vectors as whole numbers floor(scale x)."""
    col = col.cast(pa.list_(pa.float64()))
    size = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    ok = size == dim
    flat = col.filter(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null is not a number
    fine = np.isfinite(x).all(axis=1)
    ok[np.flatnonzero(ok)[~fine]] = False
    with np.errstate(over="ignore"):
        return ok, np.clip(np.floor(x[fine] * scale), -REACH, REACH).astype(np.int32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * x.shape[1] * 4 < 1 << 53:  # whole numbers below 2^53 are exact as floats
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(len(c)):
        d = x.astype(np.int64) - c[k]
        out[:, k] = (d * d).sum(axis=1)
    return out


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Group of each centroid: a few rounds of plain k-means on the centroids, from evenly spread ones."""
    seeds = centroids[np.linspace(0, len(centroids) - 1, groups).astype(int)].astype(np.float64)
    of = np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        of = ((centroids[:, None, :] - seeds[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (of == g).any():
                seeds[g] = centroids[of == g].mean(axis=0)
    return of


def nearest(x: np.ndarray, c: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full scan: cluster (ties: smaller number), squared distance, and a lower bound for each group."""
    d = distances(x, c)
    a = d.argmin(axis=1)
    best = d[np.arange(len(x)), a]
    rest = d.astype(np.float64)
    rest[np.arange(len(x)), a] = np.inf
    lower = np.stack([np.sqrt(rest[:, of == g].min(axis=1, initial=np.inf)) for g in range(of.max() + 1)], axis=1)
    return a, best, lower


def moved(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bounds after the centroids moved by drift to c, and the number of distances worked out."""
    a, n = a.copy(), len(of)
    steps = np.array([drift[of == g].max(initial=0) for g in range(of.max() + 1)])
    upper = upper + drift[a]
    lower = lower - steps[None, :]
    reach = lambda u: (u * (1 + SLACK) + LEAST)[:, None] >= lower
    left = np.flatnonzero(reach(upper).any(axis=1))  # global filter
    work = len(left)
    own = np.array([], np.int64)
    if work:
        d = x[left].astype(np.int64) - c[a[left]]
        own = (d * d).sum(axis=1)
        upper[left] = np.sqrt(own)
        look = reach(upper)[left]
        best, at = own.copy(), a[left].copy()
        held = a[left].copy()
        exact = np.full((len(left), n), np.inf)
        exact[np.arange(len(left)), held] = own
        for g in range(of.max() + 1):  # group filter, then an exact scan of the group
            rows, cs = np.flatnonzero(look[:, g]), np.flatnonzero(of == g)
            if len(rows) and len(cs):
                d = distances(x[left[rows]], c[cs])
                work += d.size
                exact[np.ix_(rows, cs)] = d
                k = d.argmin(axis=1)
                dk = d[np.arange(len(rows)), k]
                better = (dk < best[rows]) | ((dk == best[rows]) & (cs[k] < at[rows]))
                best[rows[better]], at[rows[better]] = dk[better], cs[k[better]]
        exact[np.arange(len(left)), at] = np.inf
        for g in range(of.max() + 1):
            cs = of == g
            seen = np.sqrt(exact[:, cs].min(axis=1, initial=np.inf))
            # of a group that was not looked at only the centroid left behind is known
            lower[left, g] = np.where(look[:, g], seen, np.minimum(lower[left, g], seen))
        a[left] = at
        upper[left] = np.sqrt(best)
    return a, upper, lower, work


def _batch(**cols) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "vec_id": pa.int64(), "vec": pa.binary(), "cluster": pa.int32(), "distance": pa.int64(), "upper": pa.float64(), "lower": pa.binary(), "n": pa.int64(), "sums": pa.list_(pa.int64())}
    size = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))


def _pass(rows: DataFrame, c: np.ndarray, drift: np.ndarray | None, of: np.ndarray, last: bool) -> DataFrame:
    """One assignment of rows: a row of kind `vec` for each, and the sums of each cluster in this task.

    rows: (vec_id, vec) in the first pass, else those of the last one. c, drift and of are as large as the centroids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.int32).reshape(batch.num_rows, -1)
            if drift is None:
                a, best, lower = nearest(x, c, of)
                upper = np.sqrt(best)
            else:
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist())).reshape(len(x), -1)
                a, upper, lower, _ = moved(x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), lower, c, drift, of)
            if last:
                d = x.astype(np.int64) - c[a]
                yield _batch(kind=["vec"] * len(x), vec_id=batch.column("vec_id"), cluster=a, distance=(d * d).sum(axis=1))
            else:
                order = np.argsort(a, kind="stable")
                some, at = np.unique(a[order], return_index=True)
                sums[some] += np.add.reduceat(x[order].astype(np.int64), at, axis=0)
                counts += np.bincount(a, minlength=len(c))
                yield _batch(kind=["vec"] * len(x), vec_id=batch.column("vec_id"), vec=batch.column("vec"), cluster=a, upper=upper, lower=[r.tobytes() for r in lower])
        if not last and counts.any():
            some = np.flatnonzero(counts)
            yield _batch(kind=["sum"] * len(some), cluster=some, n=counts[some], sums=list(sums[some]))

    cols = ["vec_id", "vec"] if drift is None else ["vec_id", "vec", "cluster", "upper", "lower"]
    return rows.select(*cols).mapInArrow(run, STATE)


def _means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """New centroids: floor(sum / count) of each component, and the old one where a cluster is empty. One row for each centroid."""
    dim = c.shape[1]
    total = state.filter("kind = 'sum'").groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dim)])
    out = c.copy()
    for r in total.collect():
        out[r["cluster"]] = [int(r[f"s{k}"]) // int(r["n"]) for k in range(dim)]
    return out


def _seeds(vecs: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `salt:vec_id`, then of the smallest bytes; null ids come last."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vecs.select("vec", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    return np.stack([np.frombuffer(r["vec"], np.int32) for r in rows]).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def cluster(vecs: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each vector that is kept.

    vecs: (vec_id, embedding). A vector is kept if it has exactly dim components, none null or not finite; a component x
    becomes floor(scale x), beyond +-2^27 that. The k vectors of the smallest hash are the first centroids (fewer, if there
    are fewer vectors). Each round assigns every vector to the nearest centroid (ties: the smaller number), then moves each
    centroid to its vectors' mean, rounded down in each component; one without vectors stays. Then vectors are assigned once
    more; distance is squared, and inertia that summed over the cluster and over all (null beyond 64 bits). Repeated rows
    and ids are vectors of their own; null ids are kept, but are the last to become centroids. Other columns of vecs are not
    read. An empty table, or one without kept vectors, gives an empty one.

    The driver holds centroids only. Each pass reads the table of the last one and writes its own to the shared folder, so
    a lost executor costs the tasks it ran; sums are formed in the tasks, and a cluster of any size is never in one place.
    """

    def read(batches):
        for batch in batches:
            ok, x = whole_vectors(batch.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "vec"])

    spark = vecs.sparkSession
    state = saved(vecs.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(read, "vec_id long, vec binary"), "vectors")
    c = _seeds(state, k, salt)
    none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(c):
        return spark.createDataFrame([], none)
    of, drift = grouped(c, max(1, len(c) // PER_GROUP)), None
    of = np.unique(of, return_inverse=True)[1]
    for _ in range(rounds):
        now = saved(_pass(state, c, drift, of, False), "assigned")
        forget(state)
        new = _means(now, c)
        drift = np.sqrt(((new - c).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK) + LEAST
        state, c = now.filter("kind = 'vec'"), new
        state._tidemark_path = now._tidemark_path
    found = saved(_pass(state, c, drift, of, True).select("vec_id", "cluster", "distance"), "assigned")
    forget(state)
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row for each centroid
    fits = lambda x: x if x < 1 << 63 else None
    every = fits(sum(int(r["own"]) for r in by))
    rows = [(r["cluster"], fits(int(r["own"])), every, hashlib.sha256(",".join(map(str, c[r["cluster"]].tolist())).encode()).hexdigest()) for r in by]
    one = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(one), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(vecs: DataFrame) -> DataFrame:
    """Clusters of all embeddings: 40 centroids, 5 rounds."""
    return cluster(vecs.select("vec_id", "embedding"))
