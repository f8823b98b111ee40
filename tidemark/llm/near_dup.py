"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its five-word shingles (weight: how often it stands there). Every shingle owns the
plane weight x rank, cut into weight regions [0, 1), [1, 2), [2, 4), ...; darts hit a region as a Poisson process of
one dart for each unit of area, drawn from hashes of (shingle, region), so equal shingles share their darts in all
documents. A dart counts for a document if its weight lies below the shingle's weight there. Each dart also names one
of k coordinates, and the dart of the least rank in a coordinate is the document's signature there: two documents
agree in a coordinate with the probability of their weighted Jaccard similarity. Ranks up to about k (ln k + 2) over
the total weight fill all coordinates; for the few documents where one stays empty the bound is doubled.

Documents of the same words are one class from the start. Signatures are banded; in each bucket the least member is
tried with all others, and what this leaves apart is compared sketch by sketch in blocks, inside the tasks, and
only pairs that may reach the threshold come out. Those are compared exactly. Links make connected components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.words import Words, doc_slices, mix, text_buffers
from tidemark.session import release, saved

K, BAND_ROWS, SHINGLE, THRESHOLD = 128, 5, 5, 0.8
#: Pairs whose signatures agree in fewer coordinates are not compared: 5 standard deviations below 0.8 at k = 128.
SURE = 0.62
#: Bins of the finer sketch of documents that share a bucket, and its bound: more than 5 standard deviations below 0.8.
BINS, FINE_SURE = 1024, 0.73
BLOCK = 1024
#: Rows of a bucket from which its rows are first given a few partners.
MANY = 64
E48 = np.uint64((1 << 48) - 1)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document as (document, 48-bit element, weight); at: n + 1 word offsets.

    A document of fewer words than `size`, but not none, is one shingle.
    """
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, (n > 0).astype(n.dtype)))
    per = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(at[:-1], per)
    length = np.minimum(n, size)[doc]
    s = np.zeros(len(doc), np.uint64)
    pad = np.concatenate([h, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        mult = GOLD
        for k in range(size):
            s += np.where(k < length, pad[start + k], 0).astype(np.uint64) * mult
            mult = mult * GOLD + np.uint64(2)
    key = (doc.astype(np.uint64) << np.uint64(48)) | (mix(s) & E48)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    weight = np.diff(np.concatenate([first, [len(key)]]))
    return (key[first] >> np.uint64(48)).astype(np.int64), key[first] & E48, weight.astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hash to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k signatures of 64-bit dart names; rows of documents without elements are 0. Weights: any positive numbers."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n)
    bound = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0)
    # the regions of each element that its weight reaches: 0 is [0, 1), r is [2^(r-1), 2^r)
    regions = 1 + np.maximum(0, np.ceil(np.log2(np.maximum(weight, 1e-300)))).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), regions)
    region = np.arange(len(row)) - np.repeat(np.cumsum(regions) - regions, regions)
    low, width = np.where(region > 0, 2.0 ** (region - 1.0), 0), np.where(region > 0, 2.0 ** (region - 1.0), 1)
    with np.errstate(over="ignore"):
        seed = mix(element[row] * GOLD + region.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    todo = total > 0
    while todo.any():
        best = np.full(n * k, np.inf)
        name = np.zeros(n * k, np.uint64)
        live = np.flatnonzero(todo[doc[row]])
        d, w, s, lo, wd = doc[row][live], weight[row][live], seed[live], low[live], width[live]
        rank, t = np.zeros(len(live)), 0
        while len(d):
            with np.errstate(over="ignore"):
                a = mix(s + np.uint64(3 * t + 1) * GOLD)
                rank = rank - np.log(_unit(a)) / wd  # the next dart of the region
                on = rank <= bound[d]
                d, w, s, lo, wd, rank = d[on], w[on], s[on], lo[on], wd[on], rank[on]
                hit = lo + wd * _unit(mix(s + np.uint64(3 * t + 2) * GOLD)) <= w
                c = mix(s + np.uint64(3 * t + 3) * GOLD)
            slot = d[hit] * k + (c[hit] % np.uint64(k)).astype(np.int64)
            r, dart = rank[hit], c[hit]
            np.minimum.at(best, slot, r)
            first = r == best[slot]
            name[slot[first]] = dart[first]
            t += 1
        full = np.isfinite(best.reshape(n, k)).all(axis=1)
        done = todo & full
        out[done] = name.reshape(n, k)[done]
        todo &= ~full
        bound *= 2
    return out


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, th, content, n_words, sig): sig holds k 16-bit numbers, content names the sequence of words."""

    def run(batches):
        words = Words()
        for batch in batches:
            data, offs = text_buffers(batch.column(2))
            for i, j in doc_slices(offs):
                h, _, _, at = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = np.diff(at)
                with np.errstate(over="ignore"):
                    place = (np.arange(len(h)) - np.repeat(at[:-1], n)).astype(np.uint64)
                    run_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + place * GOLD))])
                    content = mix((run_sum[at[1:]] - run_sum[at[:-1]]) + n.astype(np.uint64) * GOLD).view(np.int64)
                sig = dart_minhash(*shingles(h, at), j - i, k).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(content), pa.array(n.astype(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "th", "content", "n_words", "sig"],
                )

    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")))
    return src.mapInArrow(run, "doc_id long, th long, content long, n_words long, sig binary")


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b) whose signatures agree in SURE of the coordinates."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(batch.num_rows, -1)
            keep = pa.array((x == y).mean(axis=1) >= SURE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    one, two = sigs.select(F.col("content").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("content").alias("b"), F.col("sig").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def fine_sketch(el: np.ndarray, w: np.ndarray) -> np.ndarray:
    """BINS bytes: of each bin, a byte of the least hash of the (element, copy) pairs in it, 0 if there is none."""
    w = w.astype(np.int64)
    copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    with np.errstate(over="ignore"):
        h = mix(np.repeat(el, w) * GOLD + copy.astype(np.uint64))
    least = np.full(BINS, np.uint64((1 << 64) - 1))
    np.minimum.at(least, (h >> np.uint64(54)).astype(np.int64), mix(h))
    return np.where(least < np.uint64((1 << 64) - 1), 1 + least % np.uint64(255), 0).astype(np.uint8)


def fine_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates for one sketch against many; chance agreement of bytes is taken off."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return (same / np.maximum(either, 1) - 1 / 255) / (1 - 1 / 255)


def _shingle_table(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(content, els, fine): the shingles of each wanted class, all elements, then all weights, and their fine sketch."""

    def run(batches):
        words = Words()
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for i, j in doc_slices(offs):
                h, _, _, at = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                doc, el, w = shingles(h, at, size)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                packed = [el[a:b].tobytes() + w[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                fine = [fine_sketch(el[a:b], w[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary()), pa.array(fine, pa.binary())], names=["content", "els", "fine"])

    d, r = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").alias("d"), nodes.alias("r")
    hit = d.join(r, (F.col("d.th") == F.col("r.th")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id"))).select("r.content", "d.text")
    return hit.dropDuplicates(["content"]).mapInArrow(run, "content long, els binary, fine binary")


def _exact(pairs: DataFrame, els: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold in weighted Jaccard similarity."""

    def run(batches):
        for batch in batches:
            a, b, sim = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, m = len(x) // 12, len(y) // 12
                wx, wy = np.frombuffer(x, "<u4", offset=8 * n).astype(float), np.frombuffer(y, "<u4", offset=8 * m).astype(float)
                _, i, j = np.intersect1d(np.frombuffer(x, "<u8", n), np.frombuffer(y, "<u8", m), assume_unique=True, return_indices=True)
                common = np.minimum(wx[i], wy[j]).sum()
                sim.append(common / max(wx.sum() + wy.sum() - common, 1e-300))
            s = np.array(sim)
            keep = pa.array(s >= threshold, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep), pa.array(s, pa.float64()).filter(keep)], names=["a", "b", "similarity"])

    one, two = els.select(F.col("content").alias("a"), F.col("els").alias("x")), els.select(F.col("content").alias("b"), F.col("els").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def _apart(rows: DataFrame, most: int, band_rows: int) -> DataFrame:
    """(a, b): pairs of one bucket, but of two components, that both sketches let reach the threshold.

    rows: (key, band, n, content, comp, sig, fine), written; n: rows of the bucket. A pair comes out of the bucket of its first common band only
    (that bucket is open too, as it holds both components). Buckets are cut into blocks of about BLOCK rows, and each pair of
    blocks is one group, so no group grows with the bucket; small buckets share groups of about 20,000 rows. Each row
    gives its `most` best partners by block (0: all).
    """
    groups = max(1, rows.count() // 20_000)
    placed = rows.withColumn("nb", F.ceil(F.col("n") / BLOCK)).withColumn("blk", F.pmod(F.xxhash64("content", "key"), F.col("nb")))
    placed = placed.withColumn("part", F.when(F.col("nb") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select(
        "part", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "key", "band", "blk", "content", "comp", "sig", "fine"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), -1)
        fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(len(pdf), -1)
        node, comp, blk, key = (pdf[c].to_numpy() for c in ("content", "comp", "blk", "key"))
        bands = pdf["band"].to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        out = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at, n = np.arange(lo, hi), int(bands[lo])
            head = sig[lo:hi, : n * band_rows].reshape(hi - lo, n, band_rows)
            right = at[blk[lo:hi] == j]
            for r in at[blk[lo:hi] == i]:
                to = right[comp[right] != comp[r]]
                if i == j:
                    to = to[node[to] > node[r]]
                if len(to):
                    to = to[(sig[to] == sig[r]).mean(axis=1) >= SURE]
                if len(to) and n:
                    to = to[~(head[to - lo] == head[r - lo]).all(axis=2).any(axis=1)]
                if len(to):
                    est = fine_similarity(fine[r], fine[to])
                    to, est = to[est >= FINE_SURE], est[est >= FINE_SURE]
                    if most and len(to) > most:
                        to = to[np.argsort(-est, kind="stable")[:most]]
                    out.append(np.stack([np.minimum(node[r], node[to]), np.maximum(node[r], node[to])], axis=1))
        p = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    return dealt.groupBy("part", "i", "j").applyInPandas(run, "a long, b long")


def _first_parents(edges: DataFrame) -> DataFrame:
    """(node, comp): of nodes with links to smaller ones the least of these, or that one's least in turn.

    Nodes of one comp are connected, but a component may still hold several.
    """
    up = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("v")).groupBy("node").agg(F.min("v").alias("comp"))
    return up.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("higher")), "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, band_rows: int = BAND_ROWS, size: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, th (hash of its text), kept.

    class_id is the smallest doc_id among the documents that links reach; kept marks one row of each class: that of
    class_id with the smallest text hash. Texts of the same words are linked without comparison. Texts without words
    (null or empty ones too) are classes of their own, each row kept. Null ids count as larger than any other; a
    class of null ids has a null class_id. Rows that repeat id and text are one document and carry the same flags;
    keep_one() leaves one of them. An empty table gives an empty one. Texts of any length are read whole, in slices;
    other columns of docs do not matter.
    """
    sigs = saved(signatures(docs, k), "signatures")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    nodes = saved(sigs.filter("n_words > 0").groupBy("content").agg(F.min_by(F.struct("doc_id", "th", "sig"), order).alias("r")).select("content", "r.doc_id", "r.th", "r.sig"), "classes")
    bands = k // band_rows
    width = 2 * band_rows
    keyed = nodes.select("content", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + width * b, width)) for b in range(bands)])).alias("band", "key"))
    least = keyed.groupBy("key").agg(F.min("content").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "a")
    buckets = saved(keyed.join(least, "key"), "buckets")
    stars = buckets.filter("a <> content").select("a", F.col("content").alias("b")).distinct()
    tried = pairs = saved(_agreement(stars, nodes), "pairs")
    els = saved(_shingle_table(docs, nodes.drop("sig").join(buckets.select("content").distinct(), "content"), size).join(nodes.select("content", "sig"), "content"), "shingles")
    edges = saved(_exact(pairs, els, threshold), "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
    release(docs.sparkSession)
    comp = None
    # buckets of many rows are first looked into for a few partners of each row, whose links leave few rows apart; then
    # all open buckets are, for all partners
    for most, many in ((8, MANY), (0, 1)):
        group = _first_parents(edges) if comp is None else comp
        now = buckets.select("key", "band", "content").join(group.withColumnRenamed("node", "content"), "content", "left").withColumn("comp", F.coalesce("comp", "content"))
        open_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter(f"lo <> hi AND n > {many}").select("key", "n")
        rows = saved(now.join(open_keys, "key").join(els.select("content", "sig", "fine"), "content"), "open-buckets")
        if rows.isEmpty():
            continue
        pairs = saved(_apart(rows, most, band_rows).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        tried = tried.select("a", "b").unionByName(pairs)
        release(docs.sparkSession)
        more = saved(_exact(pairs, els, threshold), "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = edges.unionByName(more)
        if most:
            comp = saved(components(edges), "components")
            edges = comp.select(F.col("node").alias("u"), F.col("comp").alias("v"))
    release(docs.sparkSession)
    comp = saved(components(edges), "components")
    release(docs.sparkSession)
    member = saved(nodes.select("content", "doc_id", "th").join(comp.withColumnRenamed("node", "content"), "content", "left").withColumn("comp", F.coalesce("comp", "content")), "members")
    heads = member.groupBy("comp").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), F.col("th").alias("head_th")), order).alias("head"))
    # a table of its own, so that Spark can split the partition of a text that very many rows repeat
    classes = saved(member.select("content", "comp").join(heads, "comp").select("content", "head.id", "head.head_th"), "heads")
    out = sigs.select("doc_id", "th", "n_words", F.when(F.col("n_words") > 0, F.col("content")).alias("content")).join(classes, "content", "left")
    return out.select(
        "doc_id", "th", F.when(F.col("n_words") > 0, F.col("id")).otherwise(F.col("doc_id")).alias("class_id"),
        ((F.col("n_words") == 0) | (F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("head_th")))).alias("kept"),
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class of near_duplicates(); columns as they are."""
    kept = near_duplicates(docs, **how).filter("kept").select("doc_id", "th").distinct()
    d, r = docs.withColumn("_th", F.xxhash64("text")).alias("d"), kept.alias("r")
    same = d.join(r, F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.col("d._th") == F.col("r.th")), "left_semi")
    return same.dropDuplicates(["doc_id", "_th"]).drop("_th")


def op2(docs: DataFrame) -> DataFrame:
    """Class of every document at a similarity of 0.8 over five-word shingles."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "class_id", "kept")
