"""Benchmark decontamination on a distributed positional inverted index.

A window is `size` consecutive words of an item (a shorter item is one window). The corpus frequencies of all item
words are counted first; the two rarest places of each window are its anchors. The postings (term, document, position)
of all anchor terms are stored as a table. The list of each rarest term is moved back by its place in the item, and
the list of the second rarest is intersected with it: a (document, place of the item) that both name goes on, one that
they name within `slop` words is a proximity match. What goes on is compared with the document phrase by phrase, which
leaves the exact ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import Words, doc_slices, mix, text_buffers
from tidemark.session import saved

#: Words of benchmark text held at once; a larger benchmark is searched in blocks of items, each against all rows.
BLOCK_WORDS = 1_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)


def phrase_hash(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the `length` words from each start, order and length included."""
    with np.errstate(over="ignore"):
        out = np.full(len(starts), length, np.uint64)
        for k in range(length):
            out = mix(out * MULT + h[starts + k])
    return out


def item_windows(ids: list[str], texts: list[str], size: int) -> dict[str, np.ndarray]:
    """Of each distinct (item, window): item number, word hashes (padded with 0), length, phrase hash, begin."""
    words = Words()
    data, offs = text_buffers(pa.array(texts, pa.large_string()))
    h, _, _, at = words(data, offs)
    item, rows, length, begin = [], [], [], []
    for i in range(len(ids)):
        a, b = int(at[i]), int(at[i + 1])
        n = min(size, b - a)
        for s in range(a, b - n + 1) if n else ():
            w = np.zeros(size, np.uint64)
            w[:n] = h[s : s + n]
            item.append(i)
            begin.append(s - a)
            rows.append(w)
            length.append(n)
    w = np.array(rows, np.uint64).reshape(-1, size)
    n = np.array(length, np.int64)
    ph = np.zeros(len(n), np.uint64)
    for k in np.unique(n):
        sel = np.flatnonzero(n == k)
        ph[sel] = phrase_hash(w.reshape(-1), sel * size, int(k))
    _, first = np.unique(np.stack([np.array(item, np.uint64), ph]), axis=1, return_index=True) if len(n) else (None, np.zeros(0, int))
    return {"item": np.array(item, np.int64)[first], "words": w[first], "length": n[first], "phrase": ph[first], "begin": np.array(begin, np.int64)[first]}


class Members:
    """Number of a term in a sorted vocabulary, with a bit table that settles most misses."""

    def __init__(self, vocab: np.ndarray) -> None:
        self.vocab = vocab
        self.bit = np.zeros(1 << 22, bool)
        self.bit[(vocab & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold a vocabulary term, and the terms' numbers."""
        maybe = np.flatnonzero(self.bit[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(self.vocab) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
        ok = self.vocab[k] == h[maybe]
        return maybe[ok], k[ok]


def term_counts(docs: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """Occurrences of each vocabulary term in all texts."""
    b = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        words, members = Words(), Members(b.value)
        total = np.zeros(len(b.value), np.int64)
        for batch in batches:
            data, offs = text_buffers(batch.column(0))
            for i, j in doc_slices(offs):
                h = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0]
                total += np.bincount(members.find(h)[1], minlength=len(total))
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[got])], names=["term", "n"])

    out = np.zeros(len(vocab), np.int64)
    # one row for each term at most: bounded by BLOCK_WORDS
    for r in docs.select(F.coalesce("text", F.lit(""))).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def postings(docs: DataFrame, vocab: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(term, doc_id, th, pos) of the wanted terms of the vocabulary; th is the hash of the row's text."""
    b = docs.sparkSession.sparkContext.broadcast((vocab[wanted], np.flatnonzero(wanted)))

    def run(batches):
        words, (terms, number) = Words(), b.value
        members = Members(terms)
        for batch in batches:
            ids, th = batch.column(0), batch.column(1)
            data, offs = text_buffers(batch.column(2))
            for i, j in doc_slices(offs):
                h, _, _, at = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                pos, k = members.find(h)
                doc = np.searchsorted(at, pos, "right") - 1
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(number[k]), ids.take(take), th.take(take), pa.array(pos - at[doc])], names=["term", "doc_id", "th", "pos"])

    return docs.select(F.col("doc_id").cast("long"), "th", F.coalesce("text", F.lit(""))).mapInArrow(run, "term long, doc_id long, th long, pos long")


def _block(docs: DataFrame, ids: list[str], texts: list[str], size: int, slop: int) -> DataFrame | None:
    """(doc_id, th, start, length, phrase, item, exact) that the anchors of some window name."""
    spark = docs.sparkSession
    w = item_windows(ids, texts, size)
    if not len(w["item"]):
        return None
    real = np.arange(size)[None, :] < w["length"][:, None]
    vocab, of = np.unique(w["words"], return_inverse=True)
    of = of.reshape(w["words"].shape)
    seen = term_counts(docs, vocab)
    rarity = np.where(real, seen[of], np.iinfo(np.int64).max)
    alive = np.flatnonzero(rarity.min(axis=1) > 0)  # a window with a word that no text has stands nowhere
    if not len(alive):
        return None
    order = np.argsort(rarity[alive], axis=1, kind="stable")
    term = np.take_along_axis(of[alive], order[:, :2], axis=1)
    place = order[:, :2] + w["begin"][alive][:, None]
    two = w["length"][alive] > 1
    wanted = np.zeros(len(vocab), bool)
    wanted[term[:, 0]] = wanted[term[two, 1]] = True
    posts = saved(postings(docs, vocab, wanted), "postings")
    windows = spark.createDataFrame(
        pa.table({
            "item_no": w["item"][alive], "p1": place[:, 0], "p2": pa.array(place[:, 1], mask=~two), "t1": term[:, 0], "t2": pa.array(term[:, 1], mask=~two),
            "begin": w["begin"][alive], "length": w["length"][alive], "phrase": w["phrase"][alive].view(np.int64), "item": pa.array([ids[k] for k in w["item"][alive]], pa.string()),
        })
    )
    # a row for each window: bounded by BLOCK_WORDS, and sent whole only while small
    sent = F.broadcast if len(alive) <= 100_000 else (lambda df: df)
    cand = (
        posts.join(sent(windows.select("item_no", "p1", "t1").distinct()), F.col("term") == F.col("t1"))
        .select("doc_id", "th", "item_no", "p1", (F.col("pos") - F.col("p1")).alias("at"))
        .join(sent(windows.select("item_no", "p1", "p2", "t2").distinct()), ["item_no", "p1"])
    )
    alone = cand.filter("p2 IS NULL").select("doc_id", "th", "item_no", "p1", "p2", "at", F.lit(True).alias("exact"))
    width = 16  # words of a bucket: positions within slop share one of two buckets
    want = cand.filter("p2 IS NOT NULL").withColumn("want", F.col("at") + F.col("p2"))
    near = lambda d: F.floor((F.col("want") + d) / width)
    want = want.withColumn("bucket", F.explode(F.array_distinct(F.array(near(-slop), near(slop)))))
    second = posts.join(sent(windows.filter("t2 IS NOT NULL").select(F.col("t2").alias("term")).distinct()), "term", "left_semi")
    second = second.select(F.col("doc_id").alias("d2"), F.col("th").alias("h2"), F.col("term").alias("t2"), "pos", F.floor(F.col("pos") / width).alias("bucket"))
    met = (
        want.join(second, (F.col("th") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & (want["t2"] == second["t2"]) & (want["bucket"] == second["bucket"]) & (F.abs(F.col("pos") - F.col("want")) <= slop))
        .select("doc_id", "th", "item_no", "p1", "p2", "at", (F.col("pos") == F.col("want")).alias("exact"))
        .unionByName(alone)
    )
    w2 = windows.select(F.col("item_no").alias("_i"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), "begin", "length", "phrase", "item")
    return (
        met.join(sent(w2), (F.col("item_no") == F.col("_i")) & (F.col("p1") == F.col("_p1")) & F.col("p2").eqNullSafe(F.col("_p2")))
        .withColumn("start", F.col("at") + F.col("begin"))
        .select("doc_id", "th", "start", "length", "phrase", "item", (F.col("exact") & (F.col("start") >= 0)).alias("exact"))
    )


def find(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids as strings, sorted) and near_items (met within slop, but not exactly).

    n_hit counts the words inside exact occurrences. Null and empty texts have no words; items without words or with a
    null id match nothing; items that share an id or a text count by id. Repeated rows are judged alike. Columns of docs
    with one of these names are replaced. Without items, nothing is hit. Texts and items of any length are read whole.
    Of terms that are equally rare in a window the earlier one is the rarer; exact occurrences do not depend on it,
    near_items does: it names items of which two rarest terms of a window stand within slop words of their places.
    """
    docs = docs.drop("n_words", "n_hit", "items", "near_items")
    keyed = docs.withColumn("_dc_th", F.xxhash64("text"))
    slim = keyed.select("doc_id", F.col("_dc_th").alias("th"), "text")
    q = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = q.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (4 * block_words)))
    found = None
    for k in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        one = _block(slim, [r["item_id"] for r in part], [r["text"] for r in part], size, slop)
        if one is not None:
            found = one if found is None else found.unionByName(one)
    kind = "array<struct<start:bigint,length:bigint,phrase:bigint,item:string,exact:boolean>>"
    if found is None:
        joined = keyed.withColumn("_dc_c", F.lit(None).cast(kind))
    else:
        lists = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "length", "phrase", "item", "exact")).alias("_dc_c"))
        d, r = keyed.alias("d"), lists.alias("r")
        joined = d.join(r, F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.col("d._dc_th") == F.col("r.th")), "left").select("d.*", "r._dc_c")
    return _verify(joined.drop("_dc_th"), docs.columns)


def _verify(joined: DataFrame, columns: list[str]) -> DataFrame:
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in joined.schema.fields if f.name != "_dc_c"]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType()))]
    )
    at = columns.index("text")

    def run(batches):
        words = Words()
        for batch in batches:
            data, offs = text_buffers(batch.column(at))
            cand = batch.column(len(columns))
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            hits, nears = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for i, j in doc_slices(offs):
                h, _, _, wat = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n_words[i:j] = np.diff(wat)
                for d in range(i, j):
                    if not cand[d].is_valid:
                        continue
                    c = cand[d].values
                    own = h[wat[d - i] : wat[d - i + 1]]
                    start, length, exact = c.field("start").to_numpy(), c.field("length").to_numpy(), c.field("exact").to_numpy(zero_copy_only=False)
                    phrase = c.field("phrase").to_numpy().view(np.uint64)
                    ok = exact & (start >= 0) & (start + length <= len(own))
                    for n in np.unique(length[ok]):
                        sel = np.flatnonzero(ok & (length == n))
                        ok[sel] = phrase_hash(own, start[sel], int(n)) == phrase[sel]
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, start[ok], 1)
                    np.add.at(edge, (start + length)[ok], -1)
                    n_hit[d] = int((np.cumsum(edge)[:-1] > 0).sum())
                    names = c.field("item").to_numpy(zero_copy_only=False)
                    hits[d] = sorted(set(names[ok]))
                    nears[d] = sorted(set(names[~ok]) - set(hits[d]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(n_words), pa.array(n_hit), pa.array(hits, pa.list_(pa.string())), pa.array(nears, pa.list_(pa.string()))],
                names=[*columns, "n_words", "n_hit", "items", "near_items"],
            )

    return joined.select(*columns, "_dc_c").mapInArrow(run, schema)


def op10(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digest of find() over documents and benchmark."""
    return find(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
