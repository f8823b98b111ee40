"""Audit of how the terms of a language's sources diverge, on mergeable radix tries.

Each task counts the terms of its documents in byte tries, one for a language, whose leaves hold the number of documents
and a counter for each source; the root counts documents, so that sources without terms are known too. A trie that has
grown to its bound is written out and begun anew. Leaves of all tasks are dealt by ranges of language and term, and each
range merges its tries by a walk in byte order, which is that of UTF-8 text. The merged leaves give the shares of every
term, and from these the divergence of every two sources and the terms that mark a source.

A share is p = 1 + floor(SCALE (count + 1) / (N + V)) over the V kept terms of the language, whose counts sum to N in the
source; a term adds floor((p - q)^2 / q) to a divergence. All of it is exact: in 64 bits, with shares worked out digit by
digit, for up to 9 * 10^15 terms.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import forget, saved

#: Shares are whole parts of SCALE. Three factors, so that no product leaves 64 bits.
SCALE, STEPS = 1_000_000_000, (1000, 1000, 1000)
#: Counters (a source of a leaf) in a task's tries, and terms by source counted before they enter them, about; bytes of text cut at once.
COUNTERS, ENTRIES, SLICE = 800_000, 400_000, 1 << 20
#: Keys in a bag of a trie at most.
BAG = 4096
#: Sources in a block of the pairwise sums, and terms in one of their groups, about.
BLOCK, TERMS = 64, 2048
#: Every byte of a term in lower case (A-Z only), every other one as a space.
_CUT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")

#: A leaf's key is language, a zero byte and term: no term holds a zero byte, so the last one parts them.
LEAF = "key binary, df long, sources array<string>, counts array<long>"
MERGED = "lang string, term binary, df long, sources array<string>, counts array<long>"


class Node(dict):
    """An inner node: children by byte, and the leaf of the key that ends here."""

    own: dict | None = None


class Trie:
    """Radix trie over bytes. A leaf is {source: occurrences}, with the number of documents under None.

    Keys with a common beginning lie in one bag, {rest of the key: leaf}; a bag of more than BAG keys is parted by the next
    byte. So inner nodes are few, and a bag is only put in order by a walk.
    """

    def __init__(self) -> None:
        self.root: dict = {}

    def leaf(self, key: bytes) -> dict:
        """The leaf of key, made if need be."""
        above, node, at = None, self.root, 0
        while type(node) is Node:
            if at == len(key):
                if node.own is None:
                    node.own = {None: 0}
                return node.own
            above, b = node, key[at]
            node = above.get(b)
            if node is None:
                node = above[b] = {}
            at += 1
        leaf = node.get(rest := key[at:])
        if leaf is None:
            leaf = node[rest] = {None: 0}
            if len(node) > BAG:
                parted = Node()
                for k, x in node.items():
                    if k:
                        parted.setdefault(k[0], {})[k[1:]] = x
                    else:
                        parted.own = x
                if above is None:
                    self.root = parted
                else:
                    above[b] = parted
        return leaf

    def walk(self) -> Iterator[tuple[bytes, dict]]:
        """Keys and leaves in byte order."""
        stack = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            if type(node) is Node:
                if node.own is not None:
                    yield key, node.own
                stack += [(key + bytes((b,)), node[b]) for b in sorted(node, reverse=True)]
            else:
                for rest in sorted(node):
                    yield key + rest, node[rest]


class Tries:
    """A trie for each language, with a bound on their counters."""

    def __init__(self) -> None:
        self.tries: defaultdict[str, Trie] = defaultdict(Trie)
        self.size = 0

    def add(self, lang: str, docs: Counter, counts: dict[str, Counter]) -> None:
        """Documents by term, and occurrences by source and term."""
        find, at = self.tries[lang].leaf, {}
        for term, n in docs.items():
            at[term] = leaf = find(term)
            leaf[None] += n
        for source, own in counts.items():
            for term, n in own.items():
                leaf = at[term]
                if source in leaf:
                    leaf[source] += n
                else:
                    leaf[source] = n
                    self.size += 1

    def rows(self, chunk: int = 20_000) -> Iterator[pa.RecordBatch]:
        """All leaves, language by language in byte order."""
        leaves = ((head + term, leaf) for lang in sorted(self.tries) for head in [lang.encode() + b"\0"] for term, leaf in self.tries[lang].walk())
        while part := list(itertools.islice(leaves, chunk)):
            key, by = zip(*part, strict=True)
            df = [x.pop(None) for x in by]
            sources, counts = [y for x in by for y in x], [n for x in by for n in x.values()]
            yield leaf_batch(pa.array(key, pa.binary()), np.array(df), np.array([len(x) for x in by]), pa.array(sources, pa.string()), np.array(counts, np.int64))


def leaf_batch(key: pa.Array, df: np.ndarray, size: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Leaves with `size` counters each, which follow one another in sources and counts."""
    at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    cols = [key, pa.array(df, pa.int64()), pa.ListArray.from_arrays(at, sources), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["key", "df", "sources", "counts"])


def pieces(text: bytes) -> Iterator[bytes]:
    """text in slices of about SLICE bytes, cut where no term is cut."""
    a = 0
    while a < len(text):
        b = a + SLICE
        if b < len(text):
            gap = _GAP.search(text, b)
            b = gap.end() if gap else len(text)
        yield text[a:b]
        a = b


def count_terms(docs: DataFrame) -> DataFrame:
    """Leaves (key, df, sources, counts) of the tries of docs (text, lang, source); the empty term is the root.

    A leaf has one row from each task and each time its tries were full.
    """

    def run(batches):
        tries, room = Tries(), ENTRIES
        for batch in batches:
            texts, langs, sources = batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            held: defaultdict[str, Counter] = defaultdict(Counter)
            counts: defaultdict[str, defaultdict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
            for text, lang, source in zip(texts, langs, sources, strict=True):
                seen: set[bytes] = set()
                own = counts[lang][source]
                for part in pieces(text.as_py()):
                    terms = part.translate(_CUT).split()
                    own.update(terms)
                    seen.update(terms)
                own[b""] += 1
                seen.add(b"")
                held[lang].update(seen)
                room -= len(seen)
                if room <= 0:
                    room = ENTRIES - sum(len(c) for by in counts.values() for c in by.values())
                    if room <= ENTRIES // 20:
                        yield from _settle(tries, held, counts)
                        room = ENTRIES
            yield from _settle(tries, held, counts)
        yield from tries.rows()

    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return src.mapInArrow(run, LEAF)


def _settle(tries: Tries, held: dict, counts: dict) -> Iterator[pa.RecordBatch]:
    """Move what was counted into the tries; full tries are given out and emptied."""
    for lang in held:
        tries.add(lang, held[lang], counts[lang])
    held.clear()
    counts.clear()
    if tries.size >= COUNTERS:
        yield from tries.rows()
        tries.tries.clear()
        tries.size = 0


def merge_leaves(leaves: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, df, sources, counts): leaves of one key added up, each range of keys by a walk in byte order.

    Terms in fewer documents are left out; the root of each language (the empty term) stays.
    """
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kept(out: pa.RecordBatch) -> pa.RecordBatch:
        out = out.filter(pa.compute.or_(pa.compute.greater_equal(out.column(1), least_docs), pa.compute.ends_with(out.column(0), b"\0")))
        parts = [k.rpartition(b"\0") for k in out.column(0).to_pylist()]
        lang, term = pa.array([x[0].decode() for x in parts], pa.string()), pa.array([x[2] for x in parts], pa.binary())
        return pa.RecordBatch.from_arrays([lang, term, *out.columns[1:]], names=["lang", "term", "df", "sources", "counts"])

    def run(batches):
        rest = None  # the last leaf so far, which may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                out = _added_up(batch if rest is None else pa.Table.from_batches([rest, batch.select(rest.schema.names).cast(rest.schema)]).combine_chunks().to_batches()[0])
                yield kept(out.slice(0, out.num_rows - 1))
                rest = out.slice(out.num_rows - 1)
        if rest is not None:
            yield kept(rest)

    return leaves.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, MERGED)


def _added_up(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring leaves of one key as one."""
    key, n = batch.column(0), batch.num_rows
    fresh = np.ones(n, bool)
    fresh[1:] = pa.compute.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(fresh)
    size = pa.compute.list_value_length(batch.column(2)).to_numpy()
    names = batch.column(2).flatten().dictionary_encode()
    width = max(len(names.dictionary), 1)
    cell = np.repeat(np.cumsum(fresh) - 1, size) * width + names.indices.to_numpy()
    counts = batch.column(3).flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], start) if len(cell) else counts
    size = np.bincount(cell[start] // width, minlength=len(first))
    return leaf_batch(key.take(first), np.add.reduceat(batch.column(1).to_numpy(), first), size, names.dictionary.take(pa.array(cell[start] % width)), total)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 1) / total), exactly: long division by 1000 three times."""
    q, r = _div(count + 1, total), (count + 1) % total
    for k in STEPS:
        q, r = q * k + _div(r * k, total), (r * k) % total
    return q + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs that are not negative."""
    return F.call_function("div", a, b)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """share() for arrays of int64."""
    q, r = np.divmod(counts + 1, totals)
    for k in STEPS:
        d, r = np.divmod(r * k, totals)
        q = q * k + d
    return q + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly."""
    return _div((p - q) * (p - q), q)


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed gaps of every two different sources of a language.

    Sources are numbered within a language and taken in blocks, terms in parts of about TERMS; a task holds one part of
    two blocks as a matrix, and gives a sum for each two sources. A term that none of both blocks holds adds the same
    for all terms, so it is counted and added once.
    """
    nb = F.ceil(F.col("n_groups") / BLOCK).cast("int")
    blk = _div(F.col("num"), F.lit(BLOCK)).cast("int")
    parts = F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int")
    cols = ["lang", "i", "j", "part", "num", "source", "term", "n", "total"]
    # the heads: every source of both blocks, in each part
    heads = groups.select("lang", "num", "source", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("long").alias("n"), (F.col("total") + F.col("v")).alias("total"), nb.alias("nb"), blk.alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = cells.select("lang", "num", F.lit(None).cast("string").alias("source"), "term", "n", F.lit(None).cast("long").alias("total"), nb.alias("nb"), blk.alias("b"), F.pmod(F.xxhash64("term"), parts).cast("int").alias("part"))
    both = heads.unionByName(rows).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    ways = F.when(F.col("b") == F.col("o"), F.array(F.struct(F.col("b").alias("i"), F.col("o").alias("j")))).otherwise(F.array(F.struct(F.col("b").alias("i"), F.col("o").alias("j")), F.struct(F.col("o").alias("i"), F.col("b").alias("j"))))
    dealt = both.withColumn("w", F.explode(ways)).withColumns({"i": F.col("w.i"), "j": F.col("w.j")}).select(*cols)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        head = pdf["source"].notna().to_numpy()
        info = pdf[head].sort_values("num")
        num, total, name = info["num"].to_numpy(), info["total"].to_numpy(np.int64), info["source"].to_numpy()
        body = pdf[~head]
        term, uniq = pd.factorize(body["term"].map(bytes))
        counts = np.zeros((len(uniq), len(num)), np.int64)
        counts[term, np.searchsorted(num, body["num"].to_numpy())] = body["n"].to_numpy(np.int64)
        p = shares(counts, np.maximum(total, 1)[None, :])
        left, right = np.flatnonzero(num // BLOCK == i), np.flatnonzero(num // BLOCK == j)
        out = []
        for a in left:
            b = right[right != a]
            d = p[:, a][:, None] - p[:, b]
            out.append(pd.DataFrame({"source": name[a], "item": name[b], "value": (d * d // p[:, b]).sum(axis=0), "seen": np.int64(len(uniq)), "base": total[a], "other": total[b]}))
        out = pd.concat(out) if out else pd.DataFrame(columns=["source", "item", "value", "seen", "base", "other"])
        return out.assign(lang=key[0])[["lang", "source", "item", "value", "seen", "base", "other"]]

    sums = dealt.groupBy("lang", "i", "j", "part").applyInPandas(run, "lang string, source string, item string, value long, seen long, base long, other long")
    sums = sums.groupBy("lang", "source", "item").agg(*[F.sum(c).alias(c) for c in ("value", "seen")], *[F.max(c).alias(c) for c in ("base", "other")])
    v = groups.select("lang", "v").distinct()
    none = gap(*[share(F.lit(0).cast("long"), F.greatest(F.col(c), F.lit(1))) for c in ("base", "other")])
    value = F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(F.col("value") + (F.col("v") - F.col("seen")) * none)
    return sums.join(v, "lang").select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from each other one and from the whole.

    Part `pair` has every other source of the language with the summed gaps from it, part `term` the at most `top` terms
    whose share in the source exceeds that in the language, by their gap. Ranks count from 1, falling values first; ties
    stand in the byte order of UTF-8. Terms are runs of letters A-Z, a-z and characters beyond ASCII, with A-Z
    lower-cased; those in at least `least_docs` documents of the language are kept, and each row is a document. A null
    text, lang or source counts as ''. Empty texts and texts without a term still name their source. A language without
    kept terms gives pairs of value 0 and no terms. Texts of any length are read whole. Repeated rows count as often as
    they stand. Only text, lang and source are read, whatever else docs has. An empty table gives an empty one.
    """
    counted = saved(count_terms(docs), "term-tries")
    merged = saved(merge_leaves(counted, least_docs), "term-leaves")
    forget(counted)
    of_doc = merged.filter("term = X''").select("lang", F.explode("sources").alias("source"))
    kept = merged.filter("term <> X''")
    terms = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"), F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    terms = terms.select("lang", "term", "all", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocab = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = of_doc.join(sums, ["lang", "source"], "left").join(vocab, "lang", "left").fillna(0, ["total", "v"])
    groups = groups.withColumn("whole", F.sum("total").over(W.partitionBy("lang"))).withColumn("n_groups", F.count(F.lit(1)).over(W.partitionBy("lang")))
    groups = saved(groups.withColumn("num", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1), "term-groups")
    cells = terms.join(groups, ["lang", "source"])
    pairs = pair_sums(cells, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    p, q = share(F.col("n"), F.col("total") + F.col("v")), share(F.col("all"), F.col("whole") + F.col("v"))
    marks = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    marks = marks.select("lang", "source", "part", "item", gap(F.col("p"), F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    return pairs.unionByName(marks).select("lang", "source", "part", "item", "value", "rank")


def op12(docs: DataFrame) -> DataFrame:
    """Divergence of all sources of documents, and their 200 most marked terms."""
    return audit(docs.select("text", "lang", "source"))
