"""Line deduplication with levelled sorted runs of line keys.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` and with A-Z lower-cased, held as a 128-bit hash. Keys enter
batch by batch. Each batch is merged with the runs: keys not in them are fresh, the others take up the number of documents
and the holder that the runs know and go on from there. What the batch brings is written as a new sorted run, whose rows
stand for all that is known of their keys so far, and `fanout` runs of a level are compacted into one run of the next level.
Batches and runs are bucketed and sorted by key, so that a merge joins bucket with bucket and moves no row. Runs can be kept:
documents that come later are merged with them, and nothing of the earlier ones is read again.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import forget, run_dir, saved

BLANK = b" \t\n\x0b\x0c\r"
RUN = "h1 long, h2 long, n long, holder long, fresh boolean"


def line_keys(text: bytes, least: int) -> list[bytes]:
    """Digest of each line's key, b'' for keys under `least` code points."""
    out = []
    for line in text.split(b"\n"):
        k = line.strip(BLANK).lower()  # of bytes: A-Z only
        if len(k) < least or (not k.isascii() and len(k.decode("utf-8", "replace")) < least):
            out.append(b"")
        else:
            out.append(xxhash.xxh3_128_digest(k))
    return out


def bucketed(df: DataFrame, buckets: int, *parts: str) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by key; parts: partition columns."""
    spark, name = df.sparkSession, f"tidemark_run_{uuid.uuid4().hex}"
    w = df.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{run_dir(spark)}/{name}")
    (w.partitionBy(*parts) if parts else w).saveAsTable(name)
    out = spark.table(name)
    out._tidemark_path, out._tidemark_table = f"{run_dir(spark)}/{name}", name
    return out


class Runs:
    """Levelled runs of (h1, h2, n, holder, fresh), each a bucketed and sorted table in the shared folder.

    n and holder of a row hold for all documents up to its batch, so of a key's rows the newest counts, which has the largest
    n; fresh marks its first one. There are fewer than fanout runs on each level, and one more level for fanout times the
    batches. A lost executor costs the tasks it ran, nothing else. drop() deletes all tables.
    """

    def __init__(self, fanout: int = 3, buckets: int | None = None) -> None:
        self.fanout, self.buckets, self.levels = fanout, buckets, [[]]

    def live(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def all(self) -> DataFrame | None:
        """The rows of all runs, read without their buckets: those of a union are not in one place."""
        return union(self.live()) if self.live() else None

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge one batch of (h1, h2, n, holder), a row for each key. Returns its run; fresh rows are new keys."""
        run = batch.select("h1", "h2", "n", "holder", F.lit(None).cast("long").alias("n0"), F.lit(None).cast("long").alias("h0"))
        for r in self.live():
            known = r.select("h1", "h2", F.col("n").alias("n1"), F.col("holder").alias("holder1"))
            run = run.join(known, ["h1", "h2"], "left").select("h1", "h2", "n", "holder", F.greatest("n0", "n1").alias("n0"), F.greatest("h0", "holder1").alias("h0"))
        run = self._write(run.select("h1", "h2", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.greatest("holder", "h0").alias("holder"), F.col("n0").isNull().alias("fresh")))
        self.levels[0].append(run)
        self._compact()
        return run

    def drop(self) -> None:
        for r in self.live():
            _drop(r)
        self.levels = [[]]

    def _write(self, run: DataFrame) -> DataFrame:
        return bucketed(run.select("h1", "h2", "n", "holder", "fresh"), self.buckets or int(run.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            old = self.levels[k]
            self.levels[k + 1].append(self._write(totals(union(old))))
            self.levels[k] = []
            for r in old:
                _drop(r)


def _drop(table: DataFrame) -> None:
    table.sparkSession.sql(f"DROP TABLE {table._tidemark_table}")
    forget(table)


def union(runs: list[DataFrame]) -> DataFrame:
    """Rows of several runs, from their files."""
    return runs[0].sparkSession.read.schema(runs[0].schema).parquet(*[r._tidemark_path for r in runs])


def totals(runs: DataFrame) -> DataFrame:
    """The newest row of each key: counts and holders only grow."""
    return runs.groupBy("h1", "h2").agg(F.max("n").alias("n"), F.max("holder").alias("holder"), F.max("fresh").alias("fresh"))


def dedup_lines(docs: DataFrame, least: int = 20, most_docs: int = 3, batches: int = 4, fanout: int = 3, runs: Runs | None = None) -> DataFrame:
    """docs with text rewritten, and n_lines and n_dropped (columns of docs with these names are replaced).

    A key of at least `least` code points that stands in at least `most_docs` documents loses all its lines but those of
    the largest doc_id that holds it. Rows of one doc_id are one document: they count once and all keep the lines their
    id holds. Rows without an id count for nothing and keep their lines; ids are whole numbers. Null and empty texts are one
    empty line (text becomes ""). Texts and lines of any length are read whole. An empty table gives an empty one.

    runs: those of documents that came before; docs (with ids that were not among them) are merged into them and judged by
    all. Without, runs are made for this call and dropped.
    """
    kept = Runs(fanout, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if runs is None else runs
    add_documents(kept, docs, least, batches)
    out = apply_runs(kept, docs, least, most_docs)
    if runs is None:
        kept.drop()
    return out


def add_documents(runs: Runs, docs: DataFrame, least: int = 20, batches: int = 4) -> None:
    """Merge the line keys of docs into runs, in `batches` batches of about as many documents, by ranges of their ids."""
    buckets = runs.buckets = runs.buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / batches for k in range(1, batches)], 0.02) if batches > 1 else []
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.when(F.col("doc_id") > F.lit(c), 1).otherwise(0)
    held = key_rows(docs.filter("doc_id IS NOT NULL").withColumn("_th", F.lit(0).cast("long")), least).select("h1", "h2", "doc_id").distinct()
    counted = held.withColumn("batch", batch).groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
    staged = bucketed(counted.repartition(buckets, "h1", "h2"), buckets, "batch")
    for k in range(len(cuts) + 1):
        runs.add(staged.filter(F.col("batch") == k).drop("batch"))
    _drop(staged)


def apply_runs(runs: Runs, docs: DataFrame, least: int = 20, most_docs: int = 3) -> DataFrame:
    """docs without the lines that runs, which hold docs too, know as common; see dedup_lines()."""
    docs = docs.drop("n_lines", "n_dropped")
    # a table of its own, so that Spark can split the partition of a line that very many documents hold
    common = saved(totals(runs.all()).filter(F.col("n") >= most_docs).select("h1", "h2", "holder"), "common-lines")
    th = F.xxhash64("text")
    lines = (
        key_rows(docs.withColumn("_th", th), least)
        .join(common, ["h1", "h2"])
        .filter("doc_id <> holder")
        .groupBy("doc_id", "_th")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_drop"))
    )
    d, r = docs.withColumn("_th", th).alias("d"), lines.alias("r")
    joined = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d._th") == F.col("r._th")), "left").select(*[F.col(f"d.{c}") for c in docs.columns], "r._drop")
    return _rewrite(joined, docs.columns, least)


def key_rows(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, _th, h1, h2) of each row's long keys."""

    def run(batches):
        for batch in batches:
            ids, ths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())
            for i in range(0, len(ids), 500):
                d, t, flat = [], [], []
                for doc, th, text in zip(ids[i : i + 500], ths[i : i + 500], texts.slice(i, 500).to_pylist(), strict=True):
                    keys = set(line_keys(text or b"", least)) - {b""}
                    flat += keys
                    d += [doc] * len(keys)
                    t += [th] * len(keys)
                h = np.frombuffer(b"".join(flat), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "_th", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), "_th", F.coalesce("text", F.lit(""))).mapInArrow(run, "doc_id long, _th long, h1 long, h2 long")


def _rewrite(joined: DataFrame, columns: list[str], least: int) -> DataFrame:
    schema = joined.drop("_drop").select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    for f in schema.fields:
        f.nullable = True
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            drops, texts = batch.column(len(columns)), batch.column(at).cast(pa.large_binary())
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                kept, n, gone = [], [], []
                for text, drop in zip(texts.slice(i, 500).to_pylist(), drops.slice(i, 500), strict=True):
                    text = text or b""
                    n.append(text.count(b"\n") + 1)
                    if drop.is_valid:
                        s = drop.values
                        h = np.stack([s.field("h1").to_numpy(), s.field("h2").to_numpy()], axis=1).astype("<i8")
                        bad = {row.tobytes() for row in h}
                        lines = [a for a, k in zip(text.split(b"\n"), line_keys(text, least), strict=True) if k not in bad]
                        gone.append(n[-1] - len(lines))
                        kept.append(b"\n".join(lines))
                    else:
                        gone.append(0)
                        kept.append(text)
                cols = part.columns[: len(columns)]
                cols[at] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def op7(docs: DataFrame) -> DataFrame:
    """Digest of dedup_lines over documents."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
