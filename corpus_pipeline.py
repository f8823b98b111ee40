"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination and mixing, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from tidemark.llm.common import remainder
from tidemark.session import release, saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5; learned from labels whose crc32 remainder by 5 is not 0.

    Null and empty texts and texts without words score 0 and stay; repeated rows are judged alike. Without labels of both
    kinds every text gets the kind there is (0 if there is none). An empty table gives an empty one.
    """
    release(spark)
    held = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    return toxicity.score(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share; n_chars follows the text, and none is dropped.

    The largest doc_id keeps a shared line. Rows of one doc_id are one document, rows without an id keep all lines. Null
    texts become empty ones. An empty table gives an empty one.
    """
    release(spark)
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id, of equal ids that of the smallest text hash.

    Null ids come last. Texts without words (null and empty ones too) are no duplicates of each other; of rows that repeat
    id and text one stays. An empty table gives an empty one.
    """
    release(spark)
    return near_dup.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word passage of the benchmark.

    Null texts have no words and stay, as all do if the benchmark is empty or has no words. Repeated rows are judged alike.
    An empty table gives an empty one.
    """
    release(spark)
    return decontaminate.find(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in their order of training: mix_slot and mix_pos, with the release and deadline of the slot.

    A null source is a source of its own; repeated rows and rows without an id get a place each, and ties of deadlines fall
    in the order of the sources. An empty table gives an empty one.
    """
    release(spark)
    return mixing.mix(docs.select(*COLUMNS)).orderBy("mix_slot", "mix_pos", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity stage is a trained network, which SQL cannot state; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
