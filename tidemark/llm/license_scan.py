"""License scan by diagonal voting, in DataFrame and SQL functions only.

All rolling k-grams of a text's words are joined by hash (and word by word) to the k-grams of license templates. A hit
at text word p and template word t votes for the diagonal p - t: the place where the template would start. Votes are
summed by diagonal, diagonals at most `gap` apart are merged into one span (that bridges inserted or missing words),
and a span is verified by the share of the template's k-grams it covers and by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii

K = 3
# The base phrases and labels of the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening or naming sentences of well-known public licenses and notices, as words.
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ],
    "gpl-3": [
        "licensed under the gnu general public license version 3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "gpl-2": [
        "licensed under the gnu general public license version 2",
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of a text (null: empty)."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPLIT)
    lead = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    trail = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, 1 + lead, F.greatest(F.size(parts) - lead - trail, F.lit(0)))


def templates(spark: SparkSession, base: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(template, label, base, grams, t, g1, g2, g3): a row for each k-gram. A fixed list: always small."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    rows, number = [], 0
    for label, phrase, is_base in [*((b, a, True) for a, b in base.items()), *((a, p, False) for a, ps in notices.items() for p in ps)]:
        w = phrase.split()
        if len(w) < K:
            raise ValueError(f"a template has {K} words at least: {phrase}")
        for t in range(len(w) - K + 1):
            g = ", ".join(f"'{x}'" for x in w[t : t + K])
            rows.append(f"({number}, '{label}', {str(is_base).lower()}, {len(w) - K + 1}, {t}, {g})")
        number += 1
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, base, grams, t, g1, g2, g3)")


def spans(docs: DataFrame, least: float = 0.7, gap: int = 2, **lists) -> DataFrame:
    """(doc_id, th, n_words, label, base, start, end, coverage): verified spans in words, end exclusive; th: hash of the text.

    A base phrase is a span only where all its words stand consecutively; a notice is one where merged diagonals
    cover `least` of its k-grams within its length plus half. One more row for each text has n_words, else null, and no
    span. Texts are read and cut into words once.
    """
    cut = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    grams = F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"), F.expr("slice(w, 3, size(w))").alias("c"))
    size = F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c"), F.size("w").cast("long").alias("n"))
    whole = F.transform(F.filter(grams, lambda g: g["c"].isNotNull()), lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"), g["c"].alias("c"), F.lit(None).cast("long").alias("n")))
    rows = (
        cut.select("doc_id", "th", F.posexplode(F.concat(F.array(size), whole)).alias("pos", "g"))
        .select("doc_id", "th", (F.col("pos") - 1).alias("pos"), *[F.col(f"g.{x}").alias(x) for x in ("a", "b", "c")], F.col("g.n").alias("n_words"))
        .withColumn("h", F.when(F.col("c").isNotNull(), F.xxhash64("a", "b", "c")))
    )
    t = F.broadcast(templates(docs.sparkSession, **lists).withColumn("h", F.xxhash64("g1", "g2", "g3")))  # a fixed list
    r, q = rows.alias("r"), t.alias("q")
    same = (F.col("r.h") == F.col("q.h")) & (F.col("r.a") == F.col("q.g1")) & (F.col("r.b") == F.col("q.g2")) & (F.col("r.c") == F.col("q.g3"))
    hits = r.join(q, same, "left").filter("q.t IS NOT NULL OR r.n_words IS NOT NULL").withColumn("diagonal", F.col("pos") - F.col("t"))
    of = ["doc_id", "th", "template"]
    votes = hits.groupBy(*of, "diagonal").agg(
        *[F.first(c).alias(c) for c in ("label", "base", "grams")], F.max("n_words").alias("n_words"), F.collect_set("t").alias("ts"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    line = W.partitionBy(*of).orderBy("diagonal")
    near = ~F.col("base") & (F.col("diagonal") - F.lag("diagonal").over(line) <= gap)  # a base phrase never bridges a gap
    merged = (
        votes.withColumn("fresh", F.when(near, 0).otherwise(1))
        .withColumn("span", F.sum("fresh").over(line))
        .groupBy(*of, "span")
        .agg(
            *[F.first(c).alias(c) for c in ("label", "base", "grams", "n_words")],
            F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("covered"), F.min("lo").alias("start"), (F.max("hi") + K).alias("end"),
        )
        .withColumn("coverage", F.col("covered") / F.col("grams"))
    )
    whole = F.col("base") & (F.col("covered") == F.col("grams"))
    noticed = ~F.col("base") & (F.col("coverage") >= least) & (F.col("end") - F.col("start") <= 1.5 * (F.col("grams") + K))
    found = merged.filter(F.col("n_words").isNotNull() | whole | noticed)
    # of notices that start at one place (say two versions of a license), the best covered ones
    best = F.max("coverage").over(W.partitionBy("doc_id", "th", "start", "base"))
    found = found.withColumn("best", best).filter("n_words IS NOT NULL OR base OR coverage = best")
    return found.select("doc_id", "th", "n_words", "label", "base", *[F.when(F.col("n_words").isNull(), F.col(c)).alias(c) for c in ("start", "end", "coverage")])


def scan(docs: DataFrame, **how) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest start of those
    (null if none); score is the best coverage of any span, else 0. Null and empty texts have no words, texts of any
    length are read whole, and an empty table gives an empty one. Repeated rows are judged alike, whatever their ids;
    columns of docs with one of these names are replaced.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans"]
    docs = docs.drop(*new)
    found = spans(docs.select("doc_id", "text"), **how)
    on_base = F.when(F.col("base"), F.col("start"))
    sums = found.groupBy("doc_id", "th").agg(
        F.count(on_base).alias("n_base"), F.min(on_base).cast("long").alias("first_word"), F.max(on_base).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("bl"), F.sort_array(F.collect_set("label")).alias("l"),
        F.max("coverage").alias("score"), F.count(F.when(~F.col("base"), 1)).alias("n_spans"), F.max("n_words").alias("n_words"),
    )
    # rows of equal id and text vote together, so their spans are found once and joined to each
    d = docs.withColumn("_th", F.xxhash64("text")).alias("d")
    r = sums.alias("r")
    both = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d._th") == F.col("r.th")), "left")
    return both.select(
        *[F.col(f"d.{c}") for c in docs.columns], "r.n_words", F.coalesce("r.n_base", F.lit(0)).cast("long").alias("n_base"), "r.first_word", "r.last_word",
        F.concat_ws(",", F.col("r.bl")).alias("base_labels"), F.concat_ws(",", F.col("r.l")).alias("labels"), F.coalesce("r.score", F.lit(0.0)).alias("score"),
        F.coalesce("r.n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def op3(docs: DataFrame) -> DataFrame:
    """License labels of every whole text of documents."""
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans")
