"""The whole pipeline against plain stages, with a fixed rule in place of the network; line runs that are kept."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm import plain
from tests.llm.test_ops import ODD, SCHEMA, docs, near_brute, words_of
from tidemark.llm import line_dedup

LINES = ["A line that is long enough to count", "  a LINE that is long enough to count\t", "short", "", "Ünï codé line with twenty points", "another long line, number two of it"]


def test_run_equals_plain_stages(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = []
    for i in range(160):
        t = text(rng.randint(5, 60)) + rng.choice(["", "\n" + rng.choice(LINES), "\nhateful words here", "\n" + rng.choice(LINES)])
        rows.append((i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t)))
        if rng.random() < 0.2:
            rows.append((1000 + i, t.replace(" ", "  ", 1), "en", "c", len(t)))
    benchmark = [(1, " ".join(rows[3][1].split()[:12])), (2, None), (3, rows[50][1]), (4, text(30))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(P, "STAGES", [("toxicity", lambda s, d, _: d.filter("text NOT LIKE '%hateful%'")), *P.STAGES[1:]])
    got = P.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if "hateful" not in r[1]]
    texts = {}
    for i, t in ((r[0], r[1]) for r in kept):
        texts[i] = t
    after = plain.line_dedup([(r[0], r[1]) for r in kept])
    digest = {i: h for i, _, _, h in after}
    # the plain version gives digests: rewrite by its rule to have the texts
    held = {}
    for i, t in texts.items():
        for k in {a.strip(" \t\n\x0b\x0c\r").lower() for a in t.split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, set()).add(i)
    for i, t in texts.items():
        texts[i] = "\n".join(a for a in t.split("\n") if len(ids := held.get(a.strip(" \t\n\x0b\x0c\r").lower(), set())) < 3 or max(ids) == i)
        assert hashlib.sha256(texts[i].encode()).hexdigest() == digest[i]
    one = sorted(set(near_brute(list(texts.items())).values()))
    windows = {tuple(w[s : s + min(10, len(w))]) for _, b in benchmark for w in [words_of(b)] if w for s in range(max(1, len(w) - 9))}
    clean = [i for i in one if not any(tuple(w[s : s + n]) in windows for w in [words_of(texts[i])] for n in {len(x) for x in windows} for s in range(len(w) - n + 1))]
    assert len(rows) > len(kept) > len(one) > len(clean)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((i, texts[i], len(texts[i])) for i in clean)
    assert len({(r.mix_slot, r.mix_pos) for r in got}) == len(got)


@pytest.mark.parametrize("empty", ["documents", "benchmark", "labels"])
def test_run_on_an_empty_table(spark, tmp_path, empty):
    tables = {"documents": (ODD, None), "benchmark": ([(1, "nothing of it stands anywhere")], "item_id long, text string"), "labels": ([(4, 0), (6, 1)], "doc_id long, toxic int")}
    for name, (rows, schema) in tables.items():
        df = docs(spark, rows) if schema is None else spark.createDataFrame(rows, schema)
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = P.run(spark, str(tmp_path))
    assert set(P.COLUMNS) <= set(got.columns)
    assert (got.count() == 0) == (empty == "documents")


# --- runs of line keys


def lines_of(seed, ids):
    rng = random.Random(seed)
    return [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 4)))) for i in ids]


def outcome(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, plain.digest(r.text)) for r in df.collect())


def test_later_documents_against_kept_runs_equal_one_run_over_all(spark):
    """Ids of the batches interleave, so that holders change hands both ways."""
    parts = [lines_of(s, range(s, 90, 3)) for s in range(3)]
    whole = plain.line_dedup([r for p in parts for r in p])
    runs = line_dedup.Runs(2)
    for k, p in enumerate(parts):
        got = outcome(line_dedup.dedup_lines(docs(spark, p), batches=k + 1, runs=runs))
    ids = {i for i, _ in parts[2]}
    assert got == sorted(r for r in whole if r[0] in ids)
    # earlier documents, judged again by what is known now
    assert outcome(line_dedup.apply_runs(runs, docs(spark, parts[0] + parts[1]))) == sorted(r for r in whole if r[0] not in ids)
    fresh = Counter(r.fresh for r in runs.all().collect())
    assert fresh[True] >= 1 and all(len(level) < 2 for level in runs.levels)
    runs.drop()
    assert not runs.live()


def test_result_depends_on_the_merge(spark, monkeypatch):
    rows = [(i, f"a line that three or four documents hold: {i % 12}\nend") for i in range(40)]
    want = sorted(plain.line_dedup(rows))
    tables = {t.name for t in spark.catalog.listTables()}
    assert outcome(line_dedup.dedup_lines(docs(spark, rows))) == want
    assert {t.name for t in spark.catalog.listTables()} == tables  # runs and batches are dropped
    monkeypatch.setattr(line_dedup.Runs, "live", lambda self: [])
    monkeypatch.setattr(line_dedup.Runs, "all", lambda self: line_dedup.union([r for level in self.levels for r in level]))
    monkeypatch.setattr(line_dedup.Runs, "_compact", lambda self: None)
    assert outcome(line_dedup.dedup_lines(docs(spark, rows))) != want
