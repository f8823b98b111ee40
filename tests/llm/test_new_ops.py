"""URL filter, source divergence and centroid clustering: SQL, brute force and odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tidemark.llm import clustering, divergence, queries, url_filter

UP = {c: c + 32 for c in range(65, 91)}
NEW = ["op11_url_filter", "op12_source_divergence", "op13_centroid_clustering"]


@pytest.mark.parametrize("name", NEW)
def test_whole_tables_match_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = c.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(map(str, r)) for r in cur.fetchall())
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


# --- op11


def url_parts(url):
    a = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", a)[0]
    return host.translate(UP), re.match(r"[^?#]*", a[len(host) :])[0]


def judged(url, rules, otherwise="allow"):
    host, path = url_parts(url)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, otherwise)


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1?q=/en/", "http://example.com", "http://example.com/", "http://example.com/en", "http://a.b.example.com/en/x#/y",
    "http://badexample.com/en/1", "http://www.example.com/EN/1", "x://y://example.com/en/", "http://a.net/fr/", "http://a.net/es", "http://net/es/", "http://.com/", "http://com./", "http://user@a.com:80/x", "http://a.com?x=/",
    "http://É.com/ünï/x", "http://a.com/" + "a/" * 20_000, "http://" + "a." * 20_000 + "com/", "http://a.com/\n?x",
]


def test_url_filter_equals_a_look_at_every_rule(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "ab", "com", "net"])
    urls = URLS + [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{'/'.join(part() for _ in range(rng.randint(0, 3)))}{rng.choice(['', '/', '?a', '#b'])}" for _ in range(300)] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = [(".".join(part() for _ in range(rng.randint(1, 3))), rng.choice(["/", "/a", "/ab/", "/a/b", "", "/com"]), rng.choice(["allow", "block"])) for _ in range(60)]
    more = list({(h, p): (h, p, v) for h, p, v in more}.values())
    for rules in (url_filter.RULES, more, []):
        got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "block").collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judged(u, rules, "block") for i, u in enumerate(urls)}
        assert len(got) == len(urls)


def test_odd_rules_and_clashing_columns(spark):
    rules = spark.createDataFrame([("A.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("b.com", None, "block"), ("c.com", "/", "maybe"), ("d.com", "/", None)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "x", 1), (1, "http://a.com/", "x", 1), (None, "http://b.com", "y", 2), (3, "http://c.com/", "z", 3), (4, "http://d.com/", "z", 3)], "page_id long, url string, verdict string, prefix int")
    got = url_filter.judge(pages, rules)
    assert got.columns == ["page_id", "url", "prefix", "host", "path", "rule", "verdict"]
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in got.collect()) == [("1", "a.com/", "block"), ("1", "a.com/", "block"), ("3", None, "allow"), ("4", None, "allow"), ("None", "b.com", "block")]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_runs_no_python(spark):
    df = queries.op11_url_filter(spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# --- op12


def audit(rows, least=3, top=200):
    """What audit() returns, in plain Python."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = term.findall((text or "").translate(UP))
        counts[lang or "", source or ""].update(w)
        df[lang or ""].update(set(w))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        p = {s: [counts[a, s][t] for t in kept] for a, s in counts if a == lang}
        whole = [sum(x) for x in zip(*p.values(), strict=True)]
        share = lambda n: [1 + 10**9 * (x + 1) // (sum(n) + len(n)) for x in n]
        q = share(whole)
        for s in p:
            ps = share(p[s])
            pairs = [(sum((x - y) ** 2 // y for x, y in zip(ps, share(p[o]), strict=True)), o) for o in p if o != s]
            marks = [((x - y) ** 2 // y, t) for x, y, t, n in zip(ps, q, kept, p[s], strict=True) if n and x > y]
            for part, found, most in (("pair", pairs, None), ("term", marks, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def rows_for_audit(seed, n, sources, words):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abzÉñ漢𝄞") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    return [(" ".join(rng.choices(vocab, k=rng.randint(0, 30))).replace("b", rng.choice("bB")), rng.choice(["en", "de"]), f"s{rng.randrange(sources)}") for _ in range(n)]


ODD = [(None, "en", "s0"), ("", "en", "empty"), ("1 2 3 @[`{~", "en", "s1"), ("alpha", None, None), ("alpha alpha", None, "x"), ("ALPHA", None, "x"), ("lonely", "xx", "only"), ("word " * 60_000, "en", "s0"), ("long" * 300_000, "en", "s1"), (None, "none", "a"), (None, "none", "b")]


@pytest.mark.parametrize(("block", "terms", "counters", "cut"), [(64, 2048, 400_000, 1 << 20), (2, 10, 50, 64)])
def test_audit_equals_plain_counts(spark, monkeypatch, block, terms, counters, cut):
    for name, x in (("BLOCK", block), ("TERMS", terms), ("COUNTERS", counters), ("ENTRIES", counters), ("BAG", terms // 4), ("SLICE", cut)):
        monkeypatch.setattr(divergence, name, x)
    rows = rows_for_audit(3, 300, 7, 60) + ODD + ODD
    docs = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int").repartition(6)
    got = sorted(tuple(r) for r in divergence.audit(docs).collect())
    assert got == audit(rows)


def test_audit_of_nothing_and_of_few_ranks(spark):
    docs = spark.createDataFrame(rows_for_audit(4, 200, 3, 80), "text string, lang string, source string")
    assert divergence.audit(docs.limit(0)).count() == 0
    assert sorted(tuple(r) for r in divergence.audit(docs, 2, 5).collect()) == audit([tuple(r) for r in docs.collect()], 2, 5)


def test_shares_are_exact_for_huge_counts(spark):
    n, total = 3 * 10**14 + 7, 8 * 10**15 + 1
    want = 1 + 10**9 * (n + 1) // total
    assert divergence.shares(np.array([n]), np.array([total]))[0] == want
    assert spark.range(1).select(divergence.share(F.lit(n), F.lit(total)).alias("p")).first().p == want


@pytest.mark.parametrize("bag", [1, 7, 1024])
def test_trie_walks_in_byte_order(monkeypatch, bag):
    monkeypatch.setattr(divergence, "BAG", bag)
    rng = random.Random(2)
    keys = ["".join(rng.choice("aé漢b") for _ in range(rng.randint(0, 6))).encode() for _ in range(500)]
    trie = divergence.Trie()
    for k in keys:
        trie.leaf(k)[None] += 1
    assert [(k, leaf[None]) for k, leaf in trie.walk()] == sorted(Counter(keys).items())


# --- op13


def kmeans(rows, k=40, rounds=5, dim=64):
    """What cluster() returns, in plain Python."""
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    h = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes())
    c = [q for _, q in sorted(kept, key=h)[:k]]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(q, m, strict=True)) for m in c] for _, q in kept]
        a = [min(range(len(c)), key=lambda j, x=x: (x[j], j)) for x in d]
        if r < rounds:
            for j in range(len(c)):
                own = [q for (_, q), at in zip(kept, a, strict=True) if at == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    best = [x[j] for x, j in zip(d, a, strict=True)]
    return sorted(
        ((i, j, x, sum(y for y, b in zip(best, a, strict=True) if b == j), sum(best), plain.digest(",".join(map(str, c[j])))) for (i, _), j, x in zip(kept, a, best, strict=True)), key=str
    )


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim)) * spread
    return [(i, (centers[rng.integers(6)] + rng.normal(size=dim) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dim", "k", "spread"), [(8, 40, 1.0), (3, 25, 0.0), (4, 12, 100_000.0), (8, 1, 1.0)])
def test_clusters_equal_a_full_scan(spark, dim, k, spread):
    rows = vectors(dim, 400, dim, spread)
    rows += rows[:20] + [(900 + i, rows[3][1]) for i in range(60)] + [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(1000, None), (1001, []), (1002, [1.0]), (1003, [float("nan")] * dim), (1004, [None] * dim), (1005, [float("inf")] * dim), (1006, [0.0] * dim), (1007, [-0.0] * dim)]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = sorted((tuple(r) for r in clustering.cluster(df, k, 5, dim).collect()), key=str)
    assert got == kmeans(rows, k, 5, dim)


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], schema), dim=2).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema), dim=2).count() == 0
    rows = [(i, [0.5, -0.25]) for i in range(30)]
    got = sorted((tuple(r) for r in clustering.cluster(spark.createDataFrame(rows, schema), 5, 3, 2).collect()), key=str)
    assert got == kmeans(rows, 5, 3, 2)
    far = clustering.cluster(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0])], schema), 1, 1, 2).collect()
    assert {r.cluster for r in far} == {0} and all(r.distance > 0 for r in far)


def test_bounds_leave_out_work():
    """Filters skip most distances once centroids are at rest, and the outcome is that of a full scan."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(3000, 16)) * 50 + rng.integers(0, 12, (3000, 1)) * 400).astype(np.int32)
    c = x[:24].astype(np.int64)
    of = clustering.grouped(c, 3)
    of = np.unique(of, return_inverse=True)[1]
    a, best, lower = clustering.nearest(x, c, of)
    upper, work = np.sqrt(best), 0
    for _ in range(6):
        new = np.stack([np.floor(x[a == j].mean(axis=0)) if (a == j).any() else c[j] for j in range(24)]).astype(np.int64)
        drift = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + clustering.SLACK) + clustering.LEAST
        c = new
        a, upper, lower, n = clustering.moved(x, a, upper, lower, c, drift, of)
        work += n
        full = clustering.nearest(x, c, of)
        assert (a == full[0]).all() and (lower <= full[2] * (1 + 1e-6) + 1e-3).all() and (upper >= np.sqrt(full[1]) - 1e-3).all()
    assert work < 0.6 * 6 * 3000 * 24


# --- op8: many pivots


def test_links_with_many_pivots_in_small_blocks_equal_brute_force(spark, monkeypatch):
    """Several thousand vectors, as many pivots as are allowed, and rows in blocks of a few."""
    from tidemark.llm import embedding_dup

    for name, x in (("CELL", 50), ("MAX_PIVOTS", 64), ("GAPS", 256)):
        monkeypatch.setattr(embedding_dup, name, x)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((700, 12))
    rows = [(i, (base[rng.integers(700)] + rng.standard_normal(12) * rng.choice([0.0, 0.15, 0.6])).tolist(), int(i % 3 == 0)) for i in range(3000)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.op8(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([e for _, e, _ in rows])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    label = np.array([c for _, _, c in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(3000)
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], 3000).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert got == {i: (int(near[i].sum()), int(comp[i])) for i in range(3000)}


def test_toxicity_scores_without_tanh_as_the_plain_network(monkeypatch):
    """Scoring takes exp alone, which costs half of tanh, and gives what the network's formulas give word by word."""
    import numpy as np

    from tidemark.llm import toxicity as T

    rng = np.random.default_rng(3)
    net, n = T.Net(rng), 9
    p = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in net.p.items()}
    net.p = p
    x, inv = rng.standard_normal((40, T.INPUTS)).astype(np.float32) * 3, rng.integers(0, 40, 60)
    sig, h, want = lambda a: 1 / (1 + np.exp(-a)), T.HIDDEN, []
    for s in range(n):
        words, states = x[inv[s : s + T.WINDOW]].astype(float), {}
        for d, order in (("f", range(T.WINDOW)), ("b", range(T.WINDOW - 1, -1, -1))):
            at = np.zeros(h)
            for k in order:
                g = words[k] @ p[f"W{d}"] + p[f"b{d}"]
                z, r = np.split(sig(g[: 2 * h] + at @ p[f"U{d}"][:, : 2 * h]), 2)
                at = at + z * (np.tanh(g[2 * h :] + (r * at) @ p[f"U{d}"][:, 2 * h :]) - at)
                states[d, k] = at
        both = np.array([np.concatenate([states["f", k], states["b", k]]) for k in range(T.WINDOW)])
        e = np.exp(np.tanh(both @ p["A"] + p["a"]) @ p["v"])
        want.append((e / e.sum()) @ both @ p["w"] + p["c"][0])
    monkeypatch.setattr(T.np, "tanh", None)
    got = net.window_logits(net.table(x), inv, np.arange(n))
    assert np.abs(got - np.array(want)).max() < 1e-4
