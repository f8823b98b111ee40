"""Personal data by a skip-chain conditional random field over base patterns.

Base spans come from fixed patterns (email, ip, card, phone). The field then labels the document's candidate tokens,
numbers with their separators and runs that hold an at sign: a token's potentials come from its shape and from the
words around it, neighbouring candidates share chain potentials, and equal or similar tokens, however far apart, share
skip potentials (each with the previous one of its key, so their number is linear). Tokens inside base spans are clamped
to their label. Loopy max-product passing runs until it settles. A free token that ends in an entity label becomes a
span of the method: with a small margin if a skip chain ties it to a base span of that label, with a larger one if its
own shape and context must carry it. So a number that once stands in full, as `+1 (555) 010-2030`, is also found where
it stands without its prefix or with other separators, and so is a card whose digits run into another number. Weights
are learned here from texts in which the base patterns stand for labels.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_texts, class_sample

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Numbers joined by single dots; four at a time are what the base pattern `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)` finds.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-]{0,2}[0-9])*")
#: Digits that stand alone even within a longer number: as many as the shortest card has, less one.
UNBROKEN = re.compile(r"[0-9]{13,}")
#: Bounds of the training sample: different texts that hold a digit or an at sign, and their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 4_000_000
#: Least margins of a free token's label: tied to a base span of that label by skips, and alone.
TIED, ALONE = 1.0, 2.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without running the pattern over text that has no at sign near."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and LOCAL.match(text[a - 1]):
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of four dotted numbers, in one pass over the text; those with a part over 255 are dropped."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping spans of each kind in code points; failing matches are dropped without a retry."""
    out = [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(a, b, "ip") for a, b in addresses(text)]
        for m in CARD.finditer(text):
            d = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 80 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def features(token: str, before: str, after: str) -> list[str]:
    d = len(digits_of(token))
    shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", token))[:12]
    return [
        "bias", f"shape={shape}", f"digits={min(d, 20)}", f"at={'@' in token}", f"dots={min(token.count('.'), 4)}", f"hyphens={min(token.count('-'), 4)}",
        f"luhn={14 <= d <= 19 and luhn(digits_of(token))}", f"octets={bool(re.fullmatch(r'(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}', token))}",
        f"before={before.lower()[:12]}", f"after={after.lower()[:12]}", f"plus={token.startswith('+')}",
    ]


def skip_keys(token: str) -> tuple[str | None, list[str]]:
    """What equal tokens share, and what similar ones do.

    Equal: the last nine digits of long numbers, the four parts of an address, an address of mail in lower case.
    Similar: the last seven digits, the first three parts, the part before the at sign.
    """
    if "@" in token:
        t = token.strip(".,:!?").lower()
        return t, [t.split("@")[0] + "@"]
    d = digits_of(token)
    parts = re.findall("[0-9]+", token)
    if len(parts) == 4 and len(d) <= 12 and all(len(p) <= 3 for p in parts) and len(d) not in (10, 11):
        return ".".join(parts), [".".join(parts[:3]) + "."]
    return (d[-9:] if len(d) >= 9 else None), ([d[-7:]] if len(d) >= 7 else [])


def numbers(text: str) -> list[tuple[int, int]]:
    """Numbers with their separators; a long unbroken run of digits stands alone, and so does what lies beside it."""
    out = []
    for m in NUMBER.finditer(text):
        runs = [r.span() for r in UNBROKEN.finditer(text, *m.span())]
        if not runs or (len(runs) == 1 and runs[0][0] - m.start() <= 1 and runs[0][1] == m.end()):
            out.append(m.span())
            continue
        at = m.start()
        for a, b in [*runs, (m.end(), m.end())]:
            out += [r.span() for r in NUMBER.finditer(text, at, a)]
            if a < b:
                out.append((a, b))
            at = b
    return out


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, word before, word after) of numbers with separators, and of tokens with an at sign, in order."""
    out = []
    if "@" in text or DIGIT.search(text):
        spans = numbers(text)
        k = text.find("@")
        while k >= 0:
            a, b = k, k + 1
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            spans.append((a, b))
            k = text.find("@", b)
        for a, b in sorted(spans):
            if out and a < out[-1][1]:
                if b > out[-1][1] and "@" in text[a:b]:
                    out[-1] = (min(a, out[-1][0]), b, out[-1][2], "")
                continue
            left = re.search(r"(\S+)\s*$", text[max(0, a - 30) : a])
            right = re.match(r"\s*(\S+)", text[b : b + 30])
            out.append((a, b, left[1] if left else "", right[1] if right else ""))
    return out


class Crf:
    """Label weights by feature, and weights of label pairs over chain, equal and similar edges; label 0 is none."""

    def __init__(self) -> None:
        n = len(KINDS) + 1
        self.w: dict[str, np.ndarray] = {}
        self.pair = np.zeros((3, n, n))  # chain, equal, similar

    def node(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(len(KINDS) + 1)
        return np.array([sum((self.w.get(f, zero) for f in fs), zero) for fs in feats])

    def infer(self, node: np.ndarray, edges: list[tuple[int, int, int]], fixed: np.ndarray | None = None) -> np.ndarray:
        """Beliefs (scaled log max-marginals) by loopy max-product passing over (a, b, type) edges until they settle.

        A sweep goes over the tokens forward and then backward, and each message uses those before it in the sweep, so
        that one sweep carries a label along a chain of any length. Messages that still move after many sweeps (loops
        can swing) are damped more and more, which ends any swing. In the first sweep only fixed tokens, if given, have
        potentials, so that what they state reaches all their repeats before those settle among themselves.
        """
        to_b, to_a = np.zeros((len(edges), node.shape[1])), np.zeros((len(edges), node.shape[1]))
        forth = sorted(range(len(edges)), key=lambda e: edges[e][:2])
        back = sorted(range(len(edges)), key=lambda e: edges[e][1::-1], reverse=True)
        belief = node.copy()
        if fixed is not None:
            belief[~fixed] = 0
        sweep, moved = 0, np.inf
        while moved >= 1e-3 and edges:
            step, moved = 1.0 if sweep < 4 else 0.5 if sweep < 20 else 0.5 * 0.8 ** (sweep - 20), 0.0
            for e in forth:
                a, b, m = edges[e]
                new = ((belief[a] - to_a[e])[:, None] + self.pair[m]).max(axis=0)
                d = step * (new - new.max() - to_b[e])
                to_b[e] += d
                belief[b] += d
                moved = max(moved, d.max(), -d.min())
            for e in back:
                a, b, m = edges[e]
                new = ((belief[b] - to_b[e]) + self.pair[m]).max(axis=1)
                d = step * (new - new.max() - to_a[e])
                to_a[e] += d
                belief[a] += d
                moved = max(moved, d.max(), -d.min())
            if fixed is not None and sweep == 0:
                belief[~fixed] += node[~fixed]
                moved = np.inf
            sweep += 1
        if fixed is not None and not edges:
            belief[~fixed] += node[~fixed]
        return belief


def layout(text: str) -> tuple[list, list[list[str]], list[tuple[int, int, int]], np.ndarray]:
    """Candidates, their features, edges (0 chain, 1 equal, 2 similar) and clamped labels (-1: free)."""
    cand = candidates(text)
    base = base_spans(text)
    label = np.full(len(cand), -1)
    j = 0
    for k, (a, b, _, _) in enumerate(cand):
        while j < len(base) and base[j][1] <= a:
            j += 1
        i = j
        while i < len(base) and base[i][0] < b:
            if base[i][1] > a:
                label[k] = 1 + KINDS.index(base[i][2])
                break
            i += 1
    keys = [skip_keys(text[a:b]) for a, b, _, _ in cand]
    edges = {(k, k + 1): 0 for k in range(len(cand) - 1)}
    last: dict[tuple, int] = {}
    stated: dict[tuple, int] = {}
    own = [[(1, same)] * (same is not None) + [(2, x) for x in like] for same, like in keys]
    for k, mine in enumerate(own):
        for key in mine:
            if key in last and edges.get((last[key], k), 0) == 0:
                edges[last[key], k] = key[0]
            last[key] = k
            if label[k] >= 0:
                stated.setdefault(key, k)
    # the weights of many free repeats in a row could outvote the one statement at their end: each hears it itself
    for k in np.flatnonzero(label < 0).tolist():
        for key in own[k]:
            at = stated.get(key)
            if at is not None and edges.get(pair := (min(at, k), max(at, k)), 0) == 0:
                edges[pair] = key[0]
    return cand, [features(text[a:b], x, y) for a, b, x, y in cand], [(a, b, m) for (a, b), m in edges.items()], label


def made_up(words: list[str], rng: np.random.Generator, n: int = 60) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, entities): an entity stated in full and again in another form, among words and numbers that are none.

    They teach the skip potentials; the words come from the sample, so that no word of theirs tells.
    """
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    fill = lambda: " ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(2, 7))))
    out = []
    for k in range(n):
        d = str(rng.integers(2, 10)) + digits(9)
        full = f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"
        bare = (f"{d[:3]}-{d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[3:6]}-{d[6:]}")[k % 4]
        c = "4" + digits(14)
        c += next(x for x in "0123456789" if luhn(c + x))
        dotted = ".".join(c[i : i + 4] for i in range(0, 16, 4))
        ip = [str(x) for x in rng.integers(1, 256, 4)]
        other, lot = digits(10 + k % 4), str(rng.integers(1, 5000))
        for kind, one, two in (("phone", full, bare), ("card", c, dotted), ("ip", ".".join(ip), "-".join(ip))):
            first, second = ((one, two), (two, one))[k % 2]
            out.append((f"{fill()} {first} {fill()} {other} {fill()} {second} {fill()}", [(kind, one), (kind, two)]))
        out.append((f"{fill()} {other} {fill()} {lot} {fill()} {other[:3]}-{other[3:6]}-{other[6:]} {fill()} {other}", []))
    return out


def fit(texts: list[str], rounds: int = 8) -> Crf:
    """Averaged structured perceptron on texts whose base patterns are the labels, and on made-up texts that repeat them.

    A free candidate that would be a base span if it stood alone counts as one. Deterministic.
    """
    crf, n = Crf(), len(KINDS) + 1
    rng = np.random.default_rng(5)
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]{2,12}", t[:2000])}) or ["and", "the", "of", "with"]
    data = []
    for t in texts:
        c, f, s, y = layout(t)
        if c:
            alone = [next((k for a, b, k in base_spans(t[a0:b0]) if b - a >= b0 - a0 - 1), None) for a0, b0, _, _ in c]
            gold = np.array([v if v >= 0 else 1 + KINDS.index(k) if k else 0 for v, k in zip(y.tolist(), alone, strict=True)])
            data.append((f, s, gold, np.zeros(len(c), bool)))
    for q, (t, spans) in enumerate(made_up(words, rng)):
        c, f, s, y = layout(t)
        gold = np.zeros(len(c), int)
        for kind, body in spans:
            at = t.find(body)
            for k, (a, b, _, _) in enumerate(c):
                if at <= a < at + len(body) or a <= at < b:
                    gold[k] = 1 + KINDS.index(kind)
        data.append((f, s, gold, (y >= 0) & (q % 3 < 2)))  # a third of them free: shapes must tell as well
    total: dict[str, np.ndarray] = {}
    sums = np.zeros_like(crf.pair)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            f, s, gold, clamp = data[k]
            node = crf.node(f)
            node[clamp] += np.where(np.arange(n) == gold[clamp][:, None], 50.0, 0)
            got = crf.infer(node - (np.arange(n) == gold[:, None]) * 2.0, s, clamp).argmax(axis=1)  # a margin
            for i in np.flatnonzero(got != gold):
                for name in f[i]:
                    w = crf.w.setdefault(name, np.zeros(n))
                    w[gold[i]] += 0.2
                    w[got[i]] -= 0.2
            for i, j, m in s:
                if m:  # one weight for agreement, whatever the label: a skip asks for consistency only
                    crf.pair[m] += 0.4 * (int(gold[i] == gold[j]) - int(got[i] == got[j])) * np.eye(n)
                else:
                    crf.pair[m, gold[i], gold[j]] += 0.05
                    crf.pair[m, got[i], got[j]] -= 0.05
        for name, w in crf.w.items():
            total[name] = total.get(name, np.zeros(n)) + w
        sums += crf.pair
    crf.w = {k: v / rounds for k, v in total.items()}
    crf.pair = sums / rounds
    return crf


def find_all(text: str, crf: Crf, tied: float = TIED, alone: float = ALONE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those that the field adds: free tokens whose label leads by a margin, a smaller one if tied."""
    base = base_spans(text)
    cand, feats, edges, label = layout(text)
    fixed = label >= 0
    if not cand or fixed.all():
        return base, []
    node = crf.node(feats)
    node[fixed] = np.where(np.arange(len(KINDS) + 1) == label[fixed][:, None], 50.0, -50.0)
    belief = crf.infer(node, edges, fixed)
    got = belief.argmax(axis=1)
    root = list(range(len(cand)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b, m in edges:
        if m:
            root[top(b)] = top(a)
    stated = {(top(k), label[k]) for k in np.flatnonzero(fixed).tolist()}
    added = []
    for k in np.flatnonzero(~fixed & (got > 0)).tolist():
        lead = belief[k, got[k]] - np.delete(belief[k], got[k]).max()
        if lead >= (tied if (top(k), got[k]) in stated else alone):
            added.append((cand[k][0], cand[k][1], KINDS[got[k] - 1]))
    return base, added


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Crf:
    """Weights from at most `rows` different texts that hold a digit or an at sign, those of the smallest text hash.

    Whole texts are drawn until their bytes reach the bound. One task learns from them, so that none reaches the driver.
    """
    some = docs.filter(F.col("text").rlike("[0-9@]")).select(F.lit(0).alias("kind"), "text")
    sample = bounded_texts(class_sample(some, "kind", "text", rows), "kind", most_bytes)

    def run(batches):
        texts = sorted(t for b in batches for t in b.column(0).to_pylist())
        crf = fit(texts)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([crf.w, crf.pair])], pa.binary())], names=["model"])

    crf = Crf()
    got = sample.select("text").coalesce(1).mapInArrow(run, "model binary").collect()
    crf.w, crf.pair = pickle.loads(bytes(got[0]["model"])) if got else (crf.w, crf.pair)
    return crf


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))


def tag(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """docs with pii: array of (start, end, kind, base) by start, then kind as listed; code points, end exclusive.

    Null and empty texts have none, and an empty table gives an empty one. Rows are independent, so repeated ones are
    tagged alike; a column pii of docs is replaced, others of any name pass. The patterns read a text of any length in
    one pass, and its tokens and edges grow with its length. Of labels that tie, the first (none, then as listed) wins.
    """
    docs = docs.drop("pii")
    b = docs.sparkSession.sparkContext.broadcast(crf)  # its size is set by the training sample's bound
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("pii", SPAN)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index(text)):
                base, added = find_all(t.as_py() or "", b.value)
                rows = [(*s, True) for s in base] + [(*s, False) for s in added]
                rows.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"start": s, "end": e, "kind": k, "base": own} for s, e, k, own in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op9(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of documents."""
    docs = docs.select("doc_id", "text")
    found = tag(docs, train(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))
