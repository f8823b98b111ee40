"""Secret scan with a random forest that removes false positives.

Candidates are long unbroken tokens with a digit or a known prefix, values assigned to telling names, and private key
headers. The forest judges each from its length, its character classes and transitions, the share that common words
cover, the path of its document and the words next to it. It is trained in numpy on labelled findings; without a set
of one's own, labelled_findings() makes one: keys of many formats in code, configuration and prose, and what is often
mistaken for them (digests, identifiers, names, placeholders, encoded text).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16,}(?![A-Za-z0-9+/=_-])")
#: Assignments are looked for only around these words: a pattern over the whole text would cost more.
NAMES = ("passw", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key")
NAME = re.compile("|".join(re.escape(n) for n in NAMES), re.I)
ASSIGNED = re.compile(r"[A-Za-z_.-]{0,20}[\"']?[ \t]{0,3}[:=]>?[ \t]{0,3}[\"']?")
#: What ends an assigned value; one of fewer characters than LEAST is none.
STOP = re.compile(r"[\s\"',;<>]")
LEAST = 6
HEADER = "-----BEGIN "
# Public prefixes of well-known key formats.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "SG.", "npm_", "pypi-", "eyJ")
# Words that say what stands beside them.
GOOD_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "credential", "bearer", "access_key", "private")
BAD_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "hash", "digest", "uuid", "id", "checksum", "etag", "revision", "example", "integrity", "session", "order", "isbn", "build")
PLACE = ("example", "xxxx", "your", "changeme", "placeholder", "dummy", "test", "sample", "1234567", "abcdef", "todo", "<", "${", "{{")
#: Common words and pieces of names, for dictionary coverage.
COMMON = tuple(
    "the and for with that this from get set list name user data file path test main type class value index count page item node base core util config service manager handler factory controller request response "
    "client server table column string number object array map key event action state view model form input output error message date time code line text info update create delete remove find read write load save "
    "image icon button header footer content width height color style version build release module package import export default common public private static internal system process thread session query".split()
)
PATHS = (".env", ".yml", ".yaml", ".json", ".py", ".js", ".lock", ".md", ".txt", ".pem", ".key", ".sum", "test", "docs", "example", "config")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(s: str) -> float:
    """Share of the letters that stand in common words of three letters or more."""
    low = s.lower()
    mark = bytearray(len(low))
    for w in COMMON:
        k = low.find(w)
        while k >= 0:
            mark[k : k + len(w)] = b"\x01" * len(w)
            k = low.find(w, k + 1)
    letters = sum(c.isalpha() for c in low)
    return sum(m and c.isalpha() for m, c in zip(mark, low, strict=True)) / max(1, letters)


def features(value: str, left: str, right: str, path: str) -> list[float]:
    cls = [_class(c) for c in value]
    n = len(value)
    moves = np.zeros((4, 4))
    for a, b in zip(cls, cls[1:], strict=False):
        moves[a, b] += 1
    share = [cls.count(k) / n for k in range(4)]
    before = re.findall(r"[A-Za-z_]+[0-9]*", left)[-3:]
    after = re.findall(r"[A-Za-z_]+[0-9]*", right)[:2]
    near = " ".join(before[-2:]).lower()
    low, p = value.lower(), path.lower()
    vowels = sum(c in "aeiou" for c in low) / max(1, sum(c.isalpha() for c in low))
    return [
        n, entropy(value), *share, (np.trace(moves)) / max(1, n - 1), moves[0, 1] / n, (moves[0, 2] + moves[2, 0]) / n, (moves[1, 2] + moves[2, 1]) / n, moves[:, 3].sum() / n,
        len(set(value)) / n, coverage(value), vowels, float(bool(re.fullmatch(r"[0-9a-f]+", low))), float(n in (32, 40, 64) and bool(re.fullmatch(r"[0-9a-f]+", low))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))), float(value.startswith(PREFIXES)), float(any(x in low for x in PLACE)),
        float(any(w in near for w in GOOD_WORDS)), float(any(re.search(rf"(^|[^a-z]){w}([^a-z]|$)", near) for w in BAD_WORDS)), float(bool(re.search(r"[:=]>?\s*[\"']?$", left))), float(left[-1:] in "\"'`" and left != ""),
        float("bearer" in left.lower()), float(any(w in " ".join(after).lower() for w in BAD_WORDS)), float(value.startswith(HEADER)), *[float(x in p) for x in PATHS],
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may hold a secret, leftmost first, without overlaps; whole text, code points."""
    found, names = [], []
    end = 0  # of the run in which the last value stood, so that names in one run do not each read it to its end
    for m in NAME.finditer(text):
        a = ASSIGNED.match(text, m.end())
        if a:
            if a.end() >= end:
                stop = STOP.search(text, a.end())
                end = stop.start() if stop else len(text)
            if end - a.end() >= LEAST:
                found.append((a.end(), end))
                names.append(m.start())
    starts = [a for a, _ in found]
    for m in TOKEN.finditer(text):
        a, e = m.span()
        k = bisect_right(starts, a)
        if k < len(starts) and starts[k] < e:  # a value assigned within the run stands for itself
            e = names[k]
        v = text[a:e]
        if len(v) >= 16 and (any("0" <= c <= "9" for c in v) or v.startswith(PREFIXES)):
            found.append((a, e))
    k = text.find(HEADER)
    while k >= 0:
        e = text.find("-----", k + len(HEADER))
        if 0 <= e - k < 60 and "PRIVATE KEY" in text[k:e]:
            found.append((k, e + 5))
        k = text.find(HEADER, k + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, path, label) made by rule; label 1 is a true secret."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    draw = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    word = lambda: "".join(pick(["th", "er", "on", "in", "an", "re", "ed", "st", "la", "en", "ou", "ti"]) for _ in range(1 + int(rng.integers(4))))
    prose = lambda k: " ".join(word() for _ in range(k))
    out = []
    for i in range(n):
        label = i % 2
        if label:
            v = pick([
                lambda: draw(hexa, 40), lambda: draw(hexa, 32), lambda: "AKIA" + draw(up + dig, 16), lambda: "ghp_" + draw(low + up + dig, 36), lambda: draw(low + up + dig, int(rng.integers(20, 50))),
                lambda: draw(low + up + dig + "+/", 40), lambda: "sk_live_" + draw(low + up + dig, 24), lambda: "xoxb-" + draw(dig, 12) + "-" + draw(low + up + dig, 24), lambda: word() + draw(dig, 4) + pick("!#%") + word(),
            ])()
            name = pick(["token", "api_key", "secret", "password", "AWS_SECRET_ACCESS_KEY", "auth_token", "client_secret"])
            strong = v.startswith(PREFIXES)
            left = pick([f'{name} = "', f"{name}: ", f"export {name}=", f'"{name}": "', *(["use ", "with key "] if strong else [])])
            right = '"' if left.endswith('"') else ""
            path = pick(["", "", "", "src/app.py", ".env", "config/prod.yml", "notes.md"])
        else:
            kind = int(rng.integers(9))
            v = [
                lambda: draw(hexa, 40), lambda: draw(hexa, 64), lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: pick(["get", "set", "load"]) + pick(["User", "Table", "Config"]) + pick(["Service", "Manager", "Handler"]) + draw(dig, 2),
                lambda: draw(dig, int(rng.integers(16, 22))), lambda: pick(["your_api_key_here_123", "xxxxxxxxxxxxxxxx0000", "changeme123456789", "EXAMPLEKEY1234567890", "abcdef1234567890abcdef"]), lambda: "_".join(pick(COMMON) for _ in range(3)) + "_" + draw(dig, 2),
                lambda: "sha512-" + draw(low + up + dig + "+/", 86) + "==", lambda: "/".join([word(), word(), word() + draw(dig, 3), word()]) + word(),
            ][kind]()
            left = pick([["commit ", "revision ", "sha1: ", "sha1 = "], ["sha256:", "digest: ", "checksum "], ["id: ", "uuid = ", "request id "], ["def ", "call ", ""], ["order ", "id ", "card "], ['api_key = "', "password: ", 'token = "'], ["import ", "see ", ""], ['integrity: "', "etag "], ["open ", "path: ", ""]][kind])
            right = '"' if left.endswith('"') else ""
            path = pick(["", "", "package.lock", "go.sum", "docs/readme.md", "src/app.py", "test/data.json"])
        head = prose(int(rng.integers(0, 6)))
        head = f"{head} " if head else ""
        text = f"{head}{left}{v}{right} {prose(int(rng.integers(0, 4)))}"
        a = len(head) + len(left)
        out.append((text, a, a + len(v), path, label))
    return out


class Forest:
    """Bagged trees on random feature subsets, by Gini impurity; kept as arrays, walked for all rows at once."""

    def __init__(self, trees: int = 30, depth: int = 9, least: int = 3, seed: int = 3) -> None:
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows: list[list[float]] = []
            boot = rng.integers(0, len(x), len(x))
            self._grow(x[boot], y[boot], 0, rows, rng)
            self.nodes.append(np.array(rows))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rows: list, rng: np.random.Generator) -> int:
        me = len(rows)
        rows.append([-1, 0, 0, 0, float(y.mean()) if len(y) else 0.5])  # feature, cut, left, right, share
        if depth >= self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return me
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(2 * math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], y[order]
            n = np.arange(1, len(s))
            ones = np.cumsum(s)[:-1]
            p, q = ones / n, (s.sum() - ones) / (len(s) - n)
            cost = n * p * (1 - p) + (len(s) - n) * q * (1 - q)
            cost[(v[1:] == v[:-1]) | (n < self.least) | (len(s) - n < self.least)] = np.inf
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], int(f), (v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return me
        go = x[:, best[1]] <= best[2]
        rows[me][0], rows[me][1] = best[1], best[2]
        rows[me][2] = self._grow(x[go], y[go], depth + 1, rows, rng)
        rows[me][3] = self._grow(x[~go], y[~go], depth + 1, rows, rng)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = t[at, 0].astype(int)
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go, t[at, 2], t[at, 3]).astype(int), at)
            total += t[at, 4]
        return total / max(1, len(self.nodes))


def train(findings: list[tuple[str, int, int, str, int]] | None = None) -> Forest:
    """A forest from labelled findings (a bounded list; labelled_findings() if none is given)."""
    f = labelled_findings() if findings is None else findings
    x = np.array([features(t[a:b], t[max(0, a - 40) : a], t[b : b + 40], p) for t, a, b, p, _ in f])
    return Forest().fit(x, np.array([y for *_, y in f], float))


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def scan(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with findings: array of (start, end, score) of all candidates, by start; code points, end exclusive.

    score is the forest's share for a true secret (0.5 or more: keep it). path names a column with the document's
    path, if there is one. Null and empty texts have no candidates; rows are independent; a column findings of docs is
    replaced.
    """
    docs = docs.drop("findings")
    b = docs.sparkSession.sparkContext.broadcast(forest)  # trees of a fixed number and depth
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("findings", FOUND)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index(path)) if path else None
            where, rows = [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index(text))):
                s = t.as_py() or ""
                p = (paths[i].as_py() or "") if path else ""
                for a, e in candidates(s):
                    where.append((i, a, e))
                    rows.append(features(s[a:e], s[max(0, a - 40) : a], s[e : e + 40], p))
            score = b.value.predict(np.array(rows)) if rows else []
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for (i, a, e), v in zip(where, score, strict=True):
                out[i].append({"start": a, "end": e, "score": float(v)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op6(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of documents: candidates, those kept, and their spans as start:end:score."""
    found = scan(docs.select("doc_id", "text"), train())
    kept = F.filter("findings", lambda f: f["score"] >= 0.5)
    spans = F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["start"], f["end"], F.format_number(f["score"], 2))), ",")
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(kept).cast("long").alias("n_secrets"), spans.alias("spans"))
