"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes up to `order` deep. A context c seen n times with d different next bytes
predicts byte b by n_b / (n + d) and escapes to its next shorter context by d / (n + d) (the estimator known as
method C, without exclusion); below the empty context all 256 bytes are alike. The statistics are frozen after
training, so the exact code length of a byte is a function of the `order` + 1 bytes that end in it. The code lengths
of all such n-grams of any language are worked out once, and a text is scored by looking its n-grams up; an unseen
n-gram pays the escapes of its context and goes on with the shorter one, as in the tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_texts, class_sample, remainder
from tidemark.llm.words import doc_slices, text_buffers

#: Bounds of the training sample: different whole texts for each language, and their bytes (the text that passes the
#: bound is the last).
SAMPLE_ROWS, SAMPLE_BYTES = 400, 400_000


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0] = 1  # 0 stands for what precedes a text
    return t


class Table:
    """Integer keys to rows of values by open addressing, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint32(32 - min(bits, 31)), np.int64((1 << bits) - 1)
        self.keys, self.values = keys.astype(np.uint32), values
        self.slot = np.full(1 << bits, -1, np.int32)
        rest, at = np.arange(len(keys)), self._home(self.keys)
        while len(rest):
            free = self.slot[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.slot[at[won]] = rest[won]
            lost = np.ones(len(rest), bool)
            lost[won] = False
            rest, at = rest[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._home(keys)
        got = self.slot[at]
        todo = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got[todo] = self.slot[at[todo]]
            g = got[todo]
            todo = todo[(g >= 0) & (self.keys[g] != keys[todo])]
        return got


class Ppm:
    """Frozen statistics of all languages. order: at most 3, so that an n-gram is one 32-bit key."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3) -> None:
        if not 0 <= order <= 3:
            raise ValueError("order is 0 to 3")
        self.langs, self.order, self.fold = sorted(samples), order, _fold()
        L = len(self.langs)
        streams = []
        for lang in self.langs:
            parts = [np.concatenate([np.zeros(order, np.uint8), self.fold[np.frombuffer(t, np.uint8)]]) for t in samples[lang]]
            streams.append(np.concatenate(parts) if parts else np.zeros(0, np.uint8))
        self.levels: list[tuple[Table, Table]] = []
        for k in range(order + 1):
            grams = [self._grams(s, k + 1) for s in streams]
            counted = [np.unique(g, return_counts=True) for g in grams]
            keys = np.unique(np.concatenate([c[0] for c in counted])) if L else np.zeros(0, np.uint32)
            n = np.zeros((len(keys), L))
            for j, (g, c) in enumerate(counted):
                n[np.searchsorted(keys, g), j] = c
            ctx, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), L)), np.zeros((len(ctx), L))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            known = total > 0
            escape = np.where(known, -np.log2(np.where(known, kinds, 1) / np.where(known, total + kinds, 1)), 0)
            lower = self._cost(keys & np.uint32(0xFFFFFF if k == 3 else (1 << 8 * k) - 1), k - 1, L)
            direct = -np.log2(np.where(n > 0, n, 1) / np.where(n > 0, (total + kinds)[of], 1))
            cost = np.where(n > 0, direct, escape[of] + lower)
            self.levels.append((Table(keys, cost.astype(np.float32)), Table(ctx, escape.astype(np.float32))))

    @staticmethod
    def _grams(s: np.ndarray, k: int) -> np.ndarray:
        if len(s) < k:
            return np.zeros(0, np.uint32)
        g = np.zeros(len(s) - k + 1, np.uint32)
        for i in range(k):
            g = (g << np.uint32(8)) | s[i : len(s) - k + 1 + i]
        return g[s[k - 1 :] > 0]  # the padding is context only

    def _cost(self, keys: np.ndarray, k: int, L: int) -> np.ndarray:
        """Bits of each n-gram's last byte after its k bytes of context, for each language."""
        if k < 0:
            return np.full((len(keys), L), 8.0)
        seen, escapes = self.levels[k]
        row = seen.find(keys)
        out = seen.values[row] if len(seen.keys) else np.zeros((len(keys), L), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            m = keys[miss]
            c = escapes.find(m >> np.uint32(8))
            up = np.where((c >= 0)[:, None], escapes.values[c] if len(escapes.keys) else 0, 0)
            out[miss] = up + self._cost(m & np.uint32((1 << 8 * k) - 1), k - 1, L)
        return out

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text under each language; offs: n + 1 offsets in data."""
        n, L, o, most = len(offs) - 1, len(self.langs), self.order, 1 << 19
        out = np.zeros((n, L))
        for i, j in doc_slices(offs, most):
            a, b = int(offs[i]), int(offs[j])
            if j - i > 1:  # whole texts, each after its own padding
                at = np.arange(b - a) + o * (1 + np.repeat(np.arange(j - i), np.diff(offs[i : j + 1])))
                s = np.zeros(b - a + o * (j - i), np.uint8)
                s[at] = self.fold[data[a:b]]
                cost = self._cost(self._at(s, at), o, L)
                run = np.concatenate([np.zeros((1, L)), np.cumsum(cost, axis=0, dtype=np.float64)])
                out[i:j] = run[offs[i + 1 : j + 1] - a] - run[offs[i:j] - a]
            else:  # one text, by pieces that know the bytes before them
                for c in range(a, b, most):
                    past = self.fold[data[max(a, c - o) : c]]
                    s = np.concatenate([np.zeros(o - len(past), np.uint8), past, self.fold[data[c : min(b, c + most)]]])
                    out[i] += self._cost(self._at(s, np.arange(o, len(s))), o, L).sum(axis=0, dtype=np.float64)
        return out

    def _at(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The n-gram that ends at each place."""
        g = np.zeros(len(at), np.uint32)
        for d in range(self.order, -1, -1):
            g = (g << np.uint32(8)) | s[at - d]
        return g


def train(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES, order: int = 3) -> Ppm:
    """Trees from at most `rows` different texts of each language, whole ones by hash until they reach `limit` bytes."""
    got: dict[str, list[bytes]] = {}
    part = class_sample(df.select(F.col(text).alias("text"), F.col(lang).alias("lang")), "lang", "text", rows)
    for r in bounded_texts(part, "lang", limit).orderBy("lang", F.xxhash64("text"), "text").collect():
        if r["text"]:
            got.setdefault(r["lang"], []).append(r["text"].encode())
    return Ppm(got, order)


def identify(df: DataFrame, model: Ppm, text: str = "text") -> DataFrame:
    """df with lang_pred, score (posterior of the language at equal priors) and bits_per_byte of the best language.

    Null texts and texts with no letter get `und`, score 0 and null bits; so does every text if no language was
    learned. Ties go to the language that sorts first. A column of df with one of these names is replaced. Whole
    texts are scored, in pieces; repeated rows are scored alike, an empty table gives an empty one.
    """
    b = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that made it
    df = df.drop("lang_pred", "score", "bits_per_byte")
    fields = [f for f in df.schema.fields]
    schema = df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).cast("double").alias("bits_per_byte")).schema

    def run(batches):
        m = b.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            data, offs = text_buffers(col)
            n = len(offs) - 1
            if m.langs:
                bits = m.bits(data, offs)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1, keepdims=True)
                score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
                letter = np.array([any(map(str.isalpha, t)) if t else False for t in col.to_pylist()], bool)
            else:
                letter, best, score, least = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros((n, 1))
            size = np.maximum(np.diff(offs), 1)
            pred = [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(np.where(letter, least[:, 0] / size, 0.0), mask=~letter)],
                names=[*[f.name for f in fields], "lang_pred", "score", "bits_per_byte"],
            )

    for f in schema.fields:
        f.nullable = True
    return df.mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    """Language of every whole text of documents; learned from rows whose crc32 remainder by 4 is not 2."""
    held = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held & F.col("lang").isNotNull()))
    scored = identify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")
