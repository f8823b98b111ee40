"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Texts are cut into overlapping windows of words; every window of a text is scored. A word enters as what it is and as
what it is made of: the smoothed log odds of the word and of its character n-grams (with the word's ends marked)
between toxic and other training texts, and a learned vector summed over the hashed word and its hashed n-grams. A GRU
reads each window in both directions, attention weighs its states, and a logistic layer scores the pooled state. A
text's logit is the largest of its windows'. Labels are of texts, so training lets the windows of a text compete: the
loss of a text reaches its windows by a softmax of their logits.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import class_sample, remainder
from tidemark.llm.words import Words, doc_slices, mix, text_buffers
from tidemark.session import saved

#: Bounds of the training sample: whole texts of each label, and their bytes (the text that passes the bound is the last).
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 12_000_000
WINDOW, STRIDE = 24, 1
HASHED, DIM, HIDDEN, EPOCHS = 1 << 14, 4, 8, 5
#: Of the sample, the whole texts of each label that the network itself learns from, and their bytes.
NET_ROWS, NET_BYTES = 400, 4_000_000
#: Distance of the windows in training, and the most windows of a step; of a longer text those of the largest logits.
NET_STRIDE, NET_WINDOWS = 16, 2048
#: Windows that are scored side by side: what a step works on, 200 to 300 bytes a window, must stay in a core's own cache.
BLOCK = 3072
#: States that differ by less are one state: so much comes of rounding in 32 bits. They are compared after so many words.
SAME, LEAST = np.float32(2.0**-20), 10
GRAMS = (3, 5, 7)
GOLD = np.uint64(0x9E3779B97F4A7C15)
INPUTS = 5 + DIM


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every character n-gram of each word, one mark at either end; on bytes."""
    n = ends - starts + 2
    at = np.cumsum(n) - n
    buf = np.full(int(n.sum()), 1, np.uint64)
    inner = np.arange(int((n - 2).sum())) + np.repeat(2 * np.arange(len(n)) + 1, n - 2)
    buf[inner] = low[data[np.repeat(starts - (np.cumsum(n - 2) - (n - 2)), n - 2) + np.arange(int((n - 2).sum()))]]
    word = np.repeat(np.arange(len(n)), n)
    left = np.repeat(at + n, n) - np.arange(len(buf))  # bytes to the word's end
    out_w, out_h = [], []
    with np.errstate(over="ignore"):
        for g in GRAMS:
            ok = np.flatnonzero(left >= g)
            h = np.full(len(ok), g, np.uint64)
            for k in range(g):
                h = (h ^ buf[ok + k]) * GOLD
                h ^= h >> np.uint64(29)
            out_w.append(word[ok])
            out_h.append(mix(h))
    return np.concatenate(out_w), np.concatenate(out_h)


class Counts:
    """Texts of each label by hashed feature, merged now and then so that memory follows the distinct features."""

    def __init__(self) -> None:
        self.keys, self.pos, self.neg = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.new: list[tuple[np.ndarray, int]] = []
        self.size = 0

    def add(self, features: np.ndarray, label: int) -> None:
        self.new.append((np.unique(features), label))
        self.size += len(self.new[-1][0])
        if self.size > 1_000_000:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.new:
            k = np.concatenate([self.keys, *[f for f, _ in self.new]])
            y = np.repeat([a for _, a in self.new], [len(f) for f, _ in self.new])
            keys, at = np.unique(k, return_inverse=True)
            old, fresh = at[: len(self.keys)], at[len(self.keys) :]
            pos, neg = np.bincount(fresh, weights=y == 1, minlength=len(keys)).astype(np.int32), np.bincount(fresh, weights=y == 0, minlength=len(keys)).astype(np.int32)
            pos[old] += self.pos
            neg[old] += self.neg
            self.keys, self.pos, self.neg, self.new, self.size = keys, pos, neg, [], 0
        return self.keys, self.pos, self.neg


class Odds:
    """Smoothed log odds of hashed features between labels, by number of texts; one gather for a lookup.

    Of features that share a slot of the table, the one in most texts stays and the others are unknown.
    """

    BITS = 20

    def __init__(self, counts: Counts, n: tuple[int, int], least: int) -> None:
        keys, pos, neg = counts.total()
        ok = pos + neg >= least
        keys, pos, neg, self.n = keys[ok], pos[ok], neg[ok], n
        order = np.argsort(pos + neg, kind="stable")
        keys, pos, neg = keys[order], pos[order], neg[order]
        slot = self.slot(keys)
        self.tag = np.zeros(1 << self.BITS, np.uint32)
        self.pos, self.neg = np.zeros(1 << self.BITS, np.int32), np.zeros(1 << self.BITS, np.int32)
        self.tag[slot], self.pos[slot], self.neg[slot] = self.mark(keys), pos, neg
        self.value = np.where(self.pos + self.neg > 0, self.of(self.pos, self.neg), 0).astype(np.float32)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def mark(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def of(self, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        """Shrunk towards 0 by one text spread over the labels as they are."""
        a, b = self.n
        prior = a / max(a + b, 1)
        return np.log((pos + prior) / max(a, 1e-9) * max(b, 1e-9) / (neg + 1 - prior) + 1e-9)

    def look(self, h: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log odds, 0 if unknown; own: the label of a training text that must not count itself."""
        k = self.slot(h)
        known = self.tag[k] == self.mark(h)
        if own is None:
            return np.where(known, self.value[k], np.float32(0))
        p, q = self.pos[k] - (own == 1), self.neg[k] - (own == 0)
        return np.where(known & (p + q > 0), self.of(np.maximum(p, 0), np.maximum(q, 0)), 0).astype(np.float32)


class Distinct:
    """Tells texts apart from copies of earlier ones: copies teach nothing. A sixteenth of the word triples stand for all."""

    def __init__(self, most: float = 0.3) -> None:
        self.most, self.seen = most, set()

    def fresh(self, h: np.ndarray) -> bool:
        with np.errstate(over="ignore"):
            t = mix(h[:-2] * GOLD + mix(h[1:-1] + GOLD) + h[2:]) if len(h) > 2 else mix(h + GOLD)
        few = set((t[t % np.uint64(16) == 0] if len(t) > 64 else t).tolist())
        if few and len(few & self.seen) > self.most * len(few):
            return False
        self.seen |= few
        return True


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters and passes of the network. x of step(): (windows, time, INPUTS); windows are full, or of one length."""

    def __init__(self, rng: np.random.Generator) -> None:
        h, i = HIDDEN, INPUTS
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": (rng.standard_normal((HASHED, DIM)) * 0.05).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": r(i, 3 * h), f"U{d}": r(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": r(2 * h, h), "a": np.zeros(h, np.float32), "v": r(h, 1)[:, 0], "w": r(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}

    def gru(self, d: str, xw: np.ndarray, keep: list) -> np.ndarray:
        h, U = HIDDEN, self.p[f"U{d}"]
        n, t, _ = xw.shape
        s, out = np.zeros((n, h), np.float32), np.empty((n, t, h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = sigmoid(xw[:, k, : 2 * h] + s @ U[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            rs = r * s
            c = np.tanh(xw[:, k, 2 * h :] + rs @ U[:, 2 * h :])
            keep.append((k, s, z, r, rs, c))
            s = s + z * (c - s)
            out[:, k] = s
        return out

    def table(self, x: np.ndarray) -> np.ndarray:
        """What words of inputs x bring to the gates: (words, 6 * HIDDEN), forward, then backward.

        As logits() takes it: sigmoid(x) is 1 / (1 + exp(-x)), and tanh(x) is 2 * sigmoid(2 * x) - 1.
        """
        p, scale = self.p, np.tile(np.repeat(np.array([-1, -2], np.float32), [2 * HIDDEN, HIDDEN]), 2)
        return (x @ np.concatenate([p["Wf"], p["Wb"]], axis=1) + np.concatenate([p["bf"], p["bb"]])) * scale

    def logits(self, steps: list[np.ndarray] | np.ndarray) -> np.ndarray:
        """The logit of each window; steps[k]: what table() has of the k-th words of all windows, (6 * HIDDEN, windows).

        Windows lie side by side, so that every operation runs over all of them at once. All curves are sigmoids by exp, which
        costs half of what tanh does; what is kept is half of each state, so that tanh(x) / 2 is sigmoid(2 * x) - 1 / 2.

        Steps from slide() are of windows that begin with consecutive words. There a window and the one that begins (backward:
        ends) a word nearer read the same words from some word on. Once their states at a word differ by no more than
        rounding (SAME), all later ones are taken from the nearer window; states that differ by more go on by themselves.
        """
        p, h, t, n = self.p, HIDDEN, len(steps), steps[0].shape[1]
        slid = isinstance(steps, np.ndarray) and steps.strides[0] == steps.strides[2]

        def odds(x: np.ndarray) -> np.ndarray:
            """1 + exp(x) in place: the inverse of a sigmoid."""
            np.exp(x, out=x)
            x += 1
            return x

        states = np.empty((t, 2 * h, n), np.float32)
        e, o = np.empty((t, n), np.float32), np.empty((t, n), np.float32)
        # one product for the attention's hidden layer and, in the last row, what a state brings to the logit
        A, a, v = np.concatenate([p["A"].T * np.float32(-4), 2 * p["w"][None]]), -2 * p["a"][:, None], 2 * p["v"]
        q = np.empty((h + 1, n), np.float32)
        hidden = q[:h]
        with np.errstate(over="ignore"):  # exp of a large value gives a sigmoid of 0
            for d, order in (("b", range(t - 1, -1, -1)), ("f", range(t))):
                low, U = (0 if d == "f" else h), np.ascontiguousarray(p[f"U{d}"].T) * np.repeat(np.array([-2, -4], np.float32), [2 * h, h])[:, None]
                # windows that have a nearer one, and these
                here, there = (slice(0, n - 1), slice(1, n)) if d == "f" else (slice(1, n), slice(0, n - 1))
                s = own = None  # own: windows with states of their own, once there are others
                g, c = np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32)
                z, r, mid, top = g[:h], g[h:], 3 * low + 2 * h, 3 * (low + h)
                for m, k in enumerate(order):
                    gates, last, now = steps[k][3 * low : mid], steps[k][mid:top], states[k, low : low + h]
                    if own is not None:
                        gates, last = gates.take(own, axis=1), last.take(own, axis=1)
                    if s is None:  # nothing before the first word
                        np.divide(1, odds(np.add(last, 0, out=c)), out=c)
                        c -= 0.5
                        s = np.divide(c, odds(np.add(gates[:h], 0, out=z)), out=now)
                    else:
                        np.matmul(U[: 2 * h], s, out=g)
                        g += gates
                        odds(g)
                        np.matmul(U[2 * h :], np.divide(s, r, out=r), out=c)
                        c += last
                        np.divide(1, odds(c), out=c)
                        c -= 0.5
                        c -= s
                        c /= z
                        s = np.add(s, c, out=now if own is None else s)
                    if own is not None:
                        now[:, here] = before[:, there]
                        now[:, own] = s
                    elif slid and m >= LEAST:
                        mine, near = now[:, here], before[:, there]
                        if np.count_nonzero(np.abs(mine[0] - near[0]) < SAME) > 0.75 * n:  # one unit tells how many may have met
                            far = np.ones(n, bool)  # the last window has no nearer one
                            far[here] = np.abs(mine - near).max(axis=0) >= SAME
                            if np.count_nonzero(far) < 0.25 * n:
                                own = np.flatnonzero(far)
                                s, g, c = s.take(own, axis=1), np.empty((2 * h, len(own)), np.float32), np.empty((h, len(own)), np.float32)
                                z, r = g[:h], g[h:]
                    before = now  # of nearer windows: their states at the word to come
                    if d == "f":  # both states of the word are known
                        np.matmul(A, states[k], out=q)
                        hidden += a
                        e[k], o[k] = v @ np.divide(1, odds(hidden), out=hidden), q[h]  # e but for what all words have in common
        e = np.exp(e - e.max(axis=0))
        return (e * o).sum(axis=0) / e.sum(axis=0) + p["c"][0]

    def window_logits(self, table: np.ndarray, inv: np.ndarray, starts: np.ndarray, t: int = WINDOW) -> np.ndarray:
        """The logit of each window of t words; inv: which row of table() each word is."""
        parts = [starts[k : k + BLOCK] for k in range(0, len(starts), BLOCK)]
        return np.concatenate([self.logits([np.ascontiguousarray(table[inv[s + k]].T) for k in range(t)]) for s in parts])

    def step(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients and the gradient of x. doc: text of each window (0..n-1, sorted); y: label of each text."""
        p, h = self.p, HIDDEN
        kf, kb = [], []
        Hf = self.gru("f", x @ p["Wf"] + p["bf"], kf)
        Hb = self.gru("b", x @ p["Wb"] + p["bb"], kb)
        H = np.concatenate([Hf, Hb], axis=2)
        q = np.tanh(H @ p["A"] + p["a"])
        e = q @ p["v"]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        pool = (e[:, :, None] * H).sum(axis=1)
        o = pool @ p["w"] + p["c"][0]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top = np.maximum.reduceat(o, first)
        m = np.exp(2 * (o - top[doc]))
        m /= np.add.reduceat(m, first)[doc]
        out = np.add.reduceat(m * o, first)
        s = sigmoid(out)
        loss = float((weight * -(y * np.log(s + 1e-7) + (1 - y) * np.log(1 - s + 1e-7))).sum())
        do = (weight * (s - y))[doc] * m
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["c"] = pool.T @ do, np.array([do.sum()], np.float32)
        dpool = do[:, None] * p["w"]
        de = np.einsum("nth,nh->nt", H, dpool)
        dH = e[:, :, None] * dpool[:, None, :]
        de = e * (de - (e * de).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nth,nt->h", q, de)
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["A"], g["a"] = np.einsum("ntk,nth->kh", H, dq), dq.sum(axis=(0, 1))
        dH += dq @ p["A"].T
        dx = np.zeros_like(x)
        for d, keep, dh in (("f", kf, dH[:, :, :h]), ("b", kb, dH[:, :, h:])):
            U, ds, dxw = p[f"U{d}"], np.zeros((len(x), h), np.float32), np.empty((*x.shape[:2], 3 * h), np.float32)
            for k, s0, z, r, rs, c in reversed(keep):
                ds = ds + dh[:, k]
                dc = ds * z * (1 - c * c)
                dz = ds * (c - s0) * z * (1 - z)
                drs = dc @ U[:, 2 * h :].T
                dr = drs * s0 * r * (1 - r)
                zr = np.concatenate([dz, dr], axis=1)
                dxw[:, k] = np.concatenate([zr, dc], axis=1)
                g[f"U{d}"][:, : 2 * h] += s0.T @ zr
                g[f"U{d}"][:, 2 * h :] += rs.T @ dc
                ds = ds * (1 - z) + drs * r + zr @ U[:, : 2 * h].T
            g[f"W{d}"] = np.einsum("nti,nth->ih", x, dxw)
            g[f"b{d}"] = dxw.sum(axis=(0, 1))
            dx += dxw @ p[f"W{d}"].T
        return loss, g, dx


class Model:
    """The trained network with its input tables."""

    def __init__(self, word_odds: Odds, gram_odds: Odds, net: Net) -> None:
        self.word_odds, self.gram_odds, self.net = word_odds, gram_odds, net

    def dump(self) -> bytes:
        """The arrays of the model, without its classes; packed, as most slots of the tables are empty."""
        return zlib.compress(pickle.dumps([vars(self.word_odds), vars(self.gram_odds), vars(self.net)], pickle.HIGHEST_PROTOCOL), 1)

    def __reduce__(self) -> tuple:
        return Model.load, (self.dump(),)

    @classmethod
    def load(cls, dumped: bytes) -> Model:
        parts = [Odds.__new__(Odds), Odds.__new__(Odds), Net.__new__(Net)]
        for part, arrays in zip(parts, pickle.loads(zlib.decompress(dumped)), strict=True):
            vars(part).update(arrays)
        return cls(*parts)

    def inputs(self, words: np.ndarray, gw: np.ndarray, gh: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dense part (n, 5) of n words with hashes `words`, and (word, row of emb) pairs. gw, gh: their n-grams."""
        n = len(words)
        wo, go = self.word_odds.look(words, own), self.gram_odds.look(gh, own)
        best, least, total = np.full(n, 0, np.float32), np.full(n, 0, np.float32), np.bincount(gw, weights=go, minlength=n)
        np.maximum.at(best, gw, go)
        np.minimum.at(least, gw, go)
        count = np.maximum(np.bincount(gw, minlength=n), 1)
        dense = np.stack([wo, best, least, total / count, (wo != 0).astype(np.float32)], axis=1).astype(np.float32) / 2
        rows = np.concatenate([words, gh]) & np.uint64(HASHED - 1)
        return dense, np.concatenate([np.arange(n), gw]), rows.astype(np.int64)

    def embed(self, n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(at, weights=self.net.p["emb"][rows, d], minlength=n) for d in range(DIM)], axis=1) if len(at) else np.zeros((n, DIM))
        return (out / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))[:, None]).astype(np.float32)


def window_starts(n: int, stride: int = STRIDE) -> np.ndarray:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - WINDOW, stride)
    return np.append(s, n - WINDOW)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train on texts with labels 0 and 1. Deterministic. Without texts of both labels all get the score of the one there is."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    tok = Words()

    def parsed(t: str):
        data, offs = text_buffers(pa.array([t], pa.large_string()))
        h, s, e, _ = tok(data, offs)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        return (h, u, inv, *grams_of(data, s[first], e[first], tok.low))

    distinct, words, grams, own = Distinct(), Counts(), Counts(), []
    for k, t in enumerate(texts):
        h, u, _, _, gh = parsed(t)
        if distinct.fresh(h):
            own.append(k)
            words.add(u, labels[k])
            grams.add(gh, labels[k])
    y = y[own]
    n = (int((y == 1).sum()), int((y == 0).sum()))
    model = Model(Odds(words, n, 2), Odds(grams, n, 3), Net(rng))
    del words, grams, distinct
    made, left, room = [], {0: NET_ROWS, 1: NET_ROWS}, {0: NET_BYTES, 1: NET_BYTES}
    for k, label in zip(own, y.astype(int).tolist(), strict=True):
        left[label] -= 1
        if left[label] >= 0 and room[label] > 0 and len((d := parsed(texts[k]))[1]):
            room[label] -= len(texts[k].encode())
            dense, at, rows = model.inputs(d[1], d[3], d[4], own=label)
            made.append((dense, at.astype(np.int32), rows.astype(np.int32), d[2].astype(np.int32), window_starts(len(d[2]), NET_STRIDE)))
        else:
            made.append(None)
    ok = np.array([k for k, m in enumerate(made) if m is not None], int)
    # weights bring the labels back to their shares among the distinct texts of the sample
    share = np.ones(len(y), np.float32)
    for label in (0, 1):
        used = max(1, int((y[ok] == label).sum()))
        share[y == label] = (y == label).sum() / used * len(ok) / max(1, len(y))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.net.p.items()}
    steps, size = 0, 24
    both = bool(len(ok)) and 0 < y[ok].sum() < len(ok)
    if not both:  # nothing to tell apart: every text gets the label there is, and 0 if there is none
        model.net.p["w"][:] = 0
        model.net.p["c"][:] = 20 if len(ok) and y[ok].all() else -20
    for epoch in range(EPOCHS if both else 0):
        order = rng.permutation(ok)
        order = order[np.argsort([len(made[k][3]) >= WINDOW for k in order], kind="stable")]  # short texts apart
        batches, n = [], 0
        for k in order:  # of at most `size` texts and NET_WINDOWS windows
            n += min(len(made[k][4]), NET_WINDOWS)
            if not batches or len(batches[-1]) == size or n > NET_WINDOWS:
                batches.append([])
                n = min(len(made[k][4]), NET_WINDOWS)
            batches[-1].append(k)
        for b in rng.permutation(len(batches)):
            short = [k for k in batches[b] if len(made[k][3]) < WINDOW]
            for group in ([[k] for k in short] if short else []) + [[k for k in batches[b] if len(made[k][3]) >= WINDOW]]:
                if not group:
                    continue
                xs, ids, doc = [], [], []
                parts, base = [], 0
                for q, k in enumerate(group):
                    dense, at, rows, inv, starts = made[k]
                    emb = model.embed(len(dense), at, rows)
                    full = np.concatenate([dense, emb], axis=1)
                    t = min(WINDOW, len(inv))
                    if len(starts) > NET_WINDOWS:
                        starts = np.sort(starts[np.argsort(-model.net.window_logits(model.net.table(full), inv, starts), kind="stable")[:NET_WINDOWS]])
                    idx = inv[starts[:, None] + np.arange(t)]
                    xs.append(full[idx])
                    ids.append(idx + base)
                    doc += [q] * len(starts)
                    parts.append((len(dense), at, rows))
                    base += len(dense)
                x = np.concatenate(xs)
                w = share[group] / len(group)
                _, g, dx = model.net.step(x, np.array(doc), y[group], w.astype(np.float32))
                back = np.stack([np.bincount(np.concatenate([i.ravel() for i in ids]), weights=dx[:, :, 5 + d].ravel(), minlength=base) for d in range(DIM)], axis=1)
                base = 0
                for n, at, rows in parts:
                    each = back[base : base + n] / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))[:, None]
                    for d in range(DIM):
                        g["emb"][:, d] += np.bincount(rows, weights=each[at, d], minlength=HASHED)
                    base += n
                steps += 1
                rate = 0.01 * (0.5 if epoch >= EPOCHS - 2 else 1)
                for k, v in model.net.p.items():
                    m1, m2 = moment[k]
                    gk = np.clip(g[k], -1, 1) + (1e-3 * v if k == "emb" else 0)
                    m1 += 0.1 * (gk - m1)
                    m2 += 0.01 * (gk * gk - m2)
                    v -= (rate * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    for odds in (model.word_odds, model.gram_odds):
        odds.pos = odds.neg = None  # scoring needs the values only
    return model


def slide(x: np.ndarray, n: int) -> np.ndarray:
    """Steps of n windows that begin with consecutive words: a view of x (6 * HIDDEN, n + WINDOW - 1)."""
    return np.lib.stride_tricks.sliding_window_view(x, n, axis=1).transpose(1, 0, 2)


def firsts(h: np.ndarray) -> np.ndarray:
    """Of each hash, the place of the first one equal to it; by slots of a table, again for those that others displaced."""
    out, left, table, salt = np.empty(len(h), np.int64), np.arange(len(h)), np.empty(1 << 22, np.int64), GOLD
    with np.errstate(over="ignore"):
        while len(left):
            slot = ((h[left] * salt) >> np.uint64(42)).astype(np.int64)
            table[slot[::-1]] = left[::-1]  # the last one written stays: the first of the slot
            got = table[slot]
            same = h[got] == h[left]
            out[left[same]] = got[same]
            left, salt = left[~same], salt * GOLD
    return out


def first_windows(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each window, the start of the first one with the same words; h: hashes of the words, starts: sorted."""
    name, size, full, done = h, 1, np.zeros(len(h), np.uint64), 0
    with np.errstate(over="ignore"):
        while done < WINDOW:  # names of 1, 2, 4, ... words, and of their sums
            if WINDOW & size:
                full = mix(full[: len(h) - done - size + 1] * GOLD + name[done:])
                done += size
            if done < WINDOW:
                name = mix(name[:-size] * GOLD + name[size:])
                size *= 2
    first = starts[firsts(full[starts])]
    again = np.flatnonzero(first != starts)
    same = np.ones(len(again), bool)
    for k in range(WINDOW):  # names may clash
        same &= h[first[again] + k] == h[starts[again] + k]
    first[again[~same]] = starts[again[~same]]
    return first


def score_slice(model: Model, tok: Words, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Largest window logit of each text; texts without words get -inf. Windows of the same words are scored once."""
    h, s, e, at = tok(data, offs)
    out = np.full(len(offs) - 1, -np.inf)
    if not len(h):
        return out
    place = firsts(h)
    new = place == np.arange(len(h))
    first, inv = np.flatnonzero(new), (np.cumsum(new) - 1)[place]
    u = h[first]
    net, table = model.net, np.empty((len(u), 6 * HIDDEN), np.float32)
    for k in range(0, len(u), 20_000):
        gw, gh = grams_of(data, s[first[k : k + 20_000]], e[first[k : k + 20_000]], tok.low)
        dense, wat, rows = model.inputs(u[k : k + 20_000], gw, gh)
        table[k : k + 20_000] = net.table(np.concatenate([dense, model.embed(len(dense), wat, rows)], axis=1))
    n = np.diff(at)
    for t in np.unique(n[n < WINDOW]):  # a short text is one window
        docs = np.flatnonzero(n == t)
        if t:
            out[docs] = net.window_logits(table, inv, at[docs], int(t))
    docs = np.flatnonzero(n >= WINDOW)
    if not len(docs):
        return out
    place, left = np.arange(len(h)) - np.repeat(at[:-1], n), np.repeat(at[1:], n) - np.arange(len(h))
    starts = np.flatnonzero((left == WINDOW) | ((left > WINDOW) & (place % STRIDE == 0)))
    first = first_windows(h, starts)
    # pieces of words that hold all windows to be scored; what a piece costs beyond them is its last words
    need = starts[first == starts]
    cut = np.flatnonzero(np.diff(need) > WINDOW)
    low, high = need[np.append(0, cut + 1)], need[np.append(cut, len(need) - 1)] + WINDOW
    size = high - low
    at_word = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    value = np.empty(len(h), np.float32)  # of the window that begins at each word, where one is to be scored
    for k in range(0, len(at_word) - WINDOW + 1, BLOCK):
        m = min(BLOCK, len(at_word) - WINDOW + 1 - k)
        x = np.ascontiguousarray(table[inv[at_word[k : k + m + WINDOW - 1]]].T)
        value[at_word[k : k + m]] = net.logits(slide(x, m))
    out[docs] = np.maximum.reduceat(value[first], np.searchsorted(starts, at[docs]))
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """docs (doc_id, text) with labels (doc_id, toxic); at most `rows` texts of each label are learned from."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # drawn from the labels alone, so that no text moves: at most `rows` ids of each of two labels are sent to the scan
    ids = class_sample(known, "toxic", "doc_id", rows)
    part = docs.join(F.broadcast(ids), "doc_id").filter("text IS NOT NULL")
    sample = saved(part.select("toxic", F.xxhash64("text").alias("h"), "text"), "toxicity-sample")
    # whole texts by hash until their bytes reach the bound: it is set by lengths alone
    before = W.partitionBy("toxic").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    sizes = sample.groupBy("toxic", "h").agg(F.max(F.octet_length("text")).alias("size"))
    fit_in = sizes.withColumn("past", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("past") < SAMPLE_BYTES).select("toxic", "h")
    sample = sample.join(F.broadcast(fit_in), ["toxic", "h"]).dropDuplicates(["toxic", "h"]).select("toxic", "h", "text")

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([fit([t for _, _, t in rows], [y for y, _, _ in rows]).dump()], pa.binary())], names=["model"])

    # one task learns from the bounded sample, which keeps the driver free of it
    got = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return Model.load(bytes(got[0]["model"])) if got else fit([], [])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score: 0 to 1, higher if label 1 is likelier; texts without words (null, empty) get 0.

    Whole texts count, in overlapping windows. A column score of docs is replaced; rows are independent.
    """
    docs = docs.drop("score")
    b = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the training sample's bound
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    for f in schema.fields:
        f.nullable = True
    names = schema.names

    def run(batches):
        m, tok = b.value, Words()
        for batch in batches:
            data, offs = text_buffers(batch.column(batch.schema.get_field_index(text)))
            out = np.full(batch.num_rows, -np.inf)
            for i, j in doc_slices(offs, 1 << 22):
                out[i:j] = score_slice(m, tok, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-out))))], names=names)

    return docs.mapInArrow(run, schema)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text of documents; learned from labels whose crc32 remainder by 5 is not 0."""
    held = remainder(F.col("doc_id"), 5) == 0
    docs = docs.select("doc_id", "text")
    model = train(docs.filter(~held), labels.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
