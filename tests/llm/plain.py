"""Plain in-memory versions of operators, for comparison."""

import hashlib
import re

from tidemark.llm import license_scan, pii

UP = {c: c + 32 for c in range(65, 91)}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pii_base(text: str | None) -> str:
    """The base spans by the plain patterns, joined as in op9."""
    t, out = text or "", []
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for kind, p in (("email", pii.EMAIL), ("ip", ip), ("card", pii.CARD), ("phone", pii.PHONE)):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(float(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), pii.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def line_dedup(rows: list[tuple[int | None, str | None]], least: int = 20, most_docs: int = 3) -> list[tuple]:
    """What op7 returns."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda a: a.strip(" \t\n\x0b\x0c\r").translate(UP)
    held: dict[str, set] = {}
    for i, lines in split:
        for k in {key(a) for a in lines}:
            if len(k) >= least and i is not None:
                held.setdefault(k, set()).add(i)
    out = []
    for i, lines in split:
        keep = []
        for a in lines:
            ids = held.get(key(a), set())
            if len(ids) < most_docs or i is None or i == max(ids):
                keep.append(a)
        out.append((i, len(lines), len(lines) - len(keep), digest("\n".join(keep))))
    return out


def license_base(text: str | None, base: dict[str, str] | None = None) -> tuple[int, int, int | None, int | None, str]:
    """n_words, n_base, first_word, last_word and base_labels worked out word by word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    at = [(i, label) for p, label in (license_scan.BASE if base is None else base).items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))
