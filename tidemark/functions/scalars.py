"""Scalar expressions over columns: guarded arithmetic, canonical text, rounding and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def log_or_null(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def number(x: Column) -> Column:
    """Text as a finite number, else NULL."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def canonical_decimals(x: Column) -> Column:
    """Every ASCII decimal literal replaced by {v}, so that texts differing only in figures are equal."""
    return F.regexp_replace(x, r"[+-]?[0-9]+\.[0-9]+", "{v}")


def canonical_name(x: Column) -> Column:
    """Full-width brackets as half-width ones, outer blanks off."""
    return F.trim(F.translate(x, "（）［］", "()[]"))


def board(code: Column, two: dict[str, str], one: dict[str, str], other: str) -> Column:
    """Label by two-character prefix, else by one character, else the fallback."""
    out = None
    for n, table in ((2, two), (1, one)):
        for k, v in table.items():
            c = F.substring(code, 1, n) == k
            out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(other) if out is not None else F.lit(other)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def facet(x: Column, exact: dict[str, str], patterns: dict[str, str], other: str) -> Column:
    """Class by exact value, else by the first pattern that matches the whole text."""
    out = None
    for k, v in exact.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    for k, v in patterns.items():
        c = x.rlike(f"^(?:{k})$")
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(other) if out is not None else F.lit(other)


def keep_unless(x: Column, excluded: list[str]) -> Column:
    """Predicate that drops excluded values; a missing value stays."""
    return ~F.coalesce(x.isin(*excluded), F.lit(False))
