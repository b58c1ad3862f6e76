"""Column expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "round_half_even", "r6", "clip_col", "safe_div", "per_90",
    "right_closed_tier", "keyword_regex", "keyword_flag", "label_map",
    "lenient_cast", "blank_to_null", "one_hot",
]


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    """numpy-style rounding: rint(x * 10^n) / 10^n (0.125 -> 0.12)."""
    scale = float(10 ** digits)
    return F.rint(col_of(c) * F.lit(scale)) / F.lit(scale)


def r6(c: str | Column) -> Column:
    """Output rounding used for cross-engine comparison (6 decimals, half-even)."""
    return round_half_even(c, 6)


def clip_col(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clamp keeping NULL (``greatest``/``least`` alone would turn NULL into the bound)."""
    x = col_of(c)
    out = x
    if lower is not None:
        out = F.when(out < F.lit(lower), F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(out > F.lit(upper), F.lit(upper)).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL on a zero or NULL denominator (ANSI-safe)."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def per_90(x: str | Column, minutes: str | Column = "minutes") -> Column:
    """``x / (minutes / 90)`` when minutes > 0, else 0."""
    m = col_of(minutes)
    return F.when(m > 0, col_of(x) / (m / F.lit(90.0))).otherwise(F.lit(0.0))


def right_closed_tier(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ...; outside or NULL -> NULL."""
    x = col_of(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))


def keyword_regex(words: Sequence[str], whole_word: bool = False) -> str:
    alts = "|".join(re.escape(w) for w in words)
    return rf"\b(?:{alts})\b" if whole_word else alts


def keyword_flag(c: str | Column, words: Sequence[str], whole_word: bool = False) -> Column:
    """1 if the lower-cased text contains any keyword (substring by default), NULL text -> 0."""
    hit = F.lower(col_of(c)).rlike(keyword_regex(words, whole_word))
    return F.coalesce(hit, F.lit(False)).cast("int")


def label_map(c: str | Column, mapping: dict) -> Column:
    """Lookup through a literal map; unknown key -> NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col_of(c))


def lenient_cast(c: str | Column, to: str) -> Column:
    """Failed cast -> NULL (``try_cast``)."""
    return col_of(c).try_cast(to)


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col_of(c)), F.lit(""))


def one_hot(c: str | Column, values: Sequence[str], prefix: str) -> list[Column]:
    """Fixed 0/1 columns, always all present; unknown or NULL -> all 0."""
    x = col_of(c)
    return [F.coalesce((x == F.lit(v)), F.lit(False)).cast("int").alias(f"{prefix}_{v}")
            for v in values]
