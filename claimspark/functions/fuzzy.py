"""Fuzzy ratios (TX30): the indel form, 2 * LCS / (length of both) * 100, in one Arrow UDF. Use them on distinct pairs
that a blocking join has chosen."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer as long as it."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    return max(ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


_KINDS = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio}


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in _KINDS]))
def fuzzy_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All four ratios of two texts; nulls are empty texts."""
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    return pd.DataFrame({name: [f(x, y) for x, y in pairs] for name, f in _KINDS.items()})


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The plain ratio of two texts; nulls are empty texts."""
    return pd.Series([ratio(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")


def fuzz_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(a, b)
