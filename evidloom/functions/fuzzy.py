"""Edit similarity of strings, which Spark has no built-in for: Arrow UDFs over bit-parallel longest common subsequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Above this ratio a window is taken without looking further.
ENOUGH = 0.97


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as one integer's bits."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        x = row & where.get(ch, 0)
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); two empty strings are equal."""
    n = len(a) + len(b)
    return 1.0 if n == 0 else 2.0 * lcs_length(a, b) / n


def best_window_ratio(needle: str, hay: str) -> float:
    """The best ratio of the needle with windows of its length, a quarter of it apart; the first above ENOUGH ends the search.

    A text shorter than the needle is compared whole; windows that would leave its end are not looked at. An
    empty needle matches nothing.
    """
    n = len(needle)
    if n == 0:
        return 0.0
    if len(hay) <= n:
        return ratio(needle, hay)
    best = 0.0
    for i in range(0, len(hay) - n + 1, max(1, n // 4)):
        best = max(best, ratio(needle, hay[i : i + n]))
        if best > ENOUGH:
            break
    return best


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_fuzzy_ratio(needle: pd.Series, hay: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else best_window_ratio(x, y) for x, y in zip(needle, hay, strict=True)], dtype="float64")
