"""Tail probabilities for already aggregated test statistics (one row per feature); Spark has no erf or beta."""

import math
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= z) for a standard normal Z."""
    return z.map(lambda x: min(1.0, math.erfc(x / math.sqrt(2.0))) if x == x else math.nan)


SMALL_SIDE = 8  # fixed value: up to so many rows on a side the rank-sum test is exact where no values tie


@lru_cache(maxsize=None)
def _period_table(m: int) -> tuple[int, list[int]]:
    """lcm(1..m), and for j up to m + 1 such periods the number of partitions of at most j into parts of 1 to m: the
    counting recurrence, one part size after the other."""
    period = math.lcm(*range(1, m + 1))
    counts = [1] * (period * (m + 1))  # no parts: one partition, of 0, and so of at most j
    for part in range(1, m + 1):
        for j in range(part, len(counts)):
            counts[j] += counts[j - part]
    return period, counts


def partitions_up_to(j: int, m: int) -> int:
    """Partitions of the numbers 0 to j into parts of 1 to m. Along every residue of the period the count is a polynomial
    of degree m in the number of periods, carried on from its first m + 1 values by their differences."""
    if j < 0:
        return 0
    period, counts = _period_table(m)
    turns, rest = divmod(j, period)
    if turns <= m:
        return counts[j]
    line, total = [counts[period * t + rest] for t in range(m + 1)], 0
    for order in range(m + 1):
        total += math.comb(turns, order) * line[0]
        line = [b - a for a, b in zip(line, line[1:])]
    return total


def arrangements_up_to(u: int, m: int, n: int) -> int:
    """In how many of the comb(m + n, m) orders of m and n distinct values the rank-sum statistic is at most u: the sum of
    at most m parts of at most n each. Parts beyond n are taken out by inclusion and exclusion, so the work depends on the
    smaller side alone."""
    m, n = sorted((m, n))
    signs = Counter({0: 1})  # of the products of (1 - q ** (n + i)), i from 1 to m
    for i in range(1, m + 1):
        for at, sign in list(signs.items()):
            signs[at + n + i] -= sign
    return sum(sign * partitions_up_to(u - at, m) for at, sign in signs.items() if sign)


def rank_sum_exact(u: float, n0: int, n1: int) -> float:
    """Two-sided p-value of the rank-sum statistic ``u`` of n0 and n1 values without ties, over all orders."""
    tail = arrangements_up_to(int(min(u, n0 * n1 - u)), n0, n1)
    return min(1.0, 2 * tail / math.comb(n0 + n1, n0))


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n0: pd.Series, n1: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_exact(float(x), int(a), int(b)) for x, a, b in zip(u, n0, n1)], dtype="float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    # Modified Lentz evaluation of the continued fraction of the incomplete beta integral.
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + step * d) or tiny)
            c = (1.0 + step / c) or tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def f_upper_tail(f: float, df1: float, df2: float) -> float:
    """P(F >= f) with df1 and df2 degrees of freedom."""
    if f != f or df1 <= 0 or df2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    a, b = df2 / 2.0, df1 / 2.0
    x = df2 / (df2 + df1 * f)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def anova_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_upper_tail(*row) for row in zip(f, df1, df2)], dtype="float64")
