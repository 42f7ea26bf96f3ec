"""Distribution tails, guards and labels as column expressions, and their numpy counterparts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this distance from 1 an order q takes the limit (Shannon) branch.
Q_TOLERANCE = 2.0**-26


def missing_to_null(c: Column) -> Column:
    """NaN and infinities as NULL, so that aggregates skip them."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def log_base(c: Column, base: float = math.e) -> Column:
    return F.ln(c) if base == math.e else F.ln(c) / F.lit(math.log(base))


def normal_two_sided(z: Column, terms: int = 60) -> Column:
    """P(|Z| >= |z|): the odd-factorial series up to 3.5, Laplace's continued fraction beyond."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    start = F.struct(a.alias("term"), a.alias("total"))
    step = lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total"))
    near = 1 - 2 * density * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["total"])
    tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(0.0), lambda s, k: k / (a + s))
    return F.when(a.isNull(), None).when(a < 3.5, near).otherwise(2 * density / (a + tail))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for a whole number of degrees of freedom, by the finite trigonometric series."""
    n = df.cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(n.cast("double")))
    c2 = F.cos(angle) * F.cos(angle)

    def series(last: Column, first: Column, ratio) -> Column:
        begin = F.struct(first.alias("term"), first.alias("total"))
        step = lambda s, j: F.struct((s["term"] * ratio(j) * c2).alias("term"), (s["total"] + s["term"] * ratio(j) * c2).alias("total"))
        return F.when(last < 0, F.lit(0.0)).otherwise(F.aggregate(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: j > 0), begin, step, lambda s: s["total"]))

    even = F.sin(angle) * series(F.floor((n - 2) / 2).cast("int"), F.lit(1.0), lambda j: (2 * j - 1) / (2 * j))
    odd = 2 / math.pi * (angle + F.sin(angle) * series(F.floor((n - 3) / 2).cast("int"), F.cos(angle), lambda j: 2 * j / (2 * j + 1)))
    return F.when(t.isNull() | n.isNull() | (n < 1), None).otherwise(F.greatest(F.lit(0.0), 1 - F.when(n % 2 == 0, even).otherwise(odd)))


def format_label(c: Column) -> Column:
    """Underscores as blanks, runs of blanks made one, trimmed, lower case with a capital in front."""
    low = F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "_", " "), r"\s+", " ")))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))


def numbers(names: Sequence) -> np.ndarray:
    """The place, from 0, of each of ``names`` among the distinct ones in their order."""
    return np.unique(np.asarray(names), return_inverse=True)[1]


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_1_sf(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return chi2_sf(x, 1)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square for a whole number of degrees of freedom, by the finite series of its halves."""
    h = max(x, 0.0) / 2
    if df % 2:
        total, first = math.erfc(math.sqrt(h)), 0.5
    else:
        total, first = 0.0, 0.0
    terms = [first + i for i in range(df // 2)]
    return total + sum(math.exp(-h + k * math.log(h) - math.lgamma(k + 1)) if h else float(k == 0) for k in terms)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t for any positive degrees of freedom."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0
