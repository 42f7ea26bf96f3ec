"""Wilcoxon rank tests per gene: unpaired and paired, normal approximation and exact."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import missing_to_null, normal_two_sided

from .profiles import marked_cells, profiles, rank_sum, signed_rank
from .settled import settled


def rank_sum_statistics(values: DataFrame, first: str, second: str) -> DataFrame:
    """(gene, n1, n2, u, tie_sum, z) of (gene, group, value): U of the first group, continuity-corrected z.

    tie_sum is the sum of t**3 - t over ties. z is NULL where its variance is 0. A gene without known values
    of the two groups has no row.
    """
    found = profiles(values, first, second).select("gene", rank_sum(F.col("cells")).alias("r"))
    return found.select("gene", "r.*").where("n1 + n2 > 0")


def signed_rank_statistics(pairs: DataFrame) -> DataFrame:
    """(gene, n, zeros, v, tie_sum, z) of (gene, x, y): V of the positive differences x - y, zeros left out."""
    d = missing_to_null(F.col("x")) - missing_to_null(F.col("y"))
    rows = pairs.select("gene", d.alias("d"))
    cells = marked_cells(F.abs("d"), F.when(F.col("d") != 0, F.col("d") > 0))
    genes = rows.groupBy("gene").agg(cells.alias("cells"), F.count_if(F.col("d") == 0).alias("zeros"))
    return genes.select("gene", "zeros", signed_rank(F.col("cells")).alias("r")).select("gene", "r.n", "zeros", "r.v", "r.tie_sum", "r.z")


#: Most numbers, of eight bytes, that the null distribution of an exact test is worked out with; beyond, the normal form serves.
MOST_STATES = 4_000_000


def _rank_sums(n1: int, n2: int, take: float, leave: float) -> np.ndarray:
    """For each U the weights, summed, of the placings of n1 among n1 + n2 ranks: ``take`` for each rank taken, ``leave`` for each other."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for rank in range(1, n1 + n2 + 1):
        for k in range(min(rank, n1), -1, -1):
            ways[k] *= leave
            shift = rank - k
            if k and shift <= n1 * n2:
                ways[k, shift:] += take * ways[k - 1, : n1 * n2 + 1 - shift]
    return ways[n1]


def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """How many of the placings of n1 among n1 + n2 give each U."""
    return _rank_sums(n1, n2, 1.0, 1.0)


@lru_cache(maxsize=4)
def rank_sum_weights(few: int, many: int) -> np.ndarray:
    """The null distribution of U up to a factor: every rank is taken with the probability that makes ``few`` the likeliest number, so that nothing overflows or vanishes."""
    p = few / (few + many)
    return _rank_sums(few, many, p, 1 - p)


def _signed_ranks(n: int, factor: float) -> np.ndarray:
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] = factor * (ways[rank:] + ways[:-rank])
        ways[:rank] *= factor
    return ways


def signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2**n sign patterns give each V."""
    return _signed_ranks(n, 1.0)


@lru_cache(maxsize=4)
def signed_rank_weights(n: int) -> np.ndarray:
    """The null distribution of V: a half for each sign."""
    return _signed_ranks(n, 0.5)


def two_sided(counts: np.ndarray, at: int) -> float:
    """Twice the smaller tail, at most 1."""
    total = counts.sum()
    return float(min(1.0, 2 * min(counts[: at + 1].sum(), counts[at:].sum()) / total))


def rank_sum_p(found: Column, exact: bool) -> Column:
    """The p-value of a struct by ``rank_sum``."""
    if not exact:
        return p_value(found["z"])
    small = (F.least(found["n1"], found["n2"]) + 1) * (found["n1"] * found["n2"] + 1) <= MOST_STATES
    fair = F.when(found["tie_sum"] == 0, F.when(small, _exact_rank_sum(found["n1"], found["n2"], found["u"])).otherwise(p_value(found["z"])))
    return F.coalesce(fair, F.lit(1.0))


def _known(states: float, n: float) -> bool:
    """Whether a row has a test: a worker is given all rows, those that aren't tested exactly too."""
    return n > 0 and states <= MOST_STATES


def _exact_rank_sum(*of: Column) -> Column:
    @F.pandas_udf("double")
    def p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
        def one(a: float, b: float, c: float) -> float | None:
            few, many = sorted((int(a), int(b)))
            return two_sided(rank_sum_weights(few, many), int(round(c))) if _known((few + 1) * (few * many + 1), few) else None

        return pd.Series([one(*x) for x in zip(n1, n2, u, strict=True)], dtype="float64")

    return p(*of)


def _exact_signed_rank(*of: Column) -> Column:
    @F.pandas_udf("double")
    def p(n: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([two_sided(signed_rank_weights(int(a)), int(round(c))) if _known(a * (a + 1) / 2 + 1, a) else None for a, c in zip(n, v, strict=True)], dtype="float64")

    return p(*of)


def p_value(z: Column) -> Column:
    """The two-sided p-value of a test that could be made, else 1."""
    return F.coalesce(F.least(F.lit(1.0), normal_two_sided(z)), F.lit(1.0))


def wilcoxon(values: DataFrame, first: str, second: str, paired: bool = False, exact: bool = False) -> DataFrame:
    """(gene, raw_p_values) of (gene, group, value), or, paired, (gene, group, pair, value).

    A test that can't be made as asked (a gene without variation or values, ties or zero differences
    in an exact test) has p = 1. Every gene of ``values`` has a row. Exact tests are exact as far as their null
    distribution fits into ``MOST_STATES`` numbers (150 values in each group, or 2,800 pairs).
    """
    if paired:
        values = settled(values)
        x, y = (F.max(F.when(F.col("group") == g, F.col("value"))) for g in (first, second))
        sizes = values.groupBy("gene").agg(F.count_if(F.col("group") == first).alias("a"), F.count_if(F.col("group") == second).alias("b"))
        if not sizes.where("a <> b").isEmpty():
            raise ValueError("paired groups must be of equal size")
        stats = signed_rank_statistics(values.groupBy("gene", "pair").agg(x.alias("x"), y.alias("y")))
        fair = (F.col("tie_sum") == 0) & (F.col("zeros") == 0)
    else:
        found = profiles(values, first, second).select("gene", rank_sum(F.col("cells")).alias("r"))
        return found.select("gene", rank_sum_p(F.col("r"), exact).alias("raw_p_values"))
    n = F.col("n")
    by_counts = F.when(n * (n + 1) / 2 + 1 <= MOST_STATES, _exact_signed_rank(n, F.col("v"))).otherwise(p_value(F.col("z")))
    p = F.coalesce(F.when(fair, by_counts), F.lit(1.0)) if exact else p_value(F.col("z"))
    return stats.select("gene", p.alias("raw_p_values"))
