"""Exact quantiles and kernel densities of groups of any size, without a group in one task.

A group's known values are counted by value, and the distinct ones dealt by ranges of group and value.
Counts per range tell which ranges hold the ranks that are asked for; only these are sorted, each by
itself. Densities take a fast Gauss transform: the values of a bin of one bandwidth go into a few sums of
powers, from which the kernels of all of them are expanded at each point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions.numerics import missing_to_null

from .settled import settled

#: Terms of the expansion of a kernel about the middle of its bin. Values are at most half a bandwidth from it,
#: so that what is left out is below 1.1 * sum(0.5**k / sqrt(k!), k >= TERMS) < 1e-11 of a kernel's height.
TERMS = 16
#: Bandwidths beyond which a kernel counts as 0 (it is below 1e-16 there).
REACH = 9


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, whose keys are equal, nulls too."""
    renamed = right.select(*(F.col(k).alias(f"{k}_") for k in keys), *(c for c in right.columns if c not in keys))
    on = [left[k].eqNullSafe(renamed[f"{k}_"]) for k in keys]
    return left.join(renamed, on).drop(*(f"{k}_" for k in keys))


def ranged(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value, m, part): each group's distinct known values, how often they are there, and their range; computed once."""
    known = values.select(*keys, missing_to_null(F.col(value)).alias("value")).where("value is not null")
    # Bounds of ranges come from a pass of their own, which is not to compute the values again.
    distinct = settled(known.groupBy(*keys, "value").agg(F.count("*").alias("m")))
    return settled(distinct.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))


def quantiles(ranges: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(keys, n, p) of a frame by ``ranged``: the number of values, and their quantiles by linear interpolation as an array."""
    own = Window.partitionBy(*keys)
    sizes = ranges.groupBy(*keys, "part").agg(F.sum("m").alias("size"))
    before = F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"before": before, "n": F.sum("size").over(own)})
    places = [(F.col("n") - 1) * p for p in probabilities]
    ranks = F.array_distinct(F.array(*(f(x) for x in places for f in (F.floor, F.ceil))))
    inside = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))
    wanted = sizes.withColumn("ranks", inside).where(F.size("ranks") > 0).drop("size")
    upto = F.sum("m").over(Window.partitionBy(*keys, "part").orderBy("value"))
    placed = beside(ranges, wanted, [*keys, "part"]).withColumn("upto", upto + F.col("before"))
    here = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("m")))
    found = placed.withColumn("here", here).where(F.size("here") > 0)
    pairs = F.flatten(F.collect_list(F.transform("here", lambda r: F.struct(r.alias("rank"), F.col("value").alias("value")))))
    by_rank = found.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(pairs).alias("at"))
    low, high = ([F.element_at("at", f(x)) for x in places] for f in (F.floor, F.ceil))
    between = [a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, places, strict=True)]
    return by_rank.select(*keys, "n", F.array(*between).alias("p"))


def bandwidths(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, low, high, h) of the groups that have a density: 0.9 * min(sd, IQR / 1.34) * n ** -0.2, with sd alone if the IQR is 0."""
    m = F.col("m")
    means = ranges.groupBy(*keys).agg(F.sum("m").alias("n"), (F.sum(m * F.col("value")) / F.sum("m")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    off = F.col("value") - F.col("mean")
    spread = beside(ranges, means, keys).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("n", "low", "high")), F.sum(m * off * off).alias("squares"))
    sd = F.sqrt(F.try_divide(F.col("squares"), F.col("n") - 1))
    robust = (F.col("p")[1] - F.col("p")[0]) / 1.34
    h = 0.9 * F.when(robust > 0, F.least("sd", robust)).otherwise(F.col("sd")) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    quartiles = quantiles(ranges, keys, (0.25, 0.75)).drop("n")
    return beside(spread.withColumn("sd", sd), quartiles, keys).where("sd > 0").select(*keys, "n", "low", "high", h.alias("h"))


def hermite() -> np.ndarray:
    """Row k: the coefficients of the k-th Hermite polynomial (of the density's derivatives), lowest power first."""
    table = np.zeros((TERMS, TERMS))
    table[0, 0] = table[1, 1] = 1
    for k in range(2, TERMS):
        table[k, 1:] = table[k - 1, :-1]
        table[k] -= (k - 1) * table[k - 2]
    return table


def density(values: DataFrame, keys: Sequence[str], points: int = 64) -> DataFrame:
    """(keys, x, density): Gaussian kernel density on an even grid between the extremes of each group.

    A group of one value, or of equal ones, has no density. Bins that hold values are at most as many as
    bandwidths fit between the extremes, and each gives a row for each point in its reach, so the rows are not
    multiplied. The error is below 1e-11 of a kernel's height.
    """
    keys = list(keys)
    ranges = ranged(values, keys)
    widths = bandwidths(ranges, keys)
    scaled = (F.col("value") - F.col("low")) / F.col("h")
    binned = beside(ranges, widths, keys).withColumn("bin", F.floor(scaled)).withColumn("d", scaled - F.col("bin") - 0.5)
    powers, d = [F.col("m").cast("double")], F.col("d")
    for _ in range(1, TERMS):
        powers.append(powers[-1] * d)
    sums = binned.groupBy(*keys, "bin").agg(*(F.first(c).alias(c) for c in ("n", "low", "high", "h")), *(F.sum(p).alias(f"s{k}") for k, p in enumerate(powers)))
    table = hermite()
    factors = [sum((F.col(f"s{k}") * float(table[k, j] / math.factorial(k)) for k in range(TERMS) if table[k, j]), F.lit(0.0)) for j in range(TERMS)]
    centre, step = F.col("low") + (F.col("bin") + 0.5) * F.col("h"), (F.col("high") - F.col("low")) / (points - 1)
    first = F.greatest(F.lit(0), F.ceil((centre - REACH * F.col("h") - F.col("low")) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((centre + REACH * F.col("h") - F.col("low")) / step)).cast("int")
    bins = sums.select(*keys, "n", "low", "high", "h", centre.alias("centre"), F.array(*factors).alias("c"), first.alias("first"), last.alias("last")).where("first <= last")
    at = bins.withColumn("i", F.explode(F.sequence("first", "last"))).withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (points - 1))
    at = at.withColumn("t", (F.col("x") - F.col("centre")) / F.col("h"))
    kernel = _polynomial(F.col("t")) * F.exp(-F.col("t") * F.col("t") / 2) / math.sqrt(2 * math.pi)
    return at.groupBy(*keys, "i", "x").agg((F.sum(kernel) / F.first("h") / F.first("n")).alias("density")).drop("i")


def _polynomial(t: Column) -> Column:
    out = F.col("c")[TERMS - 1]
    for j in range(TERMS - 2, -1, -1):
        out = out * t + F.col("c")[j]
    return out
