"""Corrections of p-values for many tests, without a window over all of them.

Equal p-values are adjusted alike, so the distinct ones with their counts are sorted into ranges; ranks
and running extremes of a range are windows inside it, and what lies before or after it comes from one
row per range. Families (``within``) have windows of their own, and so has a single family of at most
``FEW`` rows, which is counted first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hommel import adjusted
from .settled import settled

#: The names of the corrections.
METHODS = ("holm", "hochberg", "hommel", "bonferroni", "BH", "BY", "fdr", "none")
#: Terms of a harmonic number that are summed; the rest comes from its expansion.
HARMONIC_TERMS = 64
#: Most rows of a family whose distinct p-values, two numbers each, are one window.
FEW = 100_000


def adjust(rows: DataFrame, method: str = "BH", p: str = "raw_p_values", out: str = "adjusted_p_values", within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the adjusted p-values in ``out``; missing ones stay missing and don't count.

    Hommel's correction brings the distinct p-values of families by ``within``, two numbers each, to one task a
    family; a single family of more than ``FEW`` rows is dealt over tasks.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if method == "none":
        return rows.withColumn(out, F.col(p))
    rows = settled(rows)
    known = rows.where(F.col(p).isNotNull())
    if method == "bonferroni":
        n = known.groupBy(*within).agg(F.count("*").alias("_n"))
        whole = rows.join(n, list(within), "left") if within else rows.crossJoin(F.broadcast(n))
        return whole.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_n") * F.col(p)))).drop("_n")
    distinct = known.groupBy(*within, F.col(p).alias("_p")).agg(F.count("*").alias("_m"))
    few = bool(within) or rows.count() <= FEW
    if method == "hommel":
        found = _hommel(distinct, out, within) if few else _hommel_in_stretches(distinct, out)
    else:
        found = (_in_families if few else _in_ranges)(distinct, method).select(*within, "_p", F.least(F.lit(1.0), "_best").alias(out))
    joined = rows.withColumn("_p", F.col(p)).join(found, [*within, "_p"], "left")
    return joined.select(*rows.columns, out)


def _step(method: str, n: Column, last: Column, m: Column) -> tuple[Column, bool]:
    """The factor of a distinct p of rank ``last`` at most, ``m`` times there, of n; and if the extreme runs upwards."""
    if method == "holm":
        return n - (last - m), True
    if method == "hochberg":
        return n - last + 1, False
    if method == "BY":
        return _harmonic(n) * n / last, False
    return n / last, False


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n."""
    few = F.least(n, F.lit(HARMONIC_TERMS))
    tail = lambda x: F.ln(x) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    head = F.aggregate(F.sequence(F.lit(1), F.greatest(few, F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / k)
    return head + tail(F.greatest(n, F.lit(1)).cast("double")) - tail(F.greatest(few, F.lit(1)).cast("double"))


def _in_families(distinct: DataFrame, method: str) -> DataFrame:
    """``distinct`` (family, _p, _m) with ``_best``: the extreme of the steps on the side that the method looks at."""
    by = Window.partitionBy(*(c for c in distinct.columns if c not in ("_p", "_m")))
    up = by.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    factor, upwards = _step(method, F.col("_n"), F.col("_last"), F.col("_m"))
    stepped = distinct.withColumns({"_n": F.sum("_m").over(by), "_last": F.sum("_m").over(up)}).withColumn("_step", factor * F.col("_p"))
    best = F.max("_step").over(up) if upwards else F.min("_step").over(by.orderBy("_p").rowsBetween(0, Window.unboundedFollowing))
    return stepped.withColumn("_best", best)


def _ranked(distinct: DataFrame) -> DataFrame:
    """``distinct`` (_p, _m) of a single family with ``_range``, ``_last``, the last of their ranks, and ``_n``, the number of all."""
    ranges = settled(distinct.repartitionByRange("_p").withColumn("_range", F.spark_partition_id()))
    up = Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.sum("_m").alias("_size"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"), F.sum("_size").over(Window.partitionBy()).alias("_n"))
    return ranges.withColumn("_last", F.sum("_m").over(up)).join(F.broadcast(sizes), "_range").withColumn("_last", F.col("_last") + F.col("_first")).drop("_first")


def _hommel_in_stretches(distinct: DataFrame, out: str) -> DataFrame:
    points = settled(_ranked(distinct).select(F.col("_last").alias("rank"), F.col("_p").alias("p"), F.col("_n").alias("n")))
    n = points.agg(F.max("n")).first()[0]
    if n is None:
        return distinct.select("_p", F.col("_p").alias(out))
    return adjusted(points.drop("n"), n).select(F.col("p").alias("_p"), F.col("adjusted").alias(out))


def _in_ranges(distinct: DataFrame, method: str) -> DataFrame:
    """As ``_in_families`` for a single family, by ranges of p: two tables of one row per range carry ranks and extremes over."""
    by = Window.partitionBy("_range")
    up = by.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    over_ranges = Window.orderBy("_range")
    before, after = over_ranges.rowsBetween(Window.unboundedPreceding, -1), over_ranges.rowsBetween(1, Window.unboundedFollowing)
    factor, upwards = _step(method, F.col("_n"), F.col("_last"), F.col("_m"))
    stepped = settled(_ranked(distinct).withColumn("_step", factor * F.col("_p")))
    if upwards:
        own, others = F.max("_step").over(up), F.max("_far").over(before)
    else:
        own, others = F.min("_step").over(by.orderBy("_p").rowsBetween(0, Window.unboundedFollowing)), F.min("_far").over(after)
    far = stepped.groupBy("_range").agg((F.max if upwards else F.min)("_step").alias("_far")).select("_range", others.alias("_far"))
    pick = F.greatest if upwards else F.least
    return stepped.withColumn("_own", own).join(F.broadcast(far), "_range").withColumn("_best", pick("_own", "_far"))


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values of known p-values, by closed testing with Simes tests.

    Of the sets of m hypotheses the one of the m largest p-values is the last that its Simes test
    rejects, at a level c(m), the least of m p(n - m + j) / j: m times the least slope from (n - m, 0) to
    the points (k, p(k)) beyond, so a tangent to their lower hull. At level a at most h(a) hypotheses can
    all be true, the largest m with c(m) > a, and one is rejected if h(a) p <= a.
    """
    n = len(p)
    order = np.argsort(p, kind="stable")
    s = np.concatenate([[0.0], np.asarray(p, dtype=float)[order]])
    level, hull = np.zeros(n + 2), []
    for a in range(n - 1, -1, -1):
        k = a + 1
        while len(hull) >= 2 and (s[hull[-1]] - s[k]) * (hull[-2] - k) >= (s[hull[-2]] - s[k]) * (hull[-1] - k):
            hull.pop()
        hull.append(k)
        low, high = 0, len(hull) - 1
        while low < high:
            mid = (low + high) // 2
            if s[hull[mid]] * (hull[mid + 1] - a) <= s[hull[mid + 1]] * (hull[mid] - a):
                high = mid
            else:
                low = mid + 1
        level[n - a] = (n - a) * s[hull[low]] / (hull[low] - a)
    level = np.maximum.accumulate(level[::-1])[::-1]
    sizes = np.arange(1, n + 1)
    most = np.searchsorted(-level[1 : n + 1] / sizes, -s[1:], side="left")
    out = np.empty(n)
    out[order] = np.minimum(np.maximum(level[most + 1], most * s[1:]), 1.0)
    return out


def _hommel(distinct: DataFrame, out: str, within: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in distinct.dtypes if c != "_m") + f", {out} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, count = pdf["_p"].to_numpy(), pdf["_m"].to_numpy()
        return pdf.drop(columns=["_m", "_all"]).assign(**{out: hommel(np.repeat(values, count))[np.cumsum(count) - count]})

    return distinct.withColumn("_all", F.lit(0)).groupBy(*(within or ["_all"])).applyInPandas(run, schema)
