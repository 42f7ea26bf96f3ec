"""Hommel's correction of one family of any size.

With p-values of ranks 1 to n, the set of the m largest is rejected by its Simes test at the level m times the
least slope from (n - m, 0) to the points (rank, p) beyond. As n - m grows, the point of least slope only moves
to larger ranks. So a few starting points, found in a pass over all points, tell for each stretch of starting
points between them which stretch of ranks can hold its points of least slope: these stretches share only their ends. Stretches
of too many ranks are split again, and each of the others is solved in a task of its own by a lower hull. Levels are
running maxima, a number a stretch carries them over; how many hypotheses can all be true at a p-value is a count over
ranges of values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settled import settled

#: Most ranks, and most starting points, of a stretch that is solved in one task.
MOST = 200_000
#: Into how many parts a stretch of too many is split.
PARTS = 32

#: First and last starting point, and first and last rank that can be of least slope for them.
Stretch = tuple[int, int, int, int]


def tangents(ranks: np.ndarray, p: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each starting point ``first`` to ``last`` the least slope to a point of larger rank; ranks ascend, and one lies beyond ``last``."""
    hull: list[int] = []
    out, k = np.empty(last - first + 1), len(ranks) - 1
    for a in range(last, first - 1, -1):
        while k >= 0 and ranks[k] > a:
            while len(hull) >= 2 and (p[hull[-1]] - p[k]) * (ranks[hull[-2]] - ranks[k]) >= (p[hull[-2]] - p[k]) * (ranks[hull[-1]] - ranks[k]):
                hull.pop()
            hull.append(k)
            k -= 1
        low, high = 0, len(hull) - 1
        while low < high:
            mid = (low + high) // 2
            if p[hull[mid]] * (ranks[hull[mid + 1]] - a) <= p[hull[mid + 1]] * (ranks[hull[mid]] - a):
                high = mid
            else:
                low = mid + 1
        out[a - first] = p[hull[low]] / (ranks[hull[low]] - a)
    return out


def _least_points(points: DataFrame, asked: list[tuple[int, int, int]]) -> dict[int, int]:
    """For each (starting point, first rank, last rank) the rank of least slope, the largest of equal ones, in one pass over ``points``."""
    table = np.array(asked, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slope, rank = np.full(len(table), np.inf), np.zeros(len(table), dtype=np.int64)
        for pdf in batches:
            k, p = pdf["rank"].to_numpy(), pdf["p"].to_numpy()
            order = np.argsort(k)
            k, p = k[order], p[order]
            for i, (a, low, high) in enumerate(table):
                begin, end = np.searchsorted(k, max(low, a + 1)), np.searchsorted(k, high, side="right")
                if begin < end:
                    found = p[begin:end] / (k[begin:end] - a)
                    j = len(found) - 1 - int(found[::-1].argmin())
                    if (found[j], -k[begin + j]) < (slope[i], -rank[i]):
                        slope[i], rank[i] = found[j], k[begin + j]
        known = rank > 0
        yield pd.DataFrame({"a": table[known, 0], "slope": slope[known], "rank": rank[known]})

    parts = points.mapInPandas(run, "a long, slope double, rank long")
    return {r["a"]: -r["best"]["less"] for r in parts.groupBy("a").agg(F.min(F.struct("slope", (-F.col("rank")).alias("less"))).alias("best")).collect()}


def stretches(points: DataFrame, n: int, most: int = MOST, split: int = PARTS) -> list[Stretch]:
    """Stretches that cover the starting points 0 to n - 1, of at most ``most`` of them and of ranks."""
    done: list[Stretch] = []
    todo: list[Stretch] = [(0, n - 1, 1, n)]
    while todo:
        large = [s for s in todo if max(s[1] - s[0], s[3] - s[2]) >= most]
        done += [s for s in todo if max(s[1] - s[0], s[3] - s[2]) < most]
        cuts = [sorted({s[0] + (s[1] - s[0]) * i // split for i in range(split + 1)}) for s in large]
        found = _least_points(points, [(a, s[2], s[3]) for s, own in zip(large, cuts, strict=True) for a in own]) if large else {}
        todo = []
        for s, own in zip(large, cuts, strict=True):
            todo += [(a, b - 1, found[a], found[b]) for a, b in zip(own, own[1:], strict=False)]
            done.append((own[-1], own[-1], found[own[-1]], found[own[-1]]))
    return sorted(done)


def levels(points: DataFrame, n: int, most: int = MOST, split: int = PARTS) -> DataFrame:
    """(m, level): the level from which on the sets of m hypotheses, or of more, are all rejected; computed once."""
    found = stretches(points, n, most, split)
    table = np.array(found, dtype=np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Stretches ascend in ranks and share only their ends, so those of a rank are in a row.
            k = pdf["rank"].to_numpy()
            begin, end = np.searchsorted(table[:, 3], k), np.searchsorted(table[:, 2], k, side="right")
            often = np.maximum(end - begin, 0)
            stretch = np.repeat(begin, often) + np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
            yield pd.DataFrame({"stretch": stretch, "rank": np.repeat(k, often), "p": np.repeat(pdf["p"].to_numpy(), often)})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["stretch"].iloc[0])
        first, last = int(table[i, 0]), int(table[i, 1])
        pdf = pdf.sort_values("rank")
        a = np.arange(first, last + 1)
        own = (n - a) * tangents(pdf["rank"].to_numpy(), pdf["p"].to_numpy(), first, last)
        return pd.DataFrame({"stretch": i, "m": n - a, "own": np.maximum.accumulate(own)})

    dealt = points.mapInPandas(deal, "stretch long, rank long, p double")
    solved = settled(dealt.groupBy("stretch").applyInPandas(solve, "stretch long, m long, own double"))
    tops = sorted(tuple(r) for r in solved.groupBy("stretch").agg(F.max("own")).collect())
    before = np.maximum.accumulate([0.0, *(top for _, top in tops)])[:-1]
    told = points.sparkSession.createDataFrame([(s, float(b)) for (s, _), b in zip(tops, before, strict=True)], "stretch long, before double")
    # One number a stretch, of which there are at most some thousands for a thousand million p-values.
    return settled(solved.join(F.broadcast(told), "stretch").select("m", F.greatest("own", "before").alias("level")))


def adjusted(points: DataFrame, n: int, most: int = MOST, split: int = PARTS) -> DataFrame:
    """(p, adjusted) of ``points`` (rank, p): distinct p-values with the last of their ranks, of n in all."""
    found = levels(points, n, most, split)
    ratios = found.groupBy((F.col("level") / F.col("m")).alias("value")).agg(F.count("*").alias("larger"), F.lit(False).alias("asked"))
    merged = ratios.unionByName(points.select(F.col("p").alias("value"), F.lit(0).cast("long").alias("larger"), F.lit(True).alias("asked")))
    merged = merged.groupBy("value").agg(F.sum("larger").alias("larger"), F.bool_or("asked").alias("asked"))
    ranges = settled(merged.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("part").agg(F.sum("larger").alias("size")).withColumn("beyond", F.coalesce(F.sum("size").over(after), F.lit(0))).drop("size")
    above = F.coalesce(F.sum("larger").over(Window.partitionBy("part").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = ranges.withColumn("above", above).join(F.broadcast(sizes), "part").where("asked").select(F.col("value").alias("p"), (F.col("above") + F.col("beyond")).alias("true"))
    joined = counted.join(found, F.col("m") == F.col("true") + 1, "left")
    return joined.select("p", F.least(F.lit(1.0), F.greatest(F.coalesce("level", F.lit(0.0)), F.col("true") * F.col("p"))).alias("adjusted"))
