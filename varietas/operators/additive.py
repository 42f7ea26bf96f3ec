"""Additive models of diversity by order: one smooth curve for all groups, or one for each.

The fits see of a gene's observations only the sums for each group and order: their number, y and y * y, which
Spark makes. Genes observed alike share the spline basis, and one decomposition makes cross products and
penalty diagonal at once. For a weight w of the penalty a direction of eigenvalue s then keeps 1 / (1 + w * s) of its
part of y, so residuals and degrees of freedom are sums over directions, and the weights of least generalised
cross-validation are found on a continuous scale for all genes together. Curves of different groups share no
observations, so their directions are found group by group.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import f_sf, numbers

from .filters import enough_observations

#: Powers of ten between which the weight of a penalty is sought, and how many points are tried first.
POWERS, POINTS = (-8.0, 8.0), 49
#: Rounds in which a bracket is narrowed to 0.618 of the one before, and sweeps over the groups' weights at most.
ROUNDS, SWEEPS = 48, 30
#: Largest size of a basis.
MOST_KNOTS = 10
RANK = 1e-10


def spline_basis(q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural cubic splines through values at k knots, quantiles of the distinct orders, and the penalty of their curvature."""
    knots = np.quantile(np.unique(q), np.linspace(0, 1, k))
    h = np.diff(knots)
    bend, inner = np.zeros((k - 2, k)), np.diag((h[:-1] + h[1:]) / 3)
    for i in range(k - 2):
        bend[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
    for i in range(k - 3):
        inner[i, i + 1] = inner[i + 1, i] = h[i + 1] / 6
    curvature = np.vstack([np.zeros(k), np.linalg.solve(inner, bend), np.zeros(k)])
    j = np.clip(np.searchsorted(knots, q, side="right") - 1, 0, k - 2)
    left, right = (knots[j + 1] - q) / h[j], (q - knots[j]) / h[j]
    x = np.zeros((len(q), k))
    x[np.arange(len(q)), j] += left
    x[np.arange(len(q)), j + 1] += right
    for side, at in ((left, j), (right, j + 1)):
        x += ((side**3 - side) * h[j] ** 2 / 6)[:, None] * curvature[at]
    return x, bend.T @ np.linalg.solve(inner, bend)


@dataclass
class Directions:
    """Of a penalised block: eigenvalues s, and of G genes the squared parts of y along each direction."""

    s: np.ndarray
    parts: np.ndarray

    def at(self, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the penalty adds to the residual sum of squares, and the degrees of freedom, at weights 10 ** power."""
        kept = 1 / (1 + 10.0 ** power[:, None] * self.s)
        return (self.parts * (1 - kept) ** 2).sum(axis=1), kept.sum(axis=1)


def directions(x: np.ndarray, penalty: np.ndarray, n: np.ndarray, y: np.ndarray) -> Directions:
    """Of cells with rows ``x``, numbers ``n`` and, of G genes, sums ``y`` (G, cells); ``penalty`` belongs to the last columns."""
    whole = np.zeros((x.shape[1], x.shape[1]))
    whole[-len(penalty) :, -len(penalty) :] = penalty
    values, vectors = np.linalg.eigh(x.T @ (n[:, None] * x))
    kept = values > RANK * values.max()
    scaled = vectors[:, kept] / np.sqrt(values[kept])
    s, turn = np.linalg.eigh(scaled.T @ whole @ scaled)
    return Directions(np.where(s > RANK * max(s.max(), 1e-300), s, 0.0), (y @ x @ scaled @ turn) ** 2)


def least(score, genes: int) -> np.ndarray:
    """Per gene the power at which ``score`` (of an array of powers) is least: the best of some points, narrowed down."""
    points = np.linspace(*POWERS, POINTS)
    k = np.stack([score(np.full(genes, p)) for p in points]).argmin(axis=0)
    low, high = points[np.maximum(k - 1, 0)], points[np.minimum(k + 1, POINTS - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(ROUNDS):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        down = score(a) < score(b)
        low, high = np.where(down, low, a), np.where(down, b, high)
    return (low + high) / 2


def cross_validation(n: float, rss: np.ndarray, edf: np.ndarray) -> np.ndarray:
    return n * rss / np.maximum(n - edf, 1e-6) ** 2


def fitted(blocks: Sequence[Directions], total: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Residual sums of squares and degrees of freedom of G genes at the weights of least cross-validation, one a block.

    One weight for all blocks is the start; then each block's is improved in turn until none changes.
    """
    genes = len(total)
    floor = np.maximum(total - sum(b.parts.sum(axis=1) for b in blocks), 1e-300)

    def summed(powers: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        each = [b.at(p) for b, p in zip(blocks, powers, strict=True)]
        return floor + sum(r for r, _ in each), sum(e for _, e in each)

    powers = [least(lambda p: cross_validation(n, *summed([p] * len(blocks))), genes)] * len(blocks)
    for _ in range(SWEEPS if len(blocks) > 1 else 0):
        before = cross_validation(n, *summed(powers))
        for i in range(len(blocks)):
            own = least(lambda p, i=i: cross_validation(n, *summed([*powers[:i], p, *powers[i + 1 :]])), genes)
            better = cross_validation(n, *summed([*powers[:i], own, *powers[i + 1 :]])) < cross_validation(n, *summed(powers))
            powers = [*powers[:i], np.where(better, own, powers[i]), *powers[i + 1 :]]
        if np.all(before - cross_validation(n, *summed(powers)) <= 1e-13 * before):
            break
    return summed(powers)


def models(group: np.ndarray, q: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[list[Directions], list[Directions]] | None:
    """The blocks of one curve for all groups, and of one for each; None for fewer than three orders."""
    orders = len(np.unique(q))
    if orders < 3:
        return None
    basis, penalty = spline_basis(q, max(3, min(MOST_KNOTS, orders - 1)))
    basis = basis - (n[:, None] * basis).sum(axis=0) / n.sum()
    marks = np.eye(group.max() + 1)[group]
    one = [directions(np.column_stack([marks, basis]), penalty, n, y)]
    each = [directions(np.column_stack([np.ones(on.sum()), basis[on]]), penalty, n[on], y[:, on]) for on in (group == g for g in range(group.max() + 1))]
    return one, each


def tested(group: np.ndarray, q: np.ndarray, n: np.ndarray, y: np.ndarray, yy: np.ndarray) -> list[float | None]:
    """F test p of the two models for G genes of the same cells: sums ``y`` (G, cells), and ``yy`` (G)."""
    found = models(group, q, n, y)
    if found is None:
        return [None] * len(yy)
    size = float(n.sum())
    (rss0, edf0), (rss1, edf1) = (fitted(blocks, yy, size) for blocks in found)
    out: list[float | None] = []
    for r0, e0, r1, e1, total in zip(rss0, edf0, rss1, edf1, yy, strict=True):
        if r1 <= 1e-14 * total:
            out.append(None)
        elif e1 <= e0 + 1e-8 or size <= e1:
            out.append(1.0)
        else:
            out.append(f_sf(max(r0 - r1, 0.0) / (e1 - e0) / (r1 / (size - e1)), float(e1 - e0), float(size - e1)))
    return out


def fit_additive(pdf: pd.DataFrame) -> float | None:
    """F test p of value ~ group + s(q) against value ~ group + s(q, by group) of one gene; None if it can't be made."""
    cells = pdf.assign(yy=pdf["value"] ** 2).groupby(["group", "q"], as_index=False).agg(n=("value", "size"), y=("value", "sum"), yy=("yy", "sum"))
    return tested(numbers(cells["group"]), cells["q"].to_numpy(float), cells["n"].to_numpy(float), cells["y"].to_numpy(float)[None], np.array([cells["yy"].sum()]))[0]


def additive_interaction(values: DataFrame, min_obs: int = 10) -> DataFrame:
    """(gene, p_interaction) by penalised cubic regression splines of (gene, group, q, value).

    A gene with fewer than three orders, or without residuals, has no row. Genes and groups may be of any type; rows
    without group or order are left out.
    """
    known = enough_observations(values.where("group is not null and q is not null"), min_obs)
    y = F.col("value").cast("double")
    cells = known.groupBy("gene", "group", F.col("q").cast("double").alias("q")).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"))
    genes = cells.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("group", "q", "n", "y", "yy"))).alias("cells"))
    group = F.transform("cells", lambda c: c["group"])

    @F.pandas_udf("double")
    def fit(group: pd.Series, q: pd.Series, n: pd.Series, y: pd.Series, yy: pd.Series) -> pd.Series:
        alike = defaultdict(list)
        group = [numbers(g) for g in group]
        for i, seen in enumerate(zip(group, q, n, strict=True)):
            alike[b"|".join(np.ascontiguousarray(v).tobytes() for v in seen)].append(i)
        out: list[float | None] = [None] * len(group)
        for members in alike.values():
            first = members[0]
            found = tested(*(np.asarray(v[first]) for v in (group, q, n)), np.stack([y[i] for i in members]), np.array([yy[i].sum() for i in members]))
            for i, p in zip(members, found, strict=True):
                out[i] = p
        return pd.Series(out, dtype="float64")

    p = fit(group, *(F.transform("cells", (lambda c: lambda x: x[c])(c)) for c in ("q", "n", "y", "yy")))
    return genes.select("gene", p.alias("p_interaction")).where("p_interaction is not null and not isnan(p_interaction)")
