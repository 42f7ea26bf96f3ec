"""Mixed models with a random intercept for each subject, many genes at a time.

A model sees of a gene's observations only sums for each subject and group: their number, and the sums of
q, q * q, y, y * y and q * y. Spark adds these up; what is left of a gene is an array of as many cells as it has
samples. The likelihood, profiled to the ratio theta of standard deviations, is then evaluated for all genes of
a batch at once: with w = theta**2 / (1 + n * theta**2) for a subject of n observations, the weighted cross
products are the plain ones less w times those of the subject's sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import chi2_sf, f_sf, numbers, t_sf2

from .filters import enough_observations

#: Below this ratio of standard deviations a mixed fit counts as singular.
SINGULAR = 1e-4
#: Where the likelihood is evaluated before its maximum is narrowed down.
GRID = (0.0, *np.geomspace(1e-3, 1e3, 49))
#: Rounds of the narrowing, each of which takes the bracket to 0.618 of the one before.
ROUNDS = 80
#: Eigenvalues below this fraction of the largest count as 0 (of scaled cross products).
RANK = 1e-10
#: Most numbers of subjects' sums that are held at once.
HELD = 4_000_000

SUMS = ("n", "q", "qq", "y", "yy", "qy")
RESULT = "p_lrt double, p_satterthwaite double, fit_method string, singular boolean"


@dataclass
class Moments:
    """Of G genes: cross products of p columns and y, and for each of S subjects the sums of the columns, of y, and the number."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: np.ndarray
    sx: np.ndarray
    sy: np.ndarray
    sn: np.ndarray

    def columns(self, kept: Sequence[int]) -> Moments:
        return Moments(self.xx[:, kept][:, :, kept], self.xy[:, kept], self.yy, self.n, self.sx[:, :, kept], self.sy, self.sn)

    def less(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross products less ``w`` (G, S) times those of the subjects' sums."""
        weighted = w[:, :, None] * self.sx
        return self.xx - np.swapaxes(weighted, 1, 2) @ self.sx, self.xy - np.einsum("gsi,gs->gi", weighted, self.sy), self.yy - (w * self.sy**2).sum(axis=1)


def _inverse(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Generalised inverses and ranks of cross products."""
    size = np.sqrt(np.maximum(np.einsum("gii->gi", a), 0))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    values, vectors = np.linalg.eigh(a * scale[:, :, None] * scale[:, None, :])
    kept = values > RANK * np.maximum(values[:, -1:], 1e-300)
    inverse = np.einsum("gij,gj,gkj->gik", vectors, np.divide(1.0, values, out=np.zeros_like(values), where=kept), vectors)
    return inverse * scale[:, :, None] * scale[:, None, :], kept.sum(axis=1)


def _solved(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual sums of squares, inverses and ranks of least squares from cross products."""
    inverse, rank = _inverse(a)
    beta = np.einsum("gij,gj->gi", inverse, b)
    return beta, np.maximum(c - (beta * b).sum(axis=1), 1e-300), inverse, rank


class RandomIntercepts:
    """Maximum-likelihood fits of all genes in ``m``; with ``thetas`` theta is the best of these."""

    def __init__(self, m: Moments, thetas: Sequence[float] | None = None):
        self.m = m
        self.theta = self._best(GRID if thetas is None else thetas, narrow=thetas is None)
        self.beta, self.rss, _, _ = self._at(self.theta)
        self.sigma2, self.loglik = self.rss / m.n, self._loglik(self.theta)

    def _at(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t2 = (theta**2)[:, None]
        return _solved(*self.m.less(t2 / (1 + self.m.sn * t2)))

    def _logdet(self, theta: np.ndarray) -> np.ndarray:
        return np.log1p(self.m.sn * (theta**2)[:, None]).sum(axis=1)

    def _loglik(self, theta: np.ndarray) -> np.ndarray:
        n = self.m.n
        return -0.5 * (n * np.log(2 * math.pi * self._at(theta)[1] / n) + n + self._logdet(theta))

    def _best(self, thetas: Sequence[float], narrow: bool) -> np.ndarray:
        grid = np.asarray(thetas, dtype=float)
        found = np.stack([self._loglik(np.full(len(self.m.n), t)) for t in grid])
        k = found.argmax(axis=0)
        if not narrow:
            return grid[k]
        low, high = grid[np.maximum(k - 1, 0)], grid[np.minimum(k + 1, len(grid) - 1)]
        ratio = (math.sqrt(5) - 1) / 2
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        fa, fb = self._loglik(a), self._loglik(b)
        for _ in range(ROUNDS):
            up = fa < fb
            low, high = np.where(up, a, low), np.where(up, high, b)
            fresh = np.where(up, low + ratio * (high - low), high - ratio * (high - low))
            f = self._loglik(fresh)
            a, b, fa, fb = np.where(up, b, fresh), np.where(up, fresh, a), np.where(up, fb, f), np.where(up, f, fa)
        theta = (low + high) / 2
        return np.where(found[0] >= self._loglik(theta), 0.0, theta)

    def deviance(self, theta: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        return self.m.n * np.log(2 * math.pi * sigma**2) + self._logdet(theta) + self._at(theta)[1] / sigma**2

    def variance(self, j: int, theta: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        return sigma**2 * self._at(theta)[2][:, j, j]

    def satterthwaite(self, j: int) -> list[float]:
        """Two-sided p of coefficient j with Satterthwaite's degrees of freedom, by numeric derivatives."""
        at = np.stack([self.theta, np.sqrt(self.sigma2)])
        step = 1e-4 * np.maximum(np.abs(at), 1e-2)

        def moved(f, *signs: tuple[int, int]) -> np.ndarray:
            return f(*(at[i] + sum((s for k, s in signs if k == i), 0) * step[i] for i in range(2)))

        v = lambda *x: self.variance(j, *x)
        gradient = np.stack([(moved(v, (i, 1)) - moved(v, (i, -1))) / (2 * step[i]) for i in range(2)])
        second = lambda i, k: (moved(self.deviance, (i, 1), (k, 1)) - moved(self.deviance, (i, 1), (k, -1)) - moved(self.deviance, (i, -1), (k, 1)) + moved(self.deviance, (i, -1), (k, -1))) / (4 * step[i] * step[k])
        hessian = np.moveaxis(np.array([[second(i, k) for k in range(2)] for i in range(2)]), 2, 0)
        spread = np.einsum("ig,gik,kg->g", gradient, 2 * np.linalg.pinv(hessian), gradient)
        value = v(*at)
        with np.errstate(divide="ignore", invalid="ignore"):
            df = np.where(spread > 0, 2 * value * value / spread, self.m.n)
            t = self.beta[:, j] / np.sqrt(value)
        return [t_sf2(float(x), float(d)) if math.isfinite(x) else math.nan for x, d in zip(t, df, strict=True)]


class RandomIntercept:
    """value ~ X + (1 | subject) of one gene, from its observations."""

    def __init__(self, x: np.ndarray, y: np.ndarray, subject: np.ndarray):
        _, at = np.unique(subject, return_inverse=True)
        of = np.eye(at.max() + 1)[at]
        m = Moments((x.T @ x)[None], (x.T @ y)[None], np.array([y @ y]), np.array([float(len(y))]), (of.T @ x)[None], (of.T @ y)[None], of.sum(axis=0)[None])
        self.fit = RandomIntercepts(m)
        self.theta, self.sigma2, self.loglik = (float(v[0]) for v in (self.fit.theta, self.fit.sigma2, self.fit.loglik))

    def satterthwaite(self, j: int) -> float:
        return self.fit.satterthwaite(j)[0]


def moments_of(gene: np.ndarray, subject: np.ndarray, group: np.ndarray, sums: dict[str, np.ndarray], genes: int, groups: int) -> Moments:
    """Moments of the columns 1, q, one a further group, and q for one a further group, from cells of known gene, subject and group numbers."""
    p = 2 * groups
    place = np.zeros((groups, p, 2))
    place[:, 0, 0] = place[:, 1, 1] = 1
    for g in range(1, groups):
        place[g, 1 + g, 0] = place[g, groups + g, 1] = 1
    own = place[group]
    inner = np.stack([np.stack([sums["n"], sums["q"]], axis=1), np.stack([sums["q"], sums["qq"]], axis=1)], axis=1)
    out = Moments(np.zeros((genes, p, p)), np.zeros((genes, p)), np.zeros(genes), np.zeros(genes), *(np.zeros((genes, subject.max() + 1, *more)) for more in ((p,), (), ())))
    np.add.at(out.xx, gene, own @ inner @ np.swapaxes(own, 1, 2))
    np.add.at(out.xy, gene, np.einsum("cpi,ci->cp", own, np.stack([sums["y"], sums["qy"]], axis=1)))
    np.add.at(out.yy, gene, sums["yy"])
    np.add.at(out.n, gene, sums["n"])
    np.add.at(out.sx, (gene, subject), np.einsum("cpi,ci->cp", own, inner[:, 0]))
    np.add.at(out.sy, (gene, subject), sums["y"])
    np.add.at(out.sn, (gene, subject), sums["n"])
    return out


def fit_all(m: Moments, groups: int, thetas: Sequence[float] | None = None) -> list[tuple]:
    """Per gene (p of the likelihood ratio, Satterthwaite p, how it was fitted, singular) of ``groups`` groups.

    A singular fit, with the interaction or without it, gives way to least squares, with subjects as fixed effects
    if that leaves degrees of freedom, else without them.
    """
    null_columns = list(range(groups + 1))
    full, null = RandomIntercepts(m, thetas), RandomIntercepts(m.columns(null_columns), thetas)
    df = _inverse(m.xx)[1] - _inverse(null.m.xx)[1]
    singular = (full.theta < SINGULAR) | (null.theta < SINGULAR)
    lrt = [chi2_sf(float(2 * (a - b)), int(k)) if k > 0 else None for a, b, k in zip(full.loglik, null.loglik, df, strict=True)]
    out = [(p, s, "lmer", False) for p, s in zip(lrt, full.satterthwaite(groups + 1), strict=True)]
    if singular.any():
        again = np.flatnonzero(singular)
        own = Moments(*(getattr(m, f)[again] for f in ("xx", "xy", "yy", "n", "sx", "sy", "sn")))
        for i, found in zip(again, _least_squares(own, groups), strict=True):
            out[i] = found
    return out


def _least_squares(m: Moments, groups: int) -> list[tuple]:
    present = np.divide(1.0, m.sn, out=np.zeros_like(m.sn), where=m.sn > 0)
    out: list[tuple | None] = [None] * len(m.n)
    for name, w, more in (("lm_subject", present, (m.sn > 0).sum(axis=1)), ("lm_nosubject", present * 0, np.zeros(len(m.n), dtype=int))):
        _, rss1, _, k1 = _solved(*m.less(w))
        _, rss0, _, k0 = _solved(*m.columns(list(range(groups + 1))).less(w))
        one = _first_interaction(m, groups, w, rss1, k1, k1 + more)
        for i, n in enumerate(m.n):
            rest, extra = n - k1[i] - more[i], k1[i] - k0[i]
            if out[i] is None and extra > 0 and rest > 0 and rss1[i] > 1e-14 * m.yy[i]:
                p = f_sf(max(rss0[i] - rss1[i], 0.0) / extra / (rss1[i] / rest), int(extra), int(rest))
                out[i] = (p, p if extra == 1 else one[i], name, True)
    return [(None, None, "fallback", True) if x is None else x for x in out]


def _first_interaction(m: Moments, groups: int, w: np.ndarray, rss1: np.ndarray, k1: np.ndarray, used: np.ndarray) -> list[float | None]:
    """Per gene the t test of the first interaction term that adds to the rank."""
    out: list[float | None] = [None] * len(m.n)
    for j in range(groups + 1, 2 * groups):
        _, rss, _, k = _solved(*m.columns([c for c in range(2 * groups) if c != j]).less(w))
        for i, n in enumerate(m.n):
            if out[i] is None and k[i] < k1[i] and n > used[i]:
                out[i] = f_sf(max(rss[i] - rss1[i], 0.0) / (rss1[i] / (n - used[i])), 1, int(n - used[i]))
    return out


def fit_cells(cells: Sequence[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]], thetas: Sequence[float] | None = None) -> list[tuple]:
    """``fit_all`` of genes given as (subjects, groups, sums), numbered from 0 in the gene; genes of as many groups and about as many subjects go together."""
    out: list[tuple | None] = [None] * len(cells)
    order = sorted(range(len(cells)), key=lambda i: (cells[i][1].max(), cells[i][0].max()))
    begin = 0
    while begin < len(order):
        groups = int(cells[order[begin]][1].max()) + 1
        end = begin
        while end < len(order) and cells[order[end]][1].max() + 1 == groups and (end == begin or (end - begin + 1) * 2 * groups * (cells[order[end]][0].max() + 1) <= HELD):
            end += 1
        some = [cells[i] for i in order[begin:end]]
        gene = np.repeat(np.arange(len(some)), [len(c[0]) for c in some])
        joined = {name: np.concatenate([c[2][name] for c in some]).astype(float) for name in SUMS}
        m = moments_of(gene, np.concatenate([c[0] for c in some]), np.concatenate([c[1] for c in some]), joined, len(some), groups)
        for i, found in zip(order[begin:end], fit_all(m, groups, thetas), strict=True):
            out[i] = found
        begin = end
    return out


def fit_mixed(pdf: pd.DataFrame) -> tuple[float | None, float | None, str, bool]:
    """``fit_all`` of one gene's observations (group, subject, q, value)."""
    rows = pd.DataFrame({"subject": pdf["subject"], "group": pdf["group"], "n": 1.0, "q": pdf["q"], "qq": pdf["q"] ** 2, "y": pdf["value"], "yy": pdf["value"] ** 2, "qy": pdf["q"] * pdf["value"]})
    cells = rows.groupby(["subject", "group"], as_index=False).sum()
    return fit_cells([(numbers(cells["subject"]), numbers(cells["group"]), {s: cells[s].to_numpy() for s in SUMS})])[0]


def mixed_interaction(values: DataFrame, min_obs: int = 10, pvalue: str = "satterthwaite", thetas: Sequence[float] | None = None) -> DataFrame:
    """(gene, p_interaction, p_lrt, p_satterthwaite, fit_method, singular) of (gene, group, subject, q, value).

    The likelihood ratio compares the models with and without interactions, one a further group. With ``thetas`` the
    ratio of standard deviations is the best of these instead of the best of all. Genes, groups and subjects
    may be of any type; rows without group or subject are left out, and Satterthwaite's p is NULL where only the
    likelihood ratio is asked for.
    """
    if pvalue not in ("satterthwaite", "lrt", "both"):
        raise ValueError("pvalue must be 'satterthwaite', 'lrt' or 'both'")
    known = enough_observations(values.where("group is not null and subject is not null"), min_obs, subjects=True)
    q, y = F.col("q").cast("double"), F.col("value").cast("double")
    sums = (F.count("*").cast("double"), F.sum(q), F.sum(q * q), F.sum(y), F.sum(y * y), F.sum(q * y))
    cells = known.groupBy("gene", "subject", "group").agg(*(s.alias(n) for s, n in zip(sums, SUMS, strict=True)))
    genes = cells.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("subject", "group", *SUMS))).alias("cells"))
    group = F.transform("cells", lambda c: c["group"])
    # Cells are sorted, so a subject begins where it differs from the one before.
    begins = F.transform("cells", lambda c, i: F.when(i == 0, 0).otherwise((c["subject"] != F.get("cells", i - 1)["subject"]).cast("int")))

    @F.pandas_udf(RESULT)
    def fit(begins: pd.Series, group: pd.Series, n: pd.Series, q: pd.Series, qq: pd.Series, y: pd.Series, yy: pd.Series, qy: pd.Series) -> pd.DataFrame:
        found = fit_cells([(np.cumsum(b), numbers(g), dict(zip(SUMS, map(np.asarray, s), strict=True))) for b, g, *s in zip(begins, group, n, q, qq, y, yy, qy, strict=True)], thetas)
        return pd.DataFrame(found, columns=["p_lrt", "p_satterthwaite", "fit_method", "singular"]).astype({"p_lrt": "float64", "p_satterthwaite": "float64"})

    sums_of = [F.transform("cells", (lambda n: lambda c: c[n])(n)) for n in SUMS]
    fits = genes.select("gene", fit(begins, group, *sums_of).alias("f")).select("gene", *(F.nanvl(f"f.{c}", F.lit(None)).alias(c) for c in ("p_lrt", "p_satterthwaite")), "f.fit_method", "f.singular")
    if pvalue == "lrt":
        fits = fits.withColumn("p_satterthwaite", F.lit(None).cast("double"))
    first = {"lrt": F.col("p_lrt"), "satterthwaite": F.col("p_satterthwaite"), "both": F.coalesce("p_satterthwaite", "p_lrt")}[pvalue]
    return fits.select("gene", first.alias("p_interaction"), "p_lrt", "p_satterthwaite", "fit_method", "singular")
