"""Curves of diversity by order, compared by their scores on the first principal component.

A gene is one row with its observations as an array. A sample whose curve is known at half of the orders or more
counts, and a gap in it is the mean of the others, so centred curves are 0 there. The component is the first
eigenvector of the orders' cross products, and the scores of two groups are compared by Welch's test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import numbers, t_sf2

from .filters import enough_observations


def welch_p(a: np.ndarray, b: np.ndarray) -> float | None:
    """Two-sided p of Welch's t test."""
    if len(a) < 2 or len(b) < 2:
        return None
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    if va + vb <= 0:
        return None
    return t_sf2((a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))


def compare(sample: np.ndarray, order: np.ndarray, group: np.ndarray, value: np.ndarray, min_obs: int) -> float | None:
    """Welch p between the first two groups, in the order of samples, of numbered samples, orders and groups; None if it can't be made."""
    curves = np.full((sample.max() + 1, order.max() + 1), np.nan)
    curves[sample, order] = value
    of = np.zeros(len(curves), dtype=int)
    of[sample] = group
    known = ~np.isnan(curves)
    kept = known.sum(axis=1) >= max(2, math.ceil(curves.shape[1] / 2))
    curves, known, of = curves[kept], known[kept], of[kept]
    if len(curves) < min_obs or curves.shape[1] < 2 or not known.any(axis=0).all():
        return None
    first = list(dict.fromkeys(of.tolist()))[:2]
    if len(first) < 2:
        return None
    centred = np.where(known, curves - np.nanmean(curves, axis=0), 0.0)
    score = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
    return welch_p(score[of == first[0]], score[of == first[1]])


def order_means(values: DataFrame) -> DataFrame:
    """(gene, q, mean, gaps) of (gene, q, value): what gaps in the curves of a gene are filled with, and how many there are."""
    return values.groupBy("gene", "q").agg(F.avg("value").alias("mean"), F.count_if(F.col("value").isNull()).alias("gaps")).where("mean is not null")


def fit_curves(pdf: pd.DataFrame, min_obs: int) -> float | None:
    """``compare`` of one gene's observations (group, sample, q, value)."""
    return compare(numbers(pdf["sample"]), numbers(pdf["q"]), numbers(pdf["group"]), pdf["value"].to_numpy(float), min_obs)


def curve_interaction(values: DataFrame, min_obs: int = 10) -> DataFrame:
    """(gene, p_interaction) by functional principal components of (gene, group, sample, q, value).

    Of several values of a gene, sample and order the least counts; rows without group, sample or order are left out.
    A gene with too few curves, or whose scores can't be compared, has no row. Genes, groups and samples may be of any type.
    """
    known = enough_observations(values.where("group is not null and sample is not null and q is not null"), min_obs)
    cells = known.groupBy("gene", "sample", "q").agg(F.min("group").alias("group"), F.min(F.col("value").cast("double")).alias("value"))
    genes = cells.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("sample", "q", "group", "value"))).alias("cells"))
    begins = F.transform("cells", lambda c, i: F.when(i == 0, 0).otherwise((c["sample"] != F.get("cells", i - 1)["sample"]).cast("int")))

    @F.pandas_udf("double")
    def fit(begins: pd.Series, order: pd.Series, group: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([compare(np.cumsum(b), numbers(o), numbers(g), np.asarray(v), min_obs) for b, o, g, v in zip(begins, order, group, value, strict=True)], dtype="float64")

    p = fit(begins, *(F.transform("cells", (lambda c: lambda x: x[c])(c)) for c in ("q", "group", "value")))
    return genes.select("gene", p.alias("p_interaction")).where("p_interaction is not null and not isnan(p_interaction)")
