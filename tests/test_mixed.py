import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varietas.functions import numerics
from varietas.operators import interaction, mixed


def observations(seed, groups="AB", subjects=9, orders=6, slope=0.2, spread=0.4, crossed=False):
    """Rows (subject, group, q, value); with ``crossed`` every subject is in all groups."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        shift = rng.normal(0, spread)
        for g in groups if crossed else [groups[s % len(groups)]]:
            for q in np.linspace(0.2, 2, orders):
                rows.append((f"s{s}", g, float(q), float(0.3 * q + shift + slope * groups.index(g) * q + rng.normal(0, 0.2))))
    return pd.DataFrame(rows, columns=["subject", "group", "q", "value"])


def designs(pdf):
    q = pdf["q"].to_numpy()
    dummies = [(pdf["group"] == g).to_numpy(float) for g in sorted(pdf["group"].unique())[1:]]
    null = np.column_stack([np.ones(len(q)), q, *dummies])
    return np.column_stack([null, *(d * q for d in dummies)]), null


def explicit(x, y, same, theta):
    """Log-likelihood at theta from the covariance matrix of the observations, profiled over sigma."""
    v = np.eye(len(y)) + theta**2 * same
    w = np.linalg.inv(v)
    left = y - x @ np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
    s2 = left @ w @ left / len(y)
    return -0.5 * (len(y) * math.log(2 * math.pi * s2) + len(y) + np.linalg.slogdet(v)[1])


def best(x, y, same):
    """The largest likelihood, found by looking ever closer around the best of 21 points."""
    low, high = math.log(1e-2), math.log(1e2)
    for _ in range(5):
        points = np.linspace(low, high, 21)
        found = [explicit(x, y, same, math.exp(t)) for t in points]
        k = int(np.argmax(found))
        low, high = points[max(k - 1, 0)], points[min(k + 1, 20)]
    return max(found)


def cells_of(pdf):
    found = []
    keep = mixed.fit_cells
    try:
        mixed.fit_cells = lambda cells, thetas=None: found.extend(cells) or [None]
        mixed.fit_mixed(pdf)
    finally:
        mixed.fit_cells = keep
    return found[0]


@pytest.mark.parametrize("groups,crossed", [("AB", False), ("ABC", False), ("ABCD", True), ("AB", True)])
def test_likelihood_ratios_against_explicit_covariances(groups, crossed):
    pdf = observations(len(groups), groups, 6 if crossed else 12, 5, crossed=crossed)
    full, null = designs(pdf)
    y, subject = pdf["value"].to_numpy(), pdf["subject"].to_numpy()
    same = (subject[:, None] == subject[None, :]).astype(float)
    ratio = 2 * (best(full, y, same) - best(null, y, same))
    lrt, satterthwaite, how, singular = mixed.fit_mixed(pdf)
    assert (how, singular) == ("lmer", False) and 0 <= satterthwaite <= 1
    assert lrt == pytest.approx(numerics.chi2_sf(ratio, len(groups) - 1), rel=1e-4)


def test_genes_of_a_batch_do_not_meet():
    """Genes of different subjects, groups and sizes give in one batch what each gives alone."""
    frames = [observations(i, "ABC"[: 2 + i % 2], 6 + i, 4 + i % 3, slope=0.05 * i) for i in range(8)]
    frames += [observations(20, spread=0.0), observations(21, "ABC", spread=0.0)]
    together = mixed.fit_cells([cells_of(f) for f in frames])
    for found, f in zip(together, frames, strict=True):
        alone = mixed.fit_mixed(f)
        assert found[2:] == alone[2:] and found[:2] == pytest.approx(alone[:2], rel=1e-6)


def residuals(x, y):
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum()), int(rank)


@pytest.mark.parametrize("groups", ["AB", "ABC"])
def test_singular_fits_against_least_squares(groups):
    pdf = observations(5, groups, 9, spread=0.0)
    pdf["value"] -= pdf.groupby("subject")["value"].transform("mean") - pdf.groupby("group")["value"].transform("mean")
    full, null = designs(pdf)
    y = pdf["value"].to_numpy()
    dummies = np.column_stack([(pdf["subject"] == s).to_numpy(float) for s in pdf["subject"].unique()])
    (rss1, k1), (rss0, k0) = (residuals(np.column_stack([x, dummies]), y) for x in (full, null))
    lrt, one, how, singular = mixed.fit_mixed(pdf)
    assert singular and how == "lm_subject" and k1 - k0 == len(groups) - 1
    assert lrt == pytest.approx(numerics.f_sf((rss0 - rss1) / (k1 - k0) / (rss1 / (len(y) - k1)), k1 - k0, len(y) - k1), rel=1e-6)
    without = np.delete(full, len(groups) + 1, axis=1)
    rss, _ = residuals(np.column_stack([without, dummies]), y)
    assert one == pytest.approx(numerics.f_sf((rss - rss1) / (rss1 / (len(y) - k1)), 1, len(y) - k1), rel=1e-6)


def test_no_degrees_of_freedom_is_a_fallback():
    pdf = pd.DataFrame({"subject": ["a", "a", "b", "b"], "group": ["A", "A", "B", "B"], "q": [1.0, 2.0, 1.0, 2.0], "value": [1.0, 2.0, 1.5, 4.0]})
    assert mixed.fit_mixed(pdf) == (None, None, "fallback", True)


def test_chi_square_tails():
    """Against the sum of squares of normals, by integration."""
    for df in (1, 2, 3, 4, 7):
        t = np.linspace(0, 200, 2_000_001)[1:]
        density = t ** (df / 2 - 1) * np.exp(-t / 2) / (2 ** (df / 2) * math.gamma(df / 2))
        for x in (2.0, 5.0, 11.0):
            assert numerics.chi2_sf(x, df) == pytest.approx(np.trapezoid(density[t >= x], t[t >= x]), abs=1e-4)


@pytest.fixture(scope="module")
def table(spark):
    frames = [observations(i, "AB", 12, 6, slope=0.1 * i).assign(number=i) for i in range(3)]
    rows = pd.concat(frames).assign(sample=lambda f: f["subject"])
    return spark.createDataFrame(rows).repartition(3)


@pytest.mark.parametrize("method", ["linear", "lmm", "gam", "fpca"])
@pytest.mark.parametrize("kind", ["long", "double", "date"])
def test_genes_of_any_type(table, method, kind):
    gene = {"long": F.col("number"), "double": F.col("number") / 2, "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("number").cast("int"))}[kind]
    found = interaction.calculate_interaction(table.withColumn("gene", gene.cast(kind)), method)
    assert found.schema["gene"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind) and found.count() == 3


def test_three_groups_through_spark(spark):
    pdf = observations(3, "ABC", 12)
    rows = spark.createDataFrame(pdf.assign(gene=1, sample=pdf["subject"])).repartition(3)
    lrt, satterthwaite, how, _ = mixed.fit_mixed(pdf)
    odd = rows.union(rows.limit(2).withColumns({"group": F.lit(None).cast("string")})).union(rows.limit(1).withColumn("subject", F.lit(None).cast("string")))
    for frame in (rows, odd):
        found = {p: mixed.mixed_interaction(frame, pvalue=p).first() for p in ("satterthwaite", "lrt", "both")}
        assert found["lrt"]["p_interaction"] == pytest.approx(lrt, rel=1e-6) and found["lrt"]["p_satterthwaite"] is None
        assert found["both"]["p_interaction"] == found["satterthwaite"]["p_interaction"] == pytest.approx(satterthwaite, rel=1e-6)
        assert found["both"]["p_lrt"] == pytest.approx(lrt, rel=1e-6) and found["both"]["fit_method"] == how
    with pytest.raises(ValueError):
        mixed.mixed_interaction(rows, pvalue="other")


def test_a_given_grid_is_kept_to(spark):
    pdf = observations(9, "AB", 12)
    full, null = designs(pdf)
    y, subject = pdf["value"].to_numpy(), pdf["subject"].to_numpy()
    same = (subject[:, None] == subject[None, :]).astype(float)
    grid = (0.5, 1.0, 3.0)
    ratio = 2 * (max(explicit(full, y, same, t) for t in grid) - max(explicit(null, y, same, t) for t in grid))
    found = mixed.mixed_interaction(spark.createDataFrame(pdf.assign(gene="g")), pvalue="lrt", thetas=grid).first()
    assert found["p_lrt"] == pytest.approx(numerics.chi2_sf(ratio, 1), rel=1e-8)
