import numpy as np
import pandas as pd
import pytest

from varietas.functions import numerics
from varietas.operators import additive


def observations(seed, groups="AB", samples=5, orders=12, bend=0.3, noise=0.2, gaps=0):
    rng = np.random.default_rng(seed)
    rows = [(g, float(q), float(np.sin(2 * q) + bend * groups.index(g) * q * q + rng.normal(0, noise))) for g in groups for _ in range(samples) for q in np.linspace(0.1, 2, orders)]
    pdf = pd.DataFrame(rows, columns=["group", "q", "value"])
    return pdf.drop(index=rng.choice(len(pdf), gaps, replace=False))


def plain_design(pdf):
    """Observation by observation: (X, penalties) of the two models."""
    q, orders = pdf["q"].to_numpy(), pdf["q"].nunique()
    basis, penalty = additive.spline_basis(q, max(3, min(10, orders - 1)))
    basis = basis - basis.mean(axis=0)
    on = [(pdf["group"] == g).to_numpy(float) for g in sorted(pdf["group"].unique())]
    k, g = basis.shape[1], len(on)

    def padded(before, after):
        return np.pad(penalty, ((before, after), (before, after)))

    one = np.column_stack([*on, basis]), [padded(g, 0)]
    each = np.column_stack([*on, *(basis * o[:, None] for o in on)]), [padded(g + i * k, (g - 1 - i) * k) for i in range(g)]
    return one, each


def plain_score(x, penalties, y, powers):
    """(cross-validation, residual sum of squares, degrees of freedom) by normal equations."""
    s = sum(10.0**p * m for p, m in zip(powers, penalties))
    inverse = np.linalg.pinv(x.T @ x + s, rcond=1e-13, hermitian=True)
    edf, rss = np.trace(inverse @ x.T @ x), ((y - x @ inverse @ x.T @ y) ** 2).sum()
    return len(y) * rss / (len(y) - edf) ** 2, rss, edf


def dense(x, penalties, y):
    """The least cross-validation on a grid of powers in all weights, looked at ever closer around the best point."""
    low, high = np.full(len(penalties), -8.0), np.full(len(penalties), 8.0)
    best = None
    for _ in range(9):
        axes = [np.linspace(a, b, 17) for a, b in zip(low, high)]
        for at in np.array(np.meshgrid(*axes)).reshape(len(axes), -1).T:
            score = plain_score(x, penalties, y, at)
            if best is None or score[0] < best[0][0]:
                best = score, at
        width = (high - low) / 8
        low, high = np.maximum(best[1] - width, -8), np.minimum(best[1] + width, 8)
    return best[0]


@pytest.mark.parametrize("seed,bend,gaps", [(1, 0.3, 0), (2, 0.0, 7), (3, 0.05, 20)])
def test_fits_against_a_dense_grid_of_weights(seed, bend, gaps):
    pdf = observations(seed, bend=bend, gaps=gaps)
    y = pdf["value"].to_numpy()
    cells = pdf.groupby(["group", "q"], as_index=False).agg(n=("value", "size"), y=("value", "sum"))
    blocks = additive.models(np.unique(cells["group"], return_inverse=True)[1], cells["q"].to_numpy(), cells["n"].to_numpy(float), cells["y"].to_numpy()[None])
    for design, own in zip(plain_design(pdf), blocks, strict=True):
        rss, edf = (v[0] for v in additive.fitted(own, np.array([y @ y]), float(len(y))))
        score, plain_rss, plain_edf = dense(*design, y)
        found = additive.cross_validation(len(y), rss, edf)
        assert found == pytest.approx(score, rel=1e-6) and found <= score * (1 + 1e-9)
        assert (rss, edf) == (pytest.approx(plain_rss, rel=2e-3), pytest.approx(plain_edf, rel=2e-3))


def test_p_values_are_those_of_the_residuals():
    pdf = observations(4, "ABC", gaps=11)
    y = pdf["value"].to_numpy()
    cells = pdf.groupby(["group", "q"], as_index=False).agg(n=("value", "size"), y=("value", "sum"))
    blocks = additive.models(np.unique(cells["group"], return_inverse=True)[1], cells["q"].to_numpy(), cells["n"].to_numpy(float), cells["y"].to_numpy()[None])
    (rss0, edf0), (rss1, edf1) = (additive.fitted(b, np.array([y @ y]), float(len(y))) for b in blocks)
    f = (rss0 - rss1) / (edf1 - edf0) / (rss1 / (len(y) - edf1))
    assert additive.fit_additive(pdf) == pytest.approx(numerics.f_sf(f[0], edf1[0] - edf0[0], len(y) - edf1[0]))


def test_splines_pass_through_their_knots_and_bend_as_the_penalty_says():
    q = np.linspace(0, 3, 3001)
    knots = np.quantile(q, np.linspace(0, 1, 6))
    values = np.array([1.0, -1.0, 0.5, 2.0, 0.0, 1.0])
    x, penalty = additive.spline_basis(q, 6)
    curve = x @ values
    assert curve[np.searchsorted(q, knots - 1e-9)] == pytest.approx(values, abs=1e-6)
    second = np.diff(curve, 2) / (q[1] - q[0]) ** 2
    assert values @ penalty @ values == pytest.approx((second**2).sum() * (q[1] - q[0]), rel=1e-2)
    assert np.abs(penalty @ np.ones(6)).max() < 1e-9 and np.abs(penalty @ knots).max() < 1e-9


def test_genes_through_spark(spark):
    """Genes observed alike and unlike, in one batch: each has the p-value that it has alone."""
    frames = {i: observations(i, "ABC"[: 2 + i % 2], orders=6 + i % 3, bend=0.1 * i, gaps=(i == 4) * 9) for i in range(7)}
    frames[7] = frames[0].assign(value=lambda f: f["value"] + 1)
    frames[8] = observations(8, orders=2, samples=8)
    rows = spark.createDataFrame(pd.concat([f.assign(gene=i) for i, f in frames.items()])).repartition(5)
    found = {r["gene"]: r["p_interaction"] for r in additive.additive_interaction(rows).collect()}
    assert found == {i: pytest.approx(additive.fit_additive(f), rel=1e-6, abs=1e-12) for i, f in frames.items() if i != 8}
