import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.operators import hommel, padjust

KINDS = {
    "even": lambda rng: rng.random(300),
    "ties": lambda rng: np.round(rng.random(300), 2),
    "convex": lambda rng: np.sort(rng.random(200)) ** 4,
    "concave": lambda rng: np.sort(rng.random(200)) ** 0.2,
    "zeros and ones": lambda rng: np.concatenate([np.zeros(20), rng.random(30) * 1e-6, np.ones(40), rng.random(60)]),
    "equal": lambda rng: np.full(50, 0.03),
    "one": lambda rng: np.array([0.2]),
}


@pytest.fixture(scope="module", params=KINDS)
def p(request):
    return KINDS[request.param](np.random.default_rng(len(request.param)))


def points_of(spark, p):
    distinct, counts = np.unique(p, return_counts=True)
    return spark.createDataFrame([(int(r), float(x)) for r, x in zip(np.cumsum(counts), distinct)], "rank long, p double").repartition(4)


def test_slopes_against_all_points(p):
    distinct, counts = np.unique(p, return_counts=True)
    ranks, n = np.cumsum(counts), len(p)
    for first, last in {(0, n - 1), (n // 3, n // 2), (n - 1, n - 1)}:
        plain = [min(x / (r - a) for r, x in zip(ranks, distinct) if r > a) for a in range(first, last + 1)]
        assert hommel.tangents(ranks, distinct, first, last) == pytest.approx(plain, rel=1e-12)


@pytest.mark.parametrize("most,split", [(1000, 4), (7, 3)])
def test_many_stretches_against_one_task(spark, p, most, split):
    points, n = points_of(spark, p), len(p)
    found = hommel.stretches(points, n, most, split)
    assert [a for first, last, _, _ in found for a in range(first, last + 1)] == list(range(n))
    assert all(max(s[1] - s[0], s[3] - s[2]) < most for s in found) and all(x[3] <= y[2] or x[2:] == y[2:] for x, y in zip(found, found[1:]))
    got = {r["p"]: r["adjusted"] for r in hommel.adjusted(points, n, most, split).collect()}
    expected = dict(zip(p, padjust.hommel(p), strict=True))
    assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-15) for k, v in expected.items()}


def test_it_is_the_closure_of_simes_tests(spark):
    p = np.random.default_rng(2).random(9) ** 2
    simes = lambda s: min(len(s) * x / (k + 1) for k, x in enumerate(sorted(s)))
    want = {p[i]: min(1, max(simes([p[j] for j in c]) for k in range(1, 10) for c in itertools.combinations(range(9), k) if i in c)) for i in range(9)}
    assert {r["p"]: r["adjusted"] for r in hommel.adjusted(points_of(spark, p), 9, 3, 2).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_a_family_above_the_bound_is_dealt_over_tasks(spark, monkeypatch):
    p = np.round(np.random.default_rng(3).random(250) ** 3, 3)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(-1, None)], "gene long, raw_p_values double").repartition(3)
    monkeypatch.setattr(padjust, "FEW", 100)
    got = {r["gene"]: r["adjusted_p_values"] for r in padjust.adjust(rows, "hommel").collect()}
    assert got[-1] is None and [got[i] for i in range(250)] == pytest.approx(list(padjust.hommel(p)), rel=1e-9)
    none = rows.withColumn("raw_p_values", F.lit(None).cast("double"))
    assert padjust.adjust(none, "hommel").where("adjusted_p_values is not null").count() == 0
