import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.operators import difference, padjust, profiles, ranktests


def plain_ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_sums_against_counting(spark):
    """Ties within and between groups, missing values, other groups, one group alone."""
    rng = np.random.default_rng(1)
    genes = {g: [(rng.choice(["A", "B", "B", "C"]), float(np.round(rng.random(), 1))) for _ in range(rng.integers(1, 40))] for g in range(40)}
    genes |= {40: [("A", 1.0)] * 5, 41: [("C", 1.0)] * 3, 42: [("A", 2.0), ("B", 2.0)]}
    rows = [(g, group, v) for g, cells in genes.items() for group, v in cells] + [(0, "A", None), (1, "B", float("nan")), (43, "A", None)]
    df = spark.createDataFrame(rows, "gene long, group string, value double").repartition(4)
    found = {r["gene"]: r for r in ranktests.rank_sum_statistics(df, "A", "B").collect()}
    assert set(found) == {g for g, cells in genes.items() if any(c[0] in "AB" for c in cells)}
    for g, r in found.items():
        cells = [c for c in genes[g] if c[0] in "AB"]
        v, one = np.array([c[1] for c in cells]), np.array([c[0] == "A" for c in cells])
        n1, n = int(one.sum()), len(v)
        ties = sum(t**3 - t for t in np.unique(v, return_counts=True)[1])
        u = plain_ranks(v)[one].sum() - n1 * (n1 + 1) / 2
        assert (r["n1"], r["n2"], r["u"], r["tie_sum"]) == (n1, n - n1, u, ties)
        variance = n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1))) if n > 1 else 0
        if variance > 1e-12:
            centred = u - n1 * (n - n1) / 2
            assert r["z"] == pytest.approx((centred - 0.5 * np.sign(centred)) / math.sqrt(variance))
        else:
            assert r["z"] is None
    p = {r["gene"]: r["raw_p_values"] for r in ranktests.wilcoxon(df, "A", "B").collect()}
    assert set(p) == set(range(44)) and p[41] == p[43] == p[42] == 1


def test_summaries_of_arrays(spark):
    rows = [("a", g, v) for g, v in (("A", 3.0), ("A", 1.0), ("A", 2.0), ("A", 10.0), ("B", 5.0), ("B", None))]
    cells = profiles.profiles(spark.createDataFrame(rows, "gene string, group string, value double"), "A", "B")
    of = lambda one, method: profiles.summary_of(profiles.values_of(F.col("cells"), one), method)
    assert tuple(cells.select(of(True, "mean"), of(True, "median"), of(False, "mean"), of(False, "median")).first()) == (4.0, 2.5, 5.0, 5.0)


def plain_two_sided(counts, at):
    return min(1, 2 * min(sum(counts[: at + 1]), sum(counts[at:])) / sum(counts))


@pytest.mark.parametrize("n1,n2", [(1, 1), (2, 5), (4, 4), (1, 30)])
def test_exact_rank_sums_by_enumeration(n1, n2):
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    counts = [us.count(u) for u in range(n1 * n2 + 1)]
    few, many = sorted((n1, n2))
    for u in range(n1 * n2 + 1):
        assert ranktests.two_sided(ranktests.rank_sum_weights(few, many), u) == pytest.approx(plain_two_sided(counts, u), rel=1e-12)


def test_exact_tests_of_many_values_neither_overflow_nor_vanish(spark):
    """Beside the normal form, to which they tend: groups whose counts no double holds, lopsided ones, 2,000 pairs."""
    big = ranktests.rank_sum_weights(140, 140)
    assert np.isfinite(big).all() and big.sum() > 0 and ranktests.rank_sum_weights(3, 3000).sum() > 1e-3
    rng = np.random.default_rng(2)
    rows = [("close", "AB"[i % 2], float(x)) for i, x in enumerate(rng.permutation(280))]
    rows += [("apart", "AB"[i % 2], float(x + 12 * (i % 2))) for i, x in enumerate(rng.permutation(240) * 1.001)]
    rows += [("many", "AB"[i % 2], float(x + 40 * (i % 2))) for i, x in enumerate(rng.permutation(2000) * 1.001)]
    df = spark.createDataFrame(rows, "gene string, group string, value double")
    exact, normal = ({r["gene"]: r["raw_p_values"] for r in ranktests.wilcoxon(df, "A", "B", exact=e).collect()} for e in (True, False))
    assert exact["close"] == pytest.approx(normal["close"], abs=2e-3) and exact["apart"] == pytest.approx(normal["apart"], abs=2e-3)
    assert exact["many"] == normal["many"]
    weights = ranktests.signed_rank_weights(2000)
    assert weights.nbytes < 20_000_000 and weights.sum() == pytest.approx(1)
    n, v = 2000, 1_030_000
    z = (v - n * (n + 1) / 4 - 0.5) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert ranktests.two_sided(weights, v) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


@pytest.mark.parametrize("method", ["BH", "BY", "holm", "hochberg"])
def test_corrections_by_ranges_and_by_one_window_agree(spark, monkeypatch, method):
    p = np.round(np.random.default_rng(3).random(300) ** 2, 3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(-1, None)], "gene long, raw_p_values double").repartition(4)
    few = {r["gene"]: r["adjusted_p_values"] for r in padjust.adjust(df, method).collect()}
    monkeypatch.setattr(padjust, "FEW", 0)
    many = {r["gene"]: r["adjusted_p_values"] for r in padjust.adjust(df, method).collect()}
    assert few.pop(-1) is many.pop(-1) is None and few == pytest.approx(many, rel=1e-12)


@pytest.mark.parametrize("method,exact", [("mean", False), ("median", True)])
def test_difference_tables_against_their_parts(spark, monkeypatch, method, exact):
    """Tested genes and genes with too few values, whose pseudocounts are their own."""
    rng = np.random.default_rng(4)
    rows = [(g, f"s{s}", None if g % 4 == 3 and s % 3 else float(max(0.0, rng.normal(1, 1)))) for g in range(20) for s in range(12)]
    samples = spark.createDataFrame([(f"s{s}", "HP"[s % 2], s) for s in range(12)], "sample string, group string, ord int")
    values = spark.createDataFrame(rows, "gene long, sample string, value double").repartition(3)
    tables = [{r["genes"]: tuple(r) for r in difference.calculate_difference(values, samples, "H", method, exact=exact).collect()}]
    monkeypatch.setattr(difference, "MANY_SAMPLES", 0)
    tables.append({r["genes"]: tuple(r) for r in difference.calculate_difference(values, samples, "H", method, exact=exact).collect()})
    assert tables[0] == tables[1] and len(tables[0]) == 20
    summary = np.mean if method == "mean" else np.median
    whole = {g: {h: [v for gg, s, v in rows if gg == g and v is not None and int(s[1:]) % 2 == i] for i, h in enumerate("HP")} for g in range(20)}
    for part in (1, 2):
        genes = [g for g in whole if (g % 4 == 3) == (part == 2)]
        plain = {g: [summary(whole[g][h]) if whole[g][h] else None for h in "PH"] for g in genes}
        positive = [x for pair in plain.values() for x in pair if x is not None and x > 0]
        for g in genes:
            case, control = (min(positive) / 2 if x is not None and x <= 0 else x for x in plain[g])
            assert tables[0][g][1:3] == pytest.approx((case, control)) and tables[0][g][-1] == part
            assert tables[0][g][4] == pytest.approx(math.log2(case / control)) and (tables[0][g][5] is None) == (part == 2)
