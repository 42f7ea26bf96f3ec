import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.operators import difference, permute, signflip


def data(spark, genes, pairs, seed=1, zeros=0.2):
    rng = np.random.default_rng(seed)
    groups = [g for _ in range(pairs) for g in rng.permutation(["A", "B"]).tolist()]
    samples = spark.createDataFrame([(f"s{i}", g, 3 * i) for i, g in enumerate(groups)], "sample string, group string, ord int")
    rows = []
    for g in range(genes):
        for i, group in enumerate(groups):
            v = None if rng.random() < 0.1 else 0.0 if rng.random() < zeros else float(rng.gamma(2) + (g % 3) * (group == "B"))
            rows.append((g, f"s{i}", group, v))
    rows += [(genes, f"s{i}", g, None) for i, g in enumerate(groups)] + [(genes + 1, f"s{i}", g, 0.0) for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, "gene long, sample string, group string, value double").repartition(3), samples


def p_of(found):
    return {r["gene"]: r["raw_p_values"] for r in found.collect()}


@pytest.mark.parametrize("method", ["mean", "median"])
@pytest.mark.parametrize("pairs,zeros", [(3, 0.4), (8, 0.2), (8, 0.0)])
def test_all_patterns_against_labels_that_are_written_out(spark, method, pairs, zeros):
    values, samples = data(spark, 9, pairs, pairs, zeros)
    if not zeros:
        values = values.where("gene < 9")
    expected = p_of(permute.permutation_p(values, permute.paired_labels(samples, 0, "signflip"), "B", "A", method))
    assert p_of(signflip.signflip_p(values, samples, "B", "A", method, bits=5)) == pytest.approx(expected, rel=1e-12)


def test_means_by_enumeration(spark):
    """Every pattern by a plain loop, with its pseudocount."""
    values, samples = data(spark, 4, 5, 7, 0.5)
    order = {r["sample"]: (i, r["group"]) for i, r in enumerate(samples.orderBy("ord").collect())}
    table = {}
    for r in values.collect():
        table.setdefault(r["gene"], [None] * 10)[order[r["sample"]][0]] = r["value"]
    groups = [g for _, g in sorted(order.values())]

    def fold_changes(labels):
        means = {g: [np.mean(c) if (c := [v for v, x in zip(vs, labels) if x == side and v is not None]) else None for side in "BA"] for g, vs in table.items()}
        low = min((m for pair in means.values() for m in pair if m), default=2e-6) / 2
        lifted = {g: [low if m == 0 else m for m in pair] for g, pair in means.items()}
        return {g: None if None in pair else abs(math.log2(pair[0] / pair[1])) for g, pair in lifted.items()}

    seen, nulls = fold_changes(groups), []
    for bits in itertools.product((0, 1), repeat=5):
        nulls.append(fold_changes([groups[i ^ bits[i // 2]] for i in range(10)]))
    expected = {}
    for g in table:
        known = [n[g] for n in nulls if n[g] is not None]
        expected[g] = (sum(n >= seen[g] * (1 - 1e-9) for n in known) + 1) / (len(known) + 1) if known and seen[g] is not None else 1.0
    assert p_of(signflip.signflip_p(values, samples, "B", "A")) == pytest.approx(expected)


def test_twenty_pairs(spark):
    """A million patterns; only as large as the observed difference are the patterns that swap no pair, or all."""
    rows = [("g", f"s{i}", "AB"[i % 2], 1.0 + (i % 2) + i / 1000) for i in range(40)]
    values = spark.createDataFrame(rows, "gene string, sample string, group string, value double")
    samples = spark.createDataFrame([(f"s{i}", "AB"[i % 2], i) for i in range(40)], "sample string, group string, ord int")
    assert p_of(signflip.signflip_p(values, samples, "B", "A"))["g"] == pytest.approx(2 / (2**20 + 1), rel=0.6)
    found = difference.test_differential(values.drop("group"), samples, "A", "shuffle", paired=True, randomizations=0, paired_method="signflip")
    assert found.first()["raw_p_values"] == p_of(signflip.signflip_p(values, samples, "B", "A"))["g"]


def test_bounds(spark):
    values, samples = data(spark, 2, 3)
    with pytest.raises(ValueError):
        signflip.signflip_p(values, samples.where("ord > 0"), "B", "A")
    many = spark.range(2 * signflip.MOST_PAIRS + 2).select(F.concat(F.lit("s"), "id").alias("sample"), F.lit("A").alias("group"), F.col("id").alias("ord"))
    with pytest.raises(ValueError):
        signflip.signflip_p(values, many, "B", "A")
