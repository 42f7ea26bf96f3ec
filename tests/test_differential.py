import itertools
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varietas.functions import numerics
from varietas.operators import difference, foldchange, interaction, metadata, padjust, permute, plotdata, ranktests


def values(spark, genes, groups):
    rows = [(g, f"S{i + 1}", groups[i], None if v is None else float(v)) for g, vs in genes.items() for i, v in enumerate(vs)]
    samples = [(f"S{i + 1}", g, i) for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, "gene string, sample string, group string, value double"), spark.createDataFrame(samples, "sample string, group string, ord int")


EIGHT = ["H"] * 4 + ["P"] * 4


def test_fold_change_golden_values(spark):
    df, samples = values(spark, {"g": [0.1 * i for i in range(1, 9)]}, EIGHT)
    case, control = foldchange.check_groups(samples, "H")
    r = foldchange.fold_change(df, case, control).first()
    assert (r["case"], r["control"], r["difference"], r["log2_fold_change"]) == pytest.approx((0.65, 0.25, 0.4, 1.378512), abs=1e-6)
    back = foldchange.fold_change(df, "H", "P").first()
    assert back["log2_fold_change"] == pytest.approx(-1.378512, abs=1e-6)


def test_pseudocount_is_global_unless_given(spark):
    df, _ = values(spark, {"a": [0, 0, 4, 4], "b": [2, 2, 4, 4]}, ["A", "A", "B", "B"])
    auto = {r["gene"]: r["log2_fold_change"] for r in foldchange.fold_change(df, "B", "A").collect()}
    assert auto == {"a": pytest.approx(2), "b": pytest.approx(1)}
    given = {r["gene"]: r["log2_fold_change"] for r in foldchange.fold_change(df, "B", "A", pseudocount=1e-6).collect()}
    assert given["a"] > 10 and given["b"] == pytest.approx(1)
    zero, _ = values(spark, {"a": [0, 0, 0, 0]}, ["A", "A", "B", "B"])
    assert foldchange.fold_change(zero, "B", "A").first()["case"] == 1e-6


@pytest.mark.parametrize("control", [None, "", "X"])
def test_groups_are_checked(spark, control):
    _, samples = values(spark, {"g": [1, 2]}, ["A", "B"])
    with pytest.raises(ValueError):
        foldchange.check_groups(samples, control)
    _, three = values(spark, {"g": [1, 2, 3]}, ["A", "B", "C"])
    with pytest.raises(ValueError):
        foldchange.check_groups(three, "A")


def test_rank_sum_vectors(spark):
    df, _ = values(spark, {"a": [0.1 * i for i in range(1, 9)], "b": [1, 1, 2, 3, 2, 2, 4, 5], "c": [5] * 8, "d": [None] * 8}, EIGHT)
    stats = {r["gene"]: r for r in ranktests.rank_sum_statistics(df, "H", "P").collect()}
    assert stats["a"]["u"] == 0 and stats["b"]["u"] == 3 and stats["c"]["u"] == 8 and stats["c"]["z"] is None
    p = {r["gene"]: r["raw_p_values"] for r in ranktests.wilcoxon(df, "H", "P").collect()}
    assert p["a"] == pytest.approx(0.03038282, abs=1e-8) and p["c"] == 1 and p["d"] == 1
    exact = {r["gene"]: r["raw_p_values"] for r in ranktests.wilcoxon(df, "H", "P", exact=True).collect()}
    assert exact["a"] == pytest.approx(2 / 70) and exact["b"] == 1


def test_exact_counts_by_enumeration():
    n1, n2 = 3, 4
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    assert list(ranktests.rank_sum_counts(n1, n2)) == [us.count(u) for u in range(n1 * n2 + 1)]
    vs = [sum(r for r, on in zip(range(1, 6), bits) if on) for bits in itertools.product((0, 1), repeat=5)]
    assert list(ranktests.signed_rank_counts(5)) == [vs.count(v) for v in range(16)]


def test_paired_exact(spark):
    rows = [(g, f"s{i}", "NT"[i % 2], i // 2, float(v)) for g, vs in {"a": (1, 2, 3, 6), "b": (5, 6, 7, 9)}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "gene string, sample string, group string, pair int, value double")
    found = ranktests.wilcoxon(df, "N", "T", paired=True, exact=True)
    assert {r["raw_p_values"] for r in found.collect()} == {0.5}
    assert {r["adjusted_p_values"] for r in padjust.adjust(found).collect()} == {0.5}
    with pytest.raises(ValueError):
        ranktests.wilcoxon(df.where("sample <> 's0'"), "N", "T", paired=True)


def reference_adjust(p, method):
    n, order = len(p), np.argsort(p)
    s = np.asarray(p)[order]
    i = np.arange(1, n + 1)
    if method == "bonferroni":
        a = n * s
    elif method == "holm":
        a = np.maximum.accumulate((n - i + 1) * s)
    else:
        w = {"BH": n / i, "BY": n / i * (1 / i).sum(), "hochberg": n - i + 1}[method]
        a = np.minimum.accumulate((w * s)[::-1])[::-1]
    out = np.empty(n)
    out[order] = np.minimum(a, 1)
    return out


@pytest.mark.parametrize("method", ["BH", "BY", "holm", "hochberg", "bonferroni"])
def test_adjustments(spark, method):
    p = [0.01, 0.04, 0.03, 0.5, 0.03, 0.9, 0.0002]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(p)] + [("n", None)], "gene string, raw_p_values double")
    got = {r["gene"]: r["adjusted_p_values"] for r in padjust.adjust(df, method).collect()}
    assert got["n"] is None and [got[str(i)] for i in range(len(p))] == pytest.approx(list(reference_adjust(p, method)))


def test_hommel_is_simes_closure(spark):
    p = np.array([0.01, 0.04, 0.03, 0.5, 0.02])
    simes = lambda s: min(len(s) * x / (k + 1) for k, x in enumerate(sorted(s)))
    want = [max(simes([p[j] for j in c]) for k in range(1, 6) for c in itertools.combinations(range(5), k) if i in c) for i in range(5)]
    assert list(padjust.hommel(p)) == pytest.approx(np.minimum(want, 1))
    df = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(p)] + [("n", None)], "gene string, raw_p_values double")
    got = {r["gene"]: r["adjusted_p_values"] for r in padjust.adjust(df, "hommel").collect()}
    assert got["n"] is None and [got[str(i)] for i in range(5)] == pytest.approx(np.minimum(want, 1))
    with pytest.raises(ValueError):
        padjust.adjust(df, "nope")


def test_signflip_enumerates(spark):
    df, samples = values(spark, {"g": [1, 2, 3, 4], "c": [2, 2, 2, 2]}, ["A", "B", "A", "B"])
    for b in (0, 4, 6):
        assert permute.paired_labels(samples, b, "signflip").select("perm").distinct().count() == 4
    p = {r["gene"]: r["raw_p_values"] for r in permute.permutation_p(df, permute.paired_labels(samples, 0, "signflip"), "B", "A").collect()}
    assert p == {"g": pytest.approx(0.6), "c": 1.0}
    none = permute.permutation_p(df, permute.paired_labels(samples, 0, "swap"), "B", "A")
    assert {r["raw_p_values"] for r in none.collect()} == {1.0}
    with pytest.raises(ValueError):
        permute.paired_labels(samples.limit(3), 4)


def test_shuffles_follow_the_seed(spark):
    _, samples = values(spark, {"g": [1] * 8}, EIGHT)
    rows = lambda seed: sorted(map(tuple, permute.shuffled_labels(samples, 5, seed).collect()))
    assert rows(1) == rows(1) != rows(2)
    per = permute.shuffled_labels(samples, 5).groupBy("perm", "group").count().collect()
    assert {r["count"] for r in per} == {4}


def test_difference_table(spark):
    genes = {"a": [0.1 * i for i in range(1, 9)], "few": [None] * 5 + [0.2, 0.3, 0.4]}
    df, samples = values(spark, genes, EIGHT)
    got = {r["genes"]: r for r in difference.calculate_difference(df.drop("group"), samples, "H").collect()}
    assert list(got["a"].asDict()) == ["genes", "P_mean", "H_mean", "mean_difference", "log2_fold_change", "raw_p_values", "adjusted_p_values", "part"]
    assert got["a"]["adjusted_p_values"] == pytest.approx(0.03038282, abs=1e-8) and got["few"]["part"] == 2 and got["few"]["raw_p_values"] is None
    with pytest.warns(UserWarning):
        difference.calculate_difference(df.drop("group"), samples, "H", test="shuffle", randomizations=3)
    for bad in ({"method": "x"}, {"test": "x"}, {"pcorr": "x"}):
        with pytest.raises(ValueError):
            difference.calculate_difference(df.drop("group"), samples, "H", **bad)


def test_tails(spark):
    z = [0.0, 0.5, 2.16506351, 3.4, 3.6, 5.0, 8.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(numerics.normal_two_sided(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z], rel=1e-8)
    pairs = [(0.696347132441, 16), (2.0, 1), (2.0, 2), (2.5, 3), (1.1, 7), (0.0, 5), (12.0, 10)]
    got = spark.createDataFrame(pairs, "t double, df int").select(numerics.t_two_sided(F.col("t"), F.col("df"))).collect()
    assert [r[0] for r in got] == pytest.approx([numerics.t_sf2(*p) for p in pairs], abs=1e-10)
    assert got[0][0] == pytest.approx(0.496203841599, abs=1e-10)
    assert numerics.f_sf(4.0, 1, 7) == pytest.approx(numerics.t_sf2(2.0, 7)) and numerics.chi2_1_sf(3.841458820694124) == pytest.approx(0.05)


def curves(spark, s, noise=True):
    q = [i / 100 for i in range(1, 11)]
    e = [(-1) ** i * 1e-3 for i in range(10)]
    rows = [("g", "a", "A", x, x + y) for x, y in zip(q, e)] + [("g", "b", "B", x, s * x + 0.7 * e[i - 1]) for i, x in enumerate(q)]
    return spark.createDataFrame(rows, "gene string, sample string, group string, q double, value double")


def test_linear_interaction(spark):
    r = interaction.linear_interaction(curves(spark, 1)).first()
    assert (abs(r["t"]), r["df"], r["p_interaction"]) == (pytest.approx(0.696347132441), 16, pytest.approx(0.496203841599))
    assert abs(interaction.linear_interaction(curves(spark, 2)).first()["t"]) == pytest.approx(68.282980575)
    assert interaction.linear_interaction(curves(spark, 1), min_obs=21).count() == 0


def many(spark, slope, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(12):
        shift = rng.normal(0, 0.3)
        for q in np.linspace(0.1, 2, 12):
            rows.append(("g", f"s{s}", "AB"[s % 2], float(q), float(0.5 * q + shift + (s % 2) * slope * q * q + rng.normal(0, 0.05))))
    return spark.createDataFrame(rows, "gene string, sample string, group string, q double, value double")


@pytest.mark.parametrize("method", ["linear", "lmm", "gam", "fpca"])
def test_interaction_methods_tell_curves_apart(spark, method):
    same = interaction.calculate_interaction(many(spark, 0.0), method).first()
    other = interaction.calculate_interaction(many(spark, 0.5), method).first()
    assert same["p_interaction"] > 0.01 and other["p_interaction"] < (0.2 if method == "fpca" else 1e-3)
    assert other["adj_p_interaction"] == other["p_interaction"]


def test_mixed_fit_against_a_grid():
    rng = np.random.default_rng(0)
    subject = np.repeat(np.arange(8), 6)
    x = np.column_stack([np.ones(48), rng.normal(size=48)])
    y = x @ [1, 2] + rng.normal(size=8)[subject] + rng.normal(0, 0.5, 48)
    fit = interaction.RandomIntercept(x, y, subject)

    def loglik(theta):
        v = np.eye(48) + theta**2 * (subject[:, None] == subject[None, :])
        w = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
        r = y - x @ beta
        s2 = r @ w @ r / 48
        return -0.5 * (48 * math.log(2 * math.pi * s2) + 48 + np.linalg.slogdet(v)[1])

    assert fit.loglik == pytest.approx(loglik(fit.theta))
    assert fit.loglik >= max(loglik(t) for t in np.linspace(0, 10, 400)) - 1e-6


def test_singular_mixed_fits_fall_back(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"gene": "g", "q": np.tile([0.5, 1.0, 1.5, 2.0], 6), "subject": np.repeat(list("abcdef"), 4), "group": np.repeat(["A", "B"], 12)})
    e = rng.normal(0, 0.1, 24)
    e -= np.repeat(e.reshape(6, 4).mean(axis=1), 4)
    lrt, satt, how, singular = interaction.fit_mixed(pdf.assign(value=e + pdf["q"]))
    assert singular and how == "lm_subject" and lrt == satt and 0 < lrt <= 1


def test_map_metadata(spark):
    cols = spark.createDataFrame([(s, q, 0) for s in ("A_N", "A_T", "B_N", "B_T") for q in (1.0, 2.0)], "sample string, q double, ord int")
    data = spark.createDataFrame([("B_N", "Normal", 1), ("A_N", "Normal", 2), ("A_T", "Tumor", 3), ("B_T", "Tumor", 4), ("C_T", "Tumor", 5)], "Sample string, Condition string, ord int")
    plain = [r["sample"] for r in metadata.map_metadata(cols, data).orderBy("col_ord").collect()]
    assert plain == ["B_N", "B_N", "A_N", "A_N", "A_T", "A_T", "B_T", "B_T"]
    with pytest.raises(ValueError, match="C"):
        metadata.map_metadata(cols, data, paired=True)
    paired = [r["sample"] for r in metadata.map_metadata(cols, data.where("Sample <> 'C_T'"), paired=True).orderBy("col_ord").collect()]
    assert paired == ["B_N", "B_N", "B_T", "B_T", "A_N", "A_N", "A_T", "A_T"]
    with pytest.raises(ValueError, match="b_n"):
        metadata.map_metadata(spark.createDataFrame([("b_n", 1.0, 0)], "sample string, q double, ord int"), data)
    assert metadata.map_metadata(cols, None) is cols and metadata.map_metadata(cols, data, "x") is cols


def test_group_inference(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "x")], "id string, n int, batch string")
    assert metadata.infer_group_column(df) == "batch" and metadata.infer_group_column(df, "n") == "n"
    assert metadata.infer_group_column(df.drop("batch")) in ("id", "n")
    groups = spark.createDataFrame([("a", "Tumor"), ("b", "Normal")], "sample string, sample_type string")
    assert metadata.control_group(groups) == "Normal" and metadata.control_group(groups, "Tumor") == "Tumor"
    with pytest.raises(ValueError):
        metadata.with_groups(spark.createDataFrame([("z", 1.0)], "sample string, value double"), groups)


def test_plot_frames(spark):
    table = spark.createDataFrame([("a", 0.2, 1.0, 0.01), ("b", -0.3, -2.0, None), ("c", None, 0.5, 0.0)], "genes string, mean_difference double, log2_fold_change double, adjusted_p_values double")
    v = {r["genes"]: r for r in plotdata.volcano_frame(table).collect()}
    assert set(v) == {"a", "b"} and v["a"]["significant"] and not v["b"]["significant"] and v["a"]["y"] == pytest.approx(2)
    m = {r["genes"]: r for r in plotdata.ma_frame(table).collect()}
    assert m["b"]["padj"] == 1 and m["c"]["significant"] and m["a"]["x"] == 1
    with pytest.raises(ValueError):
        plotdata.ma_frame(table.drop("log2_fold_change"))
    with pytest.raises(ValueError):
        plotdata.q_curve(spark.createDataFrame([], "group string, q double, value double"))
    with pytest.raises(ValueError):
        plotdata.transcript_summary(None, None, None, "mode")
    assert '"mark": "area"' in plotdata.chart("area", "x", "density", "group")


def test_satterthwaite_against_explicit_covariances():
    """The p-value from the full covariance matrix of the observations, derivatives by differences."""
    rng = np.random.default_rng(4)
    q, subject = np.tile(np.linspace(0.2, 2, 7), 8), np.repeat(np.arange(8), 7)
    group = (subject % 2).astype(float)
    y = 0.3 * q + 0.2 * group + 0.25 * q * group + rng.normal(0, 0.4, 8)[subject] + rng.normal(0, 0.3, 56)
    x = np.column_stack([np.ones(56), q, group, q * group])
    same = (subject[:, None] == subject[None, :]).astype(float)

    def parts(v):
        covariance = np.linalg.inv(v[0] * same + v[1] * np.eye(56))
        spread = np.linalg.inv(x.T @ covariance @ x)
        beta = spread @ x.T @ covariance @ y
        left = y - x @ beta
        _, size = np.linalg.slogdet(v[0] * same + v[1] * np.eye(56))
        return beta[3], spread[3, 3], size + left @ covariance @ left

    fit = interaction.RandomIntercept(x, y, subject)
    at = np.array([fit.theta**2 * fit.sigma2, fit.sigma2])
    step = np.diag(1e-4 * at)
    gradient = np.array([(parts(at + e)[1] - parts(at - e)[1]) / (2 * e.sum()) for e in step])
    hessian = np.array([[(parts(at + d + e)[2] - parts(at + d - e)[2] - parts(at - d + e)[2] + parts(at - d - e)[2]) / (4 * d.sum() * e.sum()) for e in step] for d in step])
    beta, variance, _ = parts(at)
    df = 2 * variance**2 / (gradient @ (2 * np.linalg.inv(hessian)) @ gradient)
    assert max(abs(parts(at + e)[2] - parts(at - e)[2]) / (2 * e.sum()) for e in step) < 1e-2
    assert fit.satterthwaite(3) == pytest.approx(numerics.t_sf2(beta / np.sqrt(variance), df), rel=1e-3)


def test_curves_against_the_covariance_by_hand():
    rng = np.random.default_rng(5)
    rows = [("g", "AB"[s % 2], f"s{s:02}", q, float(np.sin(q) * (1 + 0.3 * (s % 2)) + rng.normal(0, 0.1))) for s in range(14) for q in (0.5, 1.0, 1.5, 2.0)]
    pdf = pd.DataFrame(rows, columns=["gene", "group", "sample", "q", "value"])
    curves = np.array([[r[4] for r in rows if r[2] == f"s{s:02}"] for s in range(14)])
    centred = curves - curves.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    score = centred @ vectors[:, -1]
    a, b = score[::2], score[1::2]
    va, vb = a.var(ddof=1) / 7, b.var(ddof=1) / 7
    t, df = (a.mean() - b.mean()) / np.sqrt(va + vb), (va + vb) ** 2 / (va**2 / 6 + vb**2 / 6)
    assert interaction.fit_curves(pdf, 10) == pytest.approx(numerics.t_sf2(t, df), rel=1e-8)


def test_interaction_table_is_ordered_and_checked(spark):
    rng = np.random.default_rng(6)
    rows = [(f"g{g}", f"s{s}", "AB"[s % 2], q, float(q * (1 + 0.02 * g * (s % 2)) + rng.normal(0, 0.05))) for g in range(6) for s in range(8) for q in (0.5, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "gene string, sample string, group string, q double, value double")
    found = [(r["adj_p_interaction"], r["p_interaction"]) for r in interaction.calculate_interaction(df).collect()]
    assert len(found) == 6 and found == sorted(found)
    with pytest.raises(ValueError):
        interaction.calculate_interaction(df, "lmm", paired=True)
    with pytest.raises(ValueError):
        interaction.calculate_interaction(df, "lmm", subject="nobody")
    based = df.withColumn("sample_base", F.col("sample"))
    assert interaction.calculate_interaction(based, "lmm", paired=True).count() == 6


def test_corrections_over_ranges_families_and_ties(spark):
    rng = np.random.default_rng(7)
    p = np.round(rng.random(400), 2)
    df = spark.createDataFrame([(str(i), float(x), i % 2) for i, x in enumerate(p)], "gene string, raw_p_values double, half int").repartition(5)
    for method in ("BH", "BY", "holm", "hochberg"):
        got = {r["gene"]: r["adjusted_p_values"] for r in padjust.adjust(df, method).collect()}
        assert [got[str(i)] for i in range(400)] == pytest.approx(list(reference_adjust(p, method)))
        halves = {r["gene"]: r["adjusted_p_values"] for r in padjust.adjust(df, method, within=("half",)).collect()}
        assert [halves[str(i)] for i in range(0, 400, 2)] == pytest.approx(list(reference_adjust(p[::2], method)))
    small = rng.random(9)
    simes = lambda s: min(len(s) * x / (k + 1) for k, x in enumerate(sorted(s)))
    want = [max(simes([small[j] for j in c]) for k in range(1, 10) for c in itertools.combinations(range(9), k) if i in c) for i in range(9)]
    assert list(padjust.hommel(small)) == pytest.approx(np.minimum(want, 1))


def test_too_many_patterns_are_refused(spark):
    _, samples = values(spark, {"g": [1] * 44}, ["A", "B"] * 22)
    with pytest.raises(ValueError):
        permute.paired_labels(samples, 0, "signflip")


def test_plot_frames_check_their_input(spark):
    rows = [(g, f"S{s}", "AB"[s % 2], q, 0.1 * s * q * (1 + (g == "b"))) for g in ("a", "b") for s in range(4) for q in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "gene string, sample string, group string, q double, value double")
    with pytest.raises(ValueError):
        plotdata.gene_profile(df, ["a", "nobody"])
    table = spark.createDataFrame([("b", 0.01, 0.01), ("a", 0.2, 0.2), ("c", None, None)], "gene string, p_interaction double, adj_p_interaction double")
    assert {r["gene"] for r in plotdata.gene_profile(df, table=table, n_top=1).collect()} == {"b"}
    lines = plotdata.gene_profile(df, ["a"], show_samples=True)
    assert lines.where("sample is not null").count() == 8 and lines.where("median is not null").count() == 4
    volcano = spark.createDataFrame([("a", None, 0.5)], "genes string, mean_difference double, adjusted_p_values double")
    for bad in (volcano, volcano.drop("adjusted_p_values")):
        with pytest.raises(ValueError):
            plotdata.volcano_frame(bad)
    assert plotdata.mean_density(df).select("group").distinct().count() == 2
    many = spark.createDataFrame([(g, f"S{s}", 0.1 * s) for g in "ab" for s in range(10)], "gene string, sample string, value double")
    samples = spark.createDataFrame([(f"S{s}", "HP"[s % 2], s) for s in range(10)], "sample string, group string, ord int")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        difference.calculate_difference(many, samples, "H", test="shuffle", randomizations=3)
