"""Differential tables: tests of every gene that has enough values, fold changes of all."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import gate
from .foldchange import check_groups, checked_groups, fold_change_columns, lift_summaries
from .padjust import METHODS, adjust
from .permute import MOST_LABELS, all_patterns, paired_labels, permutation_p, shuffled_labels
from .profiles import profiles, rank_sum, summary_of, values_of
from .ranktests import rank_sum_p, wilcoxon
from .settled import settled, view
from .signflip import signflip_p

TESTS = ("wilcoxon", "shuffle")
#: Most samples that are broadcast to the values.
MANY_SAMPLES = 1_000_000


def test_differential(values: DataFrame, samples: DataFrame, control: str | None = None, method: str = "wilcoxon", fc_method: str = "mean", paired: bool = False, exact: bool = False, randomizations: int = 100, pcorr: str = "BH", seed: int | None = 123, paired_method: str = "swap") -> DataFrame:
    """(gene, raw_p_values, adjusted_p_values) of (gene, sample, value); ``samples`` has (sample, group, ord).

    shuffle needs ``control``; wilcoxon takes the groups in their order. Paired tests pair the i-th
    samples of the groups (wilcoxon) or neighbouring samples (shuffle). All sign flips of many pairs are evaluated
    by ranges of patterns, without a table of labels.
    """
    if method not in TESTS:
        raise ValueError("method must be 'wilcoxon' or 'shuffle'")
    if seed is not None and (isinstance(seed, bool) or not isinstance(seed, (int, float))):
        raise ValueError("seed must be a number")
    samples = settled(samples)
    rows = values.join(samples.select("sample", "group", "ord"), "sample")
    if method == "wilcoxon":
        names = [r[0] for r in samples.select("group").distinct().orderBy("group").limit(3).collect()]
        if len(names) != 2:
            raise ValueError("exactly two groups are needed")
        if paired:
            nth = samples.select("sample", F.row_number().over(Window.partitionBy("group").orderBy("ord")).alias("pair"))
            rows = rows.join(nth, "sample")
        p = wilcoxon(rows, *names, paired=paired, exact=exact)
    else:
        case, control = check_groups(samples, control)
        n = samples.count()
        if paired and paired_method == "signflip" and all_patterns(n, randomizations) and n * 2 ** (n // 2) > MOST_LABELS:
            p = signflip_p(rows, samples, case, control, fc_method)
        else:
            labels = paired_labels(samples, randomizations, paired_method, seed) if paired else shuffled_labels(samples, randomizations, seed)
            p = permutation_p(rows, labels, case, control, fc_method)
    return adjust(p, pcorr)


def _gene_table(rows: DataFrame, case: str, control: str, method: str, test: str, ranks: bool, exact: bool) -> DataFrame:
    """(gene, tested, case, control, and with ``ranks`` raw_p_values) of (gene, group, value)."""
    cells = F.col("cells")
    read = profiles(rows, case, control).select(
        "gene",
        gate(F.size(F.filter(cells, lambda c: c["one"])), F.size(F.filter(cells, lambda c: ~c["one"])), test).alias("tested"),
        summary_of(values_of(cells, True), method).alias("case"),
        summary_of(values_of(cells, False), method).alias("control"),
        *([rank_sum(cells).alias("r")] if ranks else []),
    )
    return read.select("gene", "tested", "case", "control", rank_sum_p(F.col("r"), exact).alias("raw_p_values")) if ranks else read


def calculate_difference(values: DataFrame, samples: DataFrame, control: str | None, method: str = "mean", test: str = "wilcoxon", randomizations: int = 100, pcorr: str = "BH", paired: bool = False, exact: bool = False, pseudocount: float = 0, seed: int = 123) -> DataFrame:
    """The difference table of (gene, sample, value) between the two groups of ``samples`` (sample, group, ord).

    Columns: genes, <case>_<method>, <control>_<method>, <method>_difference, log2_fold_change,
    raw_p_values, adjusted_p_values, and part (1: tested, 2: too few values, with fold changes only).
    Pseudocounts are those of a part. Few samples give warnings. ``values`` is computed once: a gene is one
    row with its values as an array, and gate, summaries and rank test are read from that.
    """
    if method not in ("mean", "median"):
        raise ValueError("method must be 'mean' or 'median'")
    if test not in TESTS:
        raise ValueError("test must be 'wilcoxon' or 'shuffle'")
    if pcorr not in METHODS:
        raise ValueError("unknown correction")
    samples = settled(samples)
    # A third group is enough to tell that there are too many.
    sizes = {r["group"]: r["count"] for r in samples.where("group is not null").groupBy("group").count().orderBy("group").limit(3).collect()}
    case, control = checked_groups(list(sizes), control)
    total = sizes[case] + sizes[control]
    if test == "wilcoxon" and (min(sizes[case], sizes[control]) < 3 or total < 8):
        warnings.warn("low sample size for a rank test", stacklevel=2)
    if test == "shuffle" and total < 10:
        warnings.warn("low sample size for label shuffling" if total <= 5 else "few samples: label shuffling gives coarse p-values", stacklevel=2)
    by_array = test == "wilcoxon" and not paired
    own = samples.select("sample", "group")
    rows = values.join(F.broadcast(own) if total <= MANY_SAMPLES else own, "sample")
    rows = rows if by_array else settled(rows)
    table = settled(_gene_table(rows, case, control, method, test, by_array, exact))
    enough, few = view(table.where("tested")), table.where("not tested")
    if by_array:
        tested = adjust(enough, pcorr)
    else:
        own = rows.join(enough.select("gene"), "gene", "left_semi").drop("group")
        tested = enough.join(test_differential(own, samples, control, test, method, paired, exact, randomizations, pcorr, seed, "swap"), "gene")
    none = F.lit(None).cast("double")
    both = ((tested, 1), (few.withColumns({"raw_p_values": none, "adjusted_p_values": none}), 2))
    pairs = [fold_change_columns(lift_summaries(part, table.where(F.col("tested") == (i == 1)), pseudocount)).withColumn("part", F.lit(i)) for part, i in both]
    columns = ("gene", "case", "control", "difference", "log2_fold_change", "raw_p_values", "adjusted_p_values", "part")
    out = pairs[0].select(*columns).union(pairs[1].select(*columns))
    return out.select(
        F.col("gene").alias("genes"),
        F.col("case").alias(f"{case}_{method}"),
        F.col("control").alias(f"{control}_{method}"),
        F.col("difference").alias(f"{method}_difference"),
        "log2_fold_change",
        "raw_p_values",
        "adjusted_p_values",
        "part",
    )
