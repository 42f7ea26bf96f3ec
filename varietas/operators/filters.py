"""Expression filter and the gates before tests and fits."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .experiment import Experiment
from .settled import settled


def expressed(counts: DataFrame, min_count: float = 5, min_samples: int = 5, feature: str = "tx", value: str = "count", samples: DataFrame | None = None) -> DataFrame:
    """(feature) of the features above ``min_count`` in at least ``min_samples`` samples, or in all if there are fewer."""
    size = (samples or counts).agg(F.count_distinct("sample").alias("size"))
    above = counts.groupBy(feature).agg(F.count_if(F.col(value) > min_count).alias("above"))
    return above.join(F.broadcast(size), F.col("above") >= F.least(F.lit(min_samples), F.col("size")), "left_semi").select(feature)


def filter_experiment(x: Experiment, min_count: float = 5, min_samples: int = 5, assay: str | int = "counts") -> Experiment:
    """The experiment with the expressed features only, in every assay, the row data, read counts and mapping.

    The kept features are computed once; none is a warning, counts that are no numbers an error.
    """
    counts = x.assay(assay)
    if dict(counts.dtypes)["value"] in ("string", "boolean"):
        raise ValueError("counts must be numeric")
    kept = settled(expressed(counts, min_count, min_samples, "feature", "value"))
    if kept.isEmpty():
        warnings.warn("no feature is expressed enough", stacklevel=2)
    semi = lambda df, column: df.join(kept.withColumnRenamed("feature", column), column, "left_semi")
    meta = dict(x.metadata, filtered=True)
    for name, column in (("readcounts", "feature"), ("tx2gene", "tx")):
        if name in meta:
            meta[name] = semi(meta[name], column)
    return Experiment({n: semi(a, "feature") for n, a in x.assays.items()}, None if x.row_data is None else semi(x.row_data, "feature"), x.col_data, meta)


def sample_size_gate(values: DataFrame, groups: tuple[str, str], test: str) -> DataFrame:
    """``values`` (gene, sample, group, value) with ``tested``: whether the gene has enough known values.

    wilcoxon: three in each group and eight in all; shuffle: five in all.
    """
    w = Window.partitionBy("gene")
    n = [F.count(F.when(F.col("group") == g, F.col("value"))).over(w) for g in groups]
    return values.withColumn("tested", gate(*n, test))


def gate(first: Column, second: Column, test: str) -> Column:
    """Whether so many known values of two groups are enough for a test."""
    return (first >= 3) & (second >= 3) & (first + second >= 8) if test == "wilcoxon" else first + second >= 5


def enough_observations(values: DataFrame, min_obs: int = 10, subjects: bool = False) -> DataFrame:
    """Known rows of the genes with ``min_obs`` known values and two groups (and subjects, where asked)."""
    known = values.where("value is not null")
    size = known.groupBy("gene").agg(F.count("*").alias("n"), F.count_distinct("group").alias("g"), *([F.count_distinct("subject").alias("s")] if subjects else []))
    return known.join(size.where((F.col("n") >= min_obs) & (F.col("g") >= 2) & ((F.col("s") >= 2) if subjects else F.lit(True))).select("gene"), "gene", "left_semi")


def choose_genes(counts: DataFrame, top: int, more: int, seed: int = 123) -> DataFrame:
    """(gene) of the ``top`` genes of the largest totals and of ``more`` others, drawn by md5('seed:gene')."""
    totals = counts.groupBy("gene").agg(F.sum("count").alias("total"))
    largest = totals.orderBy(F.desc("total"), "gene").limit(top).select("gene")
    others = totals.join(F.broadcast(largest), "gene", "left_anti")
    drawn = others.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "gene").cast("binary")), "gene").limit(more)
    return largest.union(drawn.select("gene"))
