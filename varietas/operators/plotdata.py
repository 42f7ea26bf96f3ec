"""The frames behind the plots."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varietas.functions.numerics import format_label

from .foldchange import fold_change
from .quantiles import density, quantiles, ranged
from .settled import settled

#: Names of fold-change and adjusted-p columns, in the order they are looked for, and the level of significance.
FOLD_COLUMNS = ("log2_fold_change", "logFC", "fold", "estimate_interaction", "fold_change")
P_COLUMNS = ("adjusted_p_values", "adj_p_value", "adj_p", "padj", "p.adjust")
SIGNIFICANT = 0.05
QUARTILES = (0.25, 0.5, 0.75)
SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"


def q_curve(values: DataFrame) -> DataFrame:
    """(group, q, median, iqr, low, high): the median with a ribbon of half the inter-quartile range either way.

    A group has as many values as there are genes times samples, so it is never in one task.
    """
    keys = ["group", "q"]
    ranges = ranged(values, keys)
    if ranges.isEmpty():
        raise ValueError("no values")
    return _with_ribbon(quantiles(ranges, keys, QUARTILES), keys)


def gene_profile(values: DataFrame, genes: Sequence[str] | DataFrame | None = None, table: DataFrame | None = None, n_top: int = 10, show_samples: bool = False) -> DataFrame:
    """The q curve of each gene of a list, of a frame (gene), or of the ``n_top`` first genes of an interaction ``table``.

    ``show_samples`` adds the samples' own lines: rows with ``sample`` and ``value``, and no spread. A
    listed gene without values is an error.
    """
    if genes is None:
        if table is None:
            raise ValueError("genes or an interaction table are needed")
        genes = top_genes(table, n_top, "adj_p_interaction", "p_interaction", "gene")
    if isinstance(genes, DataFrame):
        rows = values.join(genes.select("gene"), "gene", "left_semi")
    else:
        rows = values.where(F.col("gene").isin(*genes))
        found = {r[0] for r in rows.select("gene").distinct().collect()}
        if missing := [g for g in genes if g not in found]:
            raise ValueError(f"genes without values: {', '.join(missing)}")
    # A gene's values of one order are as many as samples.
    keys = ["gene", "group", "q"]
    spread = _with_ribbon(rows.groupBy(*keys).agg(F.percentile("value", F.array(*(F.lit(x) for x in QUARTILES))).alias("p")), keys)
    return spread.unionByName(rows.select("gene", "group", "q", "sample", "value"), allowMissingColumns=True) if show_samples else spread


def _with_ribbon(quartiles: DataFrame, keys: list[str]) -> DataFrame:
    out = quartiles.select(*keys, F.col("p")[1].alias("median"), (F.col("p")[2] - F.col("p")[0]).alias("iqr"))
    return out.withColumns({"low": F.col("median") - F.col("iqr") / 2, "high": F.col("median") + F.col("iqr") / 2})


def mean_by_group(values: DataFrame) -> DataFrame:
    """(group, gene, mean): what mean violins show."""
    return values.groupBy("group", "gene").agg(F.avg("value").alias("mean"))


def mean_density(values: DataFrame, points: int = 64) -> DataFrame:
    """(group, x, density): the shape of a mean violin, the density of the genes' means in each group."""
    return density(mean_by_group(values).withColumnRenamed("mean", "value"), ["group"], points)


def box_statistics(values: DataFrame) -> DataFrame:
    """(q, group, n, lower, median, upper): the boxes in violins of several orders, of groups with known values."""
    out = quantiles(ranged(values, ["q", "group"]), ["q", "group"], QUARTILES)
    return out.select("q", "group", "n", F.col("p")[0].alias("lower"), F.col("p")[1].alias("median"), F.col("p")[2].alias("upper"))


def first_column(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    return next((c for c in wanted if c in columns), None)


def ma_frame(table: DataFrame, fold: DataFrame | None = None, sig_alpha: float = 0.05) -> DataFrame:
    """(genes, x, y, padj, significant) of a difference table.

    y is the first known fold-change column; with ``fold`` (genes, log2_fold_change, ...) its values go
    first. x is the row's mean of the first two mean or median columns, one alone, ``mean``, or the
    row number. Missing adjusted p-values count as 1. Significance is at the fixed level, whatever
    ``sig_alpha``, which only scales of a drawing use.
    """
    if fold is not None:
        renamed = fold.select("genes", *(F.col(c).alias(f"_{c}") for c in fold.columns if c != "genes"))
        table = table.join(renamed, "genes", "left")
        for c in (c for c in fold.columns if c != "genes"):
            table = table.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)) if c in table.columns else F.col(f"_{c}")).drop(f"_{c}")
    y = first_column(table.columns, FOLD_COLUMNS)
    if y is None:
        raise ValueError("no fold-change column")
    means, medians = ([c for c in table.columns if c.endswith(s)] for s in ("_mean", "_median"))
    if means and medians:
        raise ValueError("mean and median columns together")
    both = (means or medians)[:2]
    if both:
        x = _row_mean([F.col(f"`{c}`") for c in both])
    elif "mean" in table.columns:
        x = F.col("mean")
    else:
        x = F.row_number().over(Window.orderBy("genes")).cast("double")
    p = first_column(table.columns, P_COLUMNS)
    padj = F.coalesce(F.col(f"`{p}`"), F.lit(1.0)) if p else F.lit(1.0)
    significant = F.coalesce((F.abs(F.col(y)) > 0) & (padj < SIGNIFICANT), F.lit(False))
    return table.select("genes", x.alias("x"), F.col(y).alias("y"), padj.alias("padj"), significant.alias("significant"))


def _row_mean(columns: list[Column]) -> Column:
    known = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)), known)


def gene_counts(counts: DataFrame) -> DataFrame:
    """(gene, sample, count): transcript counts summed by gene."""
    return counts.groupBy("gene", "sample").agg(F.sum("count").alias("count"))


def ma_expression(table: DataFrame, counts: DataFrame, groups: DataFrame, case: str, control: str, fc_method: str = "median", pseudocount: float = 0) -> DataFrame:
    """The MA frame of a difference table with the fold changes of gene expression."""
    rows = gene_counts(counts).join(groups.select("sample", "group"), "sample").withColumnRenamed("count", "value")
    fold = fold_change(rows, case, control, fc_method, pseudocount).select(F.col("gene").alias("genes"), "log2_fold_change")
    return ma_frame(table, fold).orderBy("genes")


def volcano_frame(table: DataFrame, x: str | None = None, padj: str = "adjusted_p_values", label_thresh: float = 0.1, padj_thresh: float = 0.05) -> DataFrame:
    """(genes, x, padj, y, significant): x is the first ``*_difference``, else the first numeric column that is no p.

    A table without ``padj``, and one without any finite x, is an error.
    """
    if padj not in table.columns:
        raise ValueError(f"no column {padj}")
    numeric = [c for c, t in table.dtypes if t in ("double", "float", "int", "bigint")]
    x = x or next((c for c in table.columns if c.endswith("_difference")), None) or next((c for c in numeric if "p_value" not in c and "padj" not in c and c != padj), None)
    if x is None:
        raise ValueError("no column for x")
    p = F.coalesce(F.col(padj), F.lit(1.0))
    p = F.when(p <= 0, F.lit(sys.float_info.min)).otherwise(p)
    value = F.col(f"`{x}`").cast("double")
    table = settled(table)
    rows = table.select(F.col("genes"), value.alias("x"), p.alias("padj")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    if rows.isEmpty():
        raise ValueError("no valid points")
    return rows.withColumns({"y": -F.log10("padj"), "significant": (F.abs("x") >= label_thresh) & (F.col("padj") < padj_thresh)})


def top_genes(table: DataFrame, n: int, p: str = "adjusted_p_values", then: str = "raw_p_values", gene: str = "genes") -> DataFrame:
    """The n genes of least adjusted, then raw p; genes without p left out."""
    order = [c for c in (p, then) if c in table.columns]
    least = table.where(F.col(order[0]).isNotNull()).groupBy(gene).agg(*(F.min(c).alias(c) for c in order))
    return least.orderBy(*order, gene).limit(n).select(F.col(gene).alias("gene"))


def first_transcripts(mapping: DataFrame, genes: DataFrame, n: int) -> DataFrame:
    """(gene, tx, place) of the first n transcripts of each gene in the order of the mapping (tx, gene, ord)."""
    place = F.row_number().over(Window.partitionBy("gene").orderBy("ord"))
    return mapping.join(genes, "gene", "left_semi").withColumn("place", place).where(F.col("place") <= n).select("gene", "tx", "place")


def transcript_summary(counts: DataFrame, chosen: DataFrame, groups: DataFrame, metric: str = "median", pseudocount: float = 1e-6) -> DataFrame:
    """(gene, tx, group, expression, log2expr) of the chosen transcripts (gene, tx)."""
    value = F.col("count").cast("double")
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    of = {"median": F.median(value), "mean": F.avg(value), "variance": F.var_samp(value), "iqr": quartiles[1] - quartiles[0]}
    if metric not in of:
        raise ValueError("metric must be median, mean, variance or iqr")
    rows = counts.select("tx", "sample", "count").join(chosen.select("gene", "tx"), "tx").join(groups.select("sample", "group"), "sample")
    out = rows.groupBy("gene", "tx", "group").agg(of[metric].alias("expression"))
    return out.withColumn("log2expr", F.log2(F.col("expression") + pseudocount))


def fill_limits(summaries: DataFrame) -> DataFrame:
    """(low, high): the colour limits that all genes' panels share."""
    return summaries.agg(F.min("log2expr").alias("low"), F.max("log2expr").alias("high"))


def with_labels(frame: DataFrame, column: str, out: str = "label") -> DataFrame:
    return frame.withColumn(out, format_label(F.col(column)))


def chart(mark: str, x: str, y: str, color: str | None = None, facet: str | None = None, title: str | None = None) -> str:
    """A Vega-Lite drawing of a frame, as text; the data are named ``table``."""
    encoding = {"x": {"field": x, "type": "quantitative"}, "y": {"field": y, "type": "quantitative"}}
    if color:
        encoding["color"] = {"field": color, "type": "nominal"}
    if facet:
        encoding["facet"] = {"field": facet, "type": "nominal"}
    return json.dumps({"$schema": SCHEMA, "title": title, "data": {"name": "table"}, "mark": mark, "encoding": encoding}, indent=1)


#: Most rows that a drawing holds itself.
MOST_DRAWN = 5_000


def transcript_panels(summaries: DataFrame, title: str, genes: Sequence[str] | None = None) -> str:
    """A Vega-Lite drawing with a panel for each gene of (gene, tx, group, log2expr), side by side, as text.

    Panels share the limits of their colours, so one legend below serves all; missing values are grey. The rows are
    part of the drawing: more than MOST_DRAWN are an error. Panels are in the order of ``genes``, by default by name,
    and transcripts in that of ``place``, if there, else by name. A listed gene without rows is an error.
    """
    place = [F.col("place")] if "place" in summaries.columns else []
    rows = summaries.select("gene", "tx", "group", F.col("log2expr"), *place).limit(MOST_DRAWN + 1).collect()
    if len(rows) > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} rows to draw: choose fewer genes or transcripts")
    by_gene: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["place"] if place else 0, r["tx"], r["group"])):
        by_gene.setdefault(r["gene"], []).append(r)
    if missing := [g for g in genes or () if g not in by_gene]:
        raise ValueError(f"genes without values: {', '.join(missing)}")
    known = [r["log2expr"] for r in rows if r["log2expr"] is not None]
    domain = [min(known), max(known)] if known else None

    def panel(gene: str) -> dict:
        own = by_gene[gene]
        fill = {"field": "log2expr", "type": "quantitative", "title": "log2(expr)", "scale": {"scheme": "viridis", "reverse": True} | ({"domain": domain} if domain else {}), "legend": {"orient": "bottom"}}
        return {
            "title": gene,
            "data": {"values": [{c: r[c] for c in ("tx", "group", "log2expr")} for r in own]},
            "mark": {"type": "rect", "invalid": None},
            "encoding": {
                "x": {"field": "group", "type": "nominal", "title": None},
                "y": {"field": "tx", "type": "nominal", "title": None, "sort": list(dict.fromkeys(r["tx"] for r in own))},
                "color": {"condition": {"test": "datum.log2expr === null", "value": "#cccccc"}, **fill},
            },
        }

    order = list(genes) if genes else sorted(by_gene)
    return json.dumps({"$schema": SCHEMA, "title": title, "hconcat": [panel(g) for g in order], "resolve": {"scale": {"color": "shared"}, "legend": {"color": "shared"}}}, indent=1)


def save_drawing(spark: SparkSession, drawing: str, path: str) -> None:
    """The drawing as a folder of one text file, on any file system that Spark writes to."""
    spark.createDataFrame([(drawing,)], "value string").coalesce(1).write.text(path)
