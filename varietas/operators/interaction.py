"""Does the diversity-by-order curve of a gene differ in shape between groups? Four kinds of fits.

linear is one aggregation per (gene, group) and closed forms; mixed (``mixed``) and additive models
(``additive``) are fitted to sums that Spark makes, many genes at a time; for curves (``curves``) a gene is one
row with its observations, of which there are as many as samples times orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import t_two_sided

from .additive import additive_interaction, fit_additive
from .curves import curve_interaction, fit_curves
from .filters import enough_observations
from .mixed import RandomIntercept, fit_mixed, mixed_interaction
from .ordinals import numbered
from .padjust import adjust
from .settled import settled

__all__ = ["METHODS", "RandomIntercept", "additive_interaction", "calculate_interaction", "curve_interaction", "fit_additive", "fit_curves", "fit_mixed", "fit_summary", "linear_interaction", "mixed_interaction"]

METHODS = ("linear", "lmm", "gam", "fpca")
#: The order of an interaction table.
ORDER = ("adj_p_interaction is null", "adj_p_interaction", "p_interaction is null", "p_interaction", "gene")


def linear_interaction(values: DataFrame, min_obs: int = 10) -> DataFrame:
    """(gene, t, df, p_interaction) of the first interaction term of value ~ q * group.

    ``values`` has (gene, group, q, value). The slope of the second group in alphabetical order is
    compared with that of the first, with the variance pooled over all groups. A gene whose slopes
    can't be told has no row.
    """
    known = enough_observations(values, min_obs)
    parts = known.groupBy("gene", "group").agg(F.regr_count("value", "q").alias("n"), F.regr_sxx("value", "q").alias("sxx"), F.regr_sxy("value", "q").alias("sxy"), F.regr_syy("value", "q").alias("syy"))
    fit = F.struct("group", F.try_divide(F.col("sxy"), F.col("sxx")).alias("slope"), "sxx")
    left_over = F.sum(F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0)))
    whole = parts.groupBy("gene").agg(F.sort_array(F.collect_list(fit)).alias("fits"), left_over.alias("rss"), (F.sum("n") - F.count("*") - F.count_if(F.col("sxx") > 0)).alias("df"))
    a, b = F.element_at("fits", 1), F.element_at("fits", 2)
    error = F.sqrt(F.try_divide(F.col("rss"), F.col("df")) * (F.try_divide(F.lit(1.0), a["sxx"]) + F.try_divide(F.lit(1.0), b["sxx"])))
    t = F.try_divide(b["slope"] - a["slope"], F.when(error > 0, error))
    return whole.where((F.col("df") > 0) & (a["sxx"] > 0) & (b["sxx"] > 0)).select("gene", t.alias("t"), F.col("df").cast("int").alias("df")).withColumn("p_interaction", t_two_sided(F.col("t"), F.col("df"))).where("t is not null")


def calculate_interaction(values: DataFrame, method: str = "linear", min_obs: int = 10, pvalue: str = "satterthwaite", subject: str | None = None, pcorr: str = "BH", paired: bool = False) -> DataFrame:
    """The interaction table of (gene, sample, group, q, value), with adj_p_interaction, by adjusted and raw p.

    ``subject`` names the column of mixed fits' subjects; by default it is ``sample_base``, if ``values``
    has it, which ``paired`` needs, else each sample is one.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if "q" not in values.columns:
        raise ValueError("values of several orders are needed")
    if "group" not in values.columns:
        raise ValueError("groups are needed")
    if subject is not None and subject not in values.columns:
        raise ValueError(f"no column {subject}")
    if paired and subject is None and "sample_base" not in values.columns:
        raise ValueError("paired samples need a column sample_base or a subject column")
    subject = subject or ("sample_base" if "sample_base" in values.columns else "sample")
    values = settled(values)
    if method == "linear":
        fits = linear_interaction(values, min_obs).select("gene", "p_interaction")
    elif method == "lmm":
        fits = mixed_interaction(values.withColumn("subject", F.col(subject)), min_obs, pvalue)
    else:
        fits = (additive_interaction if method == "gam" else curve_interaction)(values, min_obs)
    return adjust(fits, pcorr, "p_interaction", "adj_p_interaction").orderBy(*map(F.expr, ORDER))


def in_order(table: DataFrame) -> DataFrame:
    """An interaction table with ``place``, from 1, by adjusted p, then p, missing ones last."""
    keys = {"_1": F.col("adj_p_interaction").isNull(), "_2": F.col("adj_p_interaction"), "_3": F.col("p_interaction").isNull(), "_4": F.col("p_interaction")}
    return numbered(table.withColumns(keys), *keys, "gene").drop(*keys)


def fit_summary(fits: DataFrame) -> DataFrame:
    """(fit_method, n, singular): how many genes were fitted in which way."""
    return fits.groupBy("fit_method").agg(F.count("*").alias("n"), F.count_if("singular").alias("singular"))
