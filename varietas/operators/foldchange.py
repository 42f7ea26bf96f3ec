"""Group summaries, pseudocounts, differences and log fold changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import missing_to_null

from .settled import settled


def summary(value: Column, method: str) -> Column:
    if method not in ("mean", "median"):
        raise ValueError("method must be 'mean' or 'median'")
    return F.avg(value) if method == "mean" else F.median(value)


def check_groups(samples: DataFrame, control: str | None) -> tuple[str, str]:
    """(case, control) of a sample table (sample, group) with two groups."""
    return checked_groups([r[0] for r in samples.where("group is not null").select("group").distinct().orderBy("group").limit(3).collect()], control)


def checked_groups(names: Sequence[str], control: str | None) -> tuple[str, str]:
    """(case, control) of the names of all groups."""
    if len(names) > 2:
        raise ValueError("more than two groups")
    if len(names) < 2:
        raise ValueError("fewer than two groups")
    if control is None or not str(control).strip():
        raise ValueError("control is missing")
    if control not in names:
        raise ValueError("control is not among the groups")
    return next(n for n in names if n != control), control


def group_summaries(values: DataFrame, case: str, control: str, method: str = "mean", keys: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(keys, case, control): mean or median of the known values of (gene, group, value)."""
    of = lambda g: summary(F.when(F.col("group") == g, missing_to_null(F.col("value"))), method)
    return values.groupBy(*keys).agg(of(case).alias("case"), of(control).alias("control"))


def apply_pseudocount(pairs: DataFrame, pseudocount: float = 0, within: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` (..., case, control) with summaries of 0 or less replaced by the pseudocount.

    0, less, or no number: half the smallest positive summary of the table (of each ``within``), or
    1e-6. The summaries are computed once; the minimum is one row that joins the plan.
    """
    pairs = pairs if _given(pseudocount) else settled(pairs)
    return lift_summaries(pairs, pairs, pseudocount, within)


def _given(pseudocount: float) -> bool:
    return isinstance(pseudocount, (int, float)) and not isinstance(pseudocount, bool) and pseudocount > 0


def lift_summaries(pairs: DataFrame, of: DataFrame, pseudocount: float = 0, within: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` with summaries of 0 or less replaced by the pseudocount of the table ``of``, as ``apply_pseudocount`` has it."""
    if _given(pseudocount):
        rows = pairs.withColumn("pseudo", F.lit(float(pseudocount)))
    else:
        positive = lambda c: F.min(F.when(F.col(c) > 0, F.col(c)))
        low = of.groupBy(*within).agg(F.coalesce(F.least(positive("case"), positive("control")) / 2, F.lit(1e-6)).alias("pseudo"))
        rows = pairs.join(low, list(within)) if within else pairs.crossJoin(F.broadcast(low))
    lift = lambda c: F.when(F.col(c) <= 0, F.col("pseudo")).otherwise(F.col(c))
    return rows.withColumns({"case": lift("case"), "control": lift("control")}).drop("pseudo")


def fold_change_columns(pairs: DataFrame) -> DataFrame:
    """``pairs`` with difference (case - control) and log2_fold_change, NULL where either is missing."""
    return pairs.withColumns({"difference": F.col("case") - F.col("control"), "log2_fold_change": F.log2(F.try_divide(F.col("case"), F.col("control")))})


def fold_change(values: DataFrame, case: str, control: str, method: str = "mean", pseudocount: float = 0) -> DataFrame:
    """(gene, case, control, difference, log2_fold_change) of (gene, group, value)."""
    return fold_change_columns(apply_pseudocount(group_summaries(values, case, control, method), pseudocount))
