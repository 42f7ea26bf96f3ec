"""A gene as one row: its values of two groups as a sorted array, and what tests and summaries read from it.

A gene has as many values as there are samples, which are a small table, so its array is small however many
genes there are. Everything that a difference table shows of a gene comes from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import missing_to_null


def marked_cells(value: Column, one: Column) -> Column:
    """Aggregate: the known values with their marks, as an array (value, one) sorted by value. A null mark leaves the value out."""
    known = missing_to_null(value)
    return F.sort_array(F.collect_list(F.when(known.isNotNull() & one.isNotNull(), F.struct(known.alias("value"), one.alias("one")))))


def profiles(values: DataFrame, first: str, second: str) -> DataFrame:
    """(gene, cells) of (gene, group, value): a row for every gene, cells empty if neither group has a known value."""
    one = F.when(F.col("group") == first, True).when(F.col("group") == second, False)
    return values.groupBy("gene").agg(marked_cells(F.col("value"), one).alias("cells"))


def values_of(cells: Column, one: bool) -> Column:
    """The sorted values of the first group, or of the second."""
    return F.transform(F.filter(cells, lambda c: c["one"] == one), lambda c: c["value"])


def summary_of(ordered: Column, method: str) -> Column:
    """Mean or median of a sorted array of known values; NULL if it is empty."""
    n = F.size(ordered)
    if method == "mean":
        return F.when(n > 0, F.aggregate(ordered, F.lit(0.0), lambda s, v: s + v) / n)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def rank_sums(cells: Column) -> Column:
    """(sum, ties) of sorted cells in one pass: the first group's ranks summed, equal values at their mean rank, and the sum of t**3 - t over ties."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(None).cast("double").alias("value"), *(zero.alias(c) for c in ("run", "ones", "before", "sum", "ties")))

    def closed(s: Column) -> tuple[Column, Column]:
        return s["sum"] + s["ones"] * (s["before"] + (s["run"] + 1) / 2), s["ties"] + s["run"] * (s["run"] * s["run"] - 1)

    def step(s: Column, c: Column) -> Column:
        one = c["one"].cast("double")
        total, ties = closed(s)
        longer = F.struct(s["value"].alias("value"), (s["run"] + 1).alias("run"), (s["ones"] + one).alias("ones"), *(s[x].alias(x) for x in ("before", "sum", "ties")))
        fresh = F.struct(c["value"].alias("value"), F.lit(1.0).alias("run"), one.alias("ones"), (s["before"] + s["run"]).alias("before"), total.alias("sum"), ties.alias("ties"))
        return F.when(s["value"] == c["value"], longer).otherwise(fresh)

    def finish(s: Column) -> Column:
        total, ties = closed(s)
        return F.struct(total.alias("sum"), ties.cast("long").alias("ties"))

    return F.aggregate(cells, start, step, finish)


def rank_sum(cells: Column) -> Column:
    """(n1, n2, u, tie_sum, z) of the rank-sum test: U of the first group, and z corrected for ties and continuity, NULL without variance."""
    found = rank_sums(cells)
    n1 = F.size(F.filter(cells, lambda c: c["one"])).cast("long")
    return F.transform(F.array(F.struct(found.alias("r"), n1.alias("n1"), (F.size(cells) - n1).alias("n2"))), _rank_sum_of)[0]


def _rank_sum_of(x: Column) -> Column:
    n1, n2 = x["n1"], x["n2"]
    n, product, tie_sum = n1 + n2, n1 * n2, x["r"]["ties"]
    u = x["r"]["sum"] - n1 * (n1 + 1) / 2
    variance = product / 12 * (n + 1 - F.try_divide(tie_sum.cast("double"), (n * (n - 1)).cast("double")))
    centred = u - product / 2
    z = F.try_divide(centred - 0.5 * F.signum(centred), F.when(variance > 0, F.sqrt(variance)))
    return F.struct(n1.alias("n1"), n2.alias("n2"), u.alias("u"), tie_sum.alias("tie_sum"), z.alias("z"))


def signed_rank(cells: Column) -> Column:
    """(n, v, tie_sum, z) of the signed-rank test: cells are the sizes of the differences other than 0, marked where positive."""
    found = rank_sums(cells)
    return F.transform(F.array(F.struct(found.alias("r"), F.size(cells).cast("long").alias("n"))), _signed_rank_of)[0]


def _signed_rank_of(x: Column) -> Column:
    n, v, tie_sum = x["n"], x["r"]["sum"], x["r"]["ties"]
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    centred = v - n * (n + 1) / 4
    z = F.try_divide(centred - 0.5 * F.signum(centred), F.when(variance > 0, F.sqrt(variance)))
    return F.struct(n.alias("n"), v.alias("v"), tie_sum.alias("tie_sum"), z.alias("z"))
