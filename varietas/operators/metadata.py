"""Samples' groups, pairing and order. Sample tables are small; checks on them read a bounded sample of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diversity import sample_base

#: Columns that may hold samples' groups, in the order they are looked for.
GROUP_COLUMNS = ("sample_type", "condition", "group", "sample_group", "sampleType", "class", "status", "phenotype")
#: Columns that may hold samples' names.
ID_COLUMNS = ("sample", "Sample", "sample_id", "id")
#: Names shown in an error.
SHOWN = 10


def _names(df: DataFrame, column: str) -> list[str]:
    return [r[0] for r in df.select(column).distinct().orderBy(column).limit(SHOWN).collect()]


def sample_groups(coldata: DataFrame, sample_column: str = "Sample", condition_column: str = "Condition") -> DataFrame:
    """(sample, sample_type, sample_base, ord) from a metadata table, its first row of each sample by ``ord``, if there."""
    rows = coldata.select(F.col(sample_column).alias("sample"), F.col(condition_column).alias("sample_type"), (F.col("ord") if "ord" in coldata.columns else F.lit(0)).alias("ord"))
    first = rows.groupBy("sample").agg(F.min_by("sample_type", F.struct("ord", "sample_type")).alias("sample_type"), F.min("ord").alias("ord"))
    return first.withColumn("sample_base", sample_base(F.col("sample")))


def unpaired_bases(groups: DataFrame) -> DataFrame:
    """(base) of the bases that lack one of the conditions, the base being the sample less its suffix."""
    all_ = groups.agg(F.count_distinct("sample_type").alias("all"))
    return groups.groupBy(F.col("sample_base").alias("base")).agg(F.count_distinct("sample_type").alias("n")).join(F.broadcast(all_), F.col("n") < F.col("all"), "left_semi").select("base")


def map_metadata(columns: DataFrame, coldata: DataFrame | None, sample_column: str = "Sample", condition_column: str = "Condition", paired: bool = False) -> DataFrame:
    """``columns`` (sample, q, ord) with sample_type, sample_base and col_ord, the order of the columns.

    Unpaired, columns follow the metadata table; paired, their bases in its order and then the sorted
    conditions, so that partners are neighbours; orders q ascend within a sample. Without usable
    metadata ``columns`` comes back unchanged. Samples without metadata, and bases without all
    conditions where ``paired``, are errors.
    """
    if coldata is None or not {sample_column, condition_column} <= set(coldata.columns):
        return columns
    groups = sample_groups(coldata, sample_column, condition_column)
    if paired and (bad := _names(unpaired_bases(groups), "base")):
        raise ValueError(f"bases without all conditions: {', '.join(bad)}")
    if bad := _names(columns.join(groups, "sample", "left_anti"), "sample"):
        raise ValueError(f"samples without metadata: {', '.join(bad)}")
    mapped = columns.drop("ord").join(groups, "sample")
    if paired:
        first = Window.partitionBy("sample_base")
        order = [F.min("ord").over(first).alias("base_ord"), "sample_type", "ord"]
        mapped = mapped.select("*", order[0])
        by = Window.orderBy("base_ord", "sample_type", "ord", "sample", "q")
    else:
        by = Window.orderBy("ord", "sample", "q")
    return mapped.withColumn("col_ord", F.row_number().over(by)).select("sample", "q", "sample_type", "sample_base", "col_ord")


def with_groups(values: DataFrame, groups: DataFrame | None, strict: bool = True) -> DataFrame:
    """``values`` with ``group`` by sample; ``Group`` throughout without a mapping; unmatched samples are an error."""
    if groups is None:
        return values.withColumn("group", F.lit("Group"))
    if strict and (bad := _names(values.select("sample").distinct().join(groups, "sample", "left_anti"), "sample")):
        raise ValueError(f"samples without a group: {', '.join(bad)}")
    return values.join(groups.select("sample", F.col("sample_type").alias("group")), "sample", "left")


def long_values(values: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(gene, sample, q, value, group) of the known values: what curves and violins are drawn from."""
    return with_groups(values.where("value is not null"), groups)


def infer_group_column(coldata: DataFrame, wanted: str | None = None, exclude: Sequence[str] = ()) -> str | None:
    """The column that holds groups: the wanted one, a known name, else the first with two values, else the fewest above one."""
    if wanted is not None and wanted in coldata.columns:
        return wanted
    if known := next((c for c in GROUP_COLUMNS if c in coldata.columns), None):
        return known
    names = [c for c in coldata.columns if c not in exclude]
    if not names:
        return None
    counts = coldata.agg(*(F.count_distinct(F.col(f"`{c}`")).alias(c) for c in names)).first().asDict()
    if two := next((c for c in names if counts[c] == 2), None):
        return two
    more = [c for c in names if counts[c] > 1]
    return min(more, key=lambda c: counts[c]) if more else None


def control_group(groups: DataFrame, control: str | None = None, column: str = "sample_type") -> str:
    """The control: the given one if it is a group, else ``Normal`` if it is, else the first."""
    names = _names(groups, column)
    return control if control in names else "Normal" if "Normal" in names else names[0]


def samples_in_order(coldata: DataFrame, samples: DataFrame, column: str, row_names: str = "row_names") -> DataFrame:
    """(sample, group) of each of ``samples`` (sample) from a metadata table.

    Its row names, if it has them and they name all samples, are the key, else the first known id column.
    """
    if row_names in coldata.columns:
        named = coldata.select(F.col(row_names).alias("sample"), F.col(column).alias("group"))
        if samples.join(named, "sample", "left_anti").isEmpty():
            return samples.join(named, "sample")
    key = next((c for c in ID_COLUMNS if c in coldata.columns), None)
    if key is None:
        raise ValueError("no column of sample ids")
    table = coldata.select(F.col(key).alias("sample"), F.col(column).alias("group"))
    if bad := _names(samples.join(table, "sample", "left_anti"), "sample"):
        raise ValueError(f"samples without metadata: {', '.join(bad)}")
    return samples.join(table, "sample")


def pair_number(order: Column) -> Column:
    """The pair of the order-th column, counted from 1: neighbours (1, 2), (3, 4), ... are partners."""
    return F.ceil(order / 2).cast("int")
