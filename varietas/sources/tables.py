"""TSV and Parquet tables: readers with checked columns, and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.operators.experiment import resolve_tx2gene
from varietas.operators.ordinals import in_file_order
from varietas.operators.settled import shared_folder


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, all columns as text; ``in_file_order`` numbers its rows."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


#: The column of a table's row names.
ROW_NAMES = "row_names"


def read_named_tsv(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tsv``; where the header has one name fewer than the rows have fields, the first field is ROW_NAMES."""
    table = read_tsv(spark, path)
    first = [r[0].split("\t") for r in spark.read.text(path).limit(2).collect()]
    if len(first) < 2 or len(first[1]) != len(first[0]) + 1:
        return table
    names = [ROW_NAMES, *first[0]]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True)


def read_tx2gene(spark: SparkSession, source: str | DataFrame, strict: bool = False) -> DataFrame:
    """(tx, gene, ord) from a path or a table; ``strict`` asks for the columns Transcript and Gen."""
    table = in_file_order(read_tsv(spark, source)) if isinstance(source, str) else source
    if not isinstance(table, DataFrame):
        raise TypeError("a path or a table is needed")
    if strict and not {"Transcript", "Gen"} <= set(table.columns):
        raise ValueError("columns Transcript and Gen are needed")
    return resolve_tx2gene(table)


def read_coldata(spark: SparkSession, path: str) -> DataFrame:
    """A sample table with ``ord``, the order of its rows, and ROW_NAMES if rows are named."""
    return in_file_order(read_named_tsv(spark, path))


def read_counts(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """Long counts (feature, sample, value) from a wide TSV whose first column holds the ids."""
    from varietas.operators.experiment import from_wide

    table = read_tsv(spark, path)
    return from_wide(table, id_column or table.columns[0])


def read_sample_files(spark: SparkSession, glob: str, id_column: str, value_column: str, suffixes: DataFrame | None = None) -> DataFrame:
    """Long counts from one file per sample: the file's name is the sample, with its suffix from (sample, suffix)."""
    rows = read_tsv(spark, glob).select(F.regexp_replace(F.col(id_column), r"[.|].*$", "").alias("feature"), F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)*$", 1).alias("sample"), F.col(value_column).cast("double").alias("value"))
    if suffixes is None:
        return rows
    return rows.join(F.broadcast(suffixes), "sample", "left").withColumn("sample", F.concat("sample", F.coalesce("suffix", F.lit("")))).drop("suffix")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.partitionBy(*partition_by).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
