"""A count matrix put together from one table per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.operators.experiment import to_wide, with_genes
from varietas.operators.settled import settled

#: Most samples, each a column of the matrix.
MOST_SAMPLES = 10_000
#: Names shown in an error.
SHOWN = 10


def cleaned(rows: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``rows`` (feature, sample, value): features less what follows a dot or bar, samples with their suffix from (sample, suffix)."""
    named = rows.withColumn("feature", F.regexp_replace("feature", r"[.|].*$", ""))
    if suffixes is None:
        return named
    return named.join(suffixes.select("sample", "suffix"), "sample", "left").withColumn("sample", F.concat("sample", F.coalesce("suffix", F.lit("")))).select("feature", "sample", "value")


def sample_names(rows: DataFrame) -> list[str]:
    """The samples of ``rows`` (sample) by name; more than MOST_SAMPLES are an error."""
    names = [r[0] for r in rows.where("sample is not null").select("sample").distinct().orderBy("sample").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples: keep the counts long")
    return names


def count_matrix(rows: DataFrame, mapping: DataFrame, suffixes: DataFrame | None = None, samples: Sequence[str] | None = None) -> DataFrame:
    """(feature, gene, one column a sample) of ``rows`` (feature, sample, value), each value that of one cell.

    A first pass finds the samples, unless given, and looks for cells with several values, which are an error that names
    some; the pivot then has fixed columns. Features that ``mapping`` (tx, gene, ord) doesn't know have no gene
    (``unmapped_features`` lists them), and cells without a value are NULL.
    """
    rows = settled(cleaned(rows, suffixes))
    if several := rows.groupBy("feature", "sample").count().where("count > 1").orderBy("feature", "sample").limit(SHOWN).collect():
        raise ValueError("cells with several values: " + ", ".join(f"{r['feature']} in {r['sample']}" for r in several))
    names = sample_names(rows) if samples is None else list(samples)
    wide = to_wide(rows, "feature", "sample", "value", names)
    genes = with_genes(rows.select("feature", F.lit("").alias("sample"), F.lit(0).alias("value")).distinct(), mapping).select(F.col("tx").alias("feature"), "gene")
    return genes.join(wide, "feature").select("feature", "gene", *(F.col(f"`{n}`") for n in names))
