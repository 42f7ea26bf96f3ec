"""Experiments: named long assays (feature, sample, value) with row, column and free metadata."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.numerics import missing_to_null

from .diversity import diversity, encode_column
from .ordinals import numbered

#: Assay names that hold read counts, in the order they are looked for.
COUNT_ASSAYS = ("readcounts", "counts", "tx_counts", "counts_tx")


@dataclass(frozen=True)
class Experiment:
    """``assays``: name -> (feature, sample, value); ``row_data``: (feature, ord, ...); ``col_data``: (sample, ord, ...).

    ``metadata`` holds scalars and frames such as ``readcounts`` (feature, sample, value) and
    ``tx2gene`` (tx, gene, ord). Everything is lazy.
    """

    assays: Mapping[str, DataFrame]
    row_data: DataFrame | None = None
    col_data: DataFrame | None = None
    metadata: Mapping[str, object] = field(default_factory=dict)

    def assay(self, which: str | int | None = None) -> DataFrame:
        """By name, by number from 1, or the first; an unknown name gives the first one and a warning."""
        names = list(self.assays)
        if isinstance(which, int):
            if not 1 <= which <= len(names):
                raise ValueError("assay number out of range")
            return self.assays[names[which - 1]]
        if which is not None and which not in self.assays:
            warnings.warn(f"no assay {which}: {names[0]} is taken", stacklevel=3)
        return self.assays[which if which in self.assays else names[0]]

    def with_metadata(self, **more: object) -> Experiment:
        return replace(self, metadata={**self.metadata, **more})


def from_wide(wide: DataFrame, id_column: str, samples: Sequence[str] | None = None) -> DataFrame:
    """A wide matrix, one column per sample, as (feature, sample, value); samples may hold dots."""
    names = [c for c in wide.columns if c != id_column] if samples is None else list(samples)
    quoted = [F.col(f"`{c}`").cast("double").alias(c) for c in names]
    long = wide.select(F.col(f"`{id_column}`").cast("string").alias("feature"), *quoted).unpivot(["feature"], [f"`{c}`" for c in names], "sample", "value")
    return long.withColumn("value", missing_to_null(F.col("value")))


def to_wide(long: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """(row, column, value) as one row per ``row`` and one column for each of ``columns``."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def resolve_tx2gene(table: DataFrame, tx_column: str = "Transcript", gene_column: str = "Gen") -> DataFrame:
    """(tx, gene, ord) from the named columns, else the first two; the first row of a transcript wins.

    Rows are in the order of ``ord``, if there, else in that of their genes, which is the same in every run.
    """
    tx = tx_column if tx_column in table.columns else table.columns[0]
    gene = gene_column if gene_column in table.columns else table.columns[min(1, len(table.columns) - 1)]
    rows = table.select(F.col(f"`{tx}`").cast("string").alias("tx"), F.col(f"`{gene}`").cast("string").alias("gene"), (F.col("ord") if "ord" in table.columns else F.lit(0)).alias("ord"))
    return first_of_each(rows, "tx")


def first_of_each(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The row of the smallest ``order`` for each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(order), *(c for c in rest if c != order))).alias("r")).select(key, *(f"r.{c}" for c in rest))


def build_experiment(tx2gene: DataFrame, readcounts: DataFrame, assay_name: str = "counts") -> Experiment:
    """From a mapping table and long counts (feature, sample, value)."""
    kind = dict(readcounts.dtypes)["value"]
    if kind in ("string", "boolean"):
        raise ValueError("readcounts must be numeric")
    mapping = resolve_tx2gene(tx2gene)
    rows = readcounts.select("feature").distinct().join(mapping.withColumnRenamed("tx", "feature"), "feature", "left")
    return Experiment({assay_name: readcounts}, rows, readcounts.select("sample").distinct(), {"readcounts": readcounts, "tx2gene": mapping})


def map_transcripts(readcounts: DataFrame, tx2gene: DataFrame, tx_column: str = "Transcript") -> DataFrame:
    """``readcounts`` (ord, sample, value, feature) with transcript ids as features.

    As many rows as the mapping: ids are given by position. Else all features must be in the mapping
    and stay; otherwise an error.
    """
    ids = tx2gene.select(F.col(tx_column).cast("string").alias("id"), F.col("ord"))
    rows = readcounts.select("feature", "ord").distinct()
    n, m = rows.count(), ids.count()
    if n == m:
        places = numbered(rows, "ord", "feature").drop("feature")
        named = places.join(numbered(ids, "ord", "id").select("place", "id"), "place").select("ord", F.col("id").alias("feature"))
        return readcounts.drop("feature").join(named, "ord")
    if rows.join(ids, rows.feature == ids.id, "left_anti").isEmpty():
        return readcounts
    raise ValueError("transcript ids can't be assigned: neither as many rows as the mapping nor all names in it")


def counts_of(x: Experiment, given: DataFrame | str | None = None) -> DataFrame:
    """Read counts: given ones, or those of the wide TSV at a given path, else the metadata's, else the first assay known to hold counts, else the first, with a warning."""
    if isinstance(given, str):
        from varietas.sources.tables import read_counts

        return read_counts(next(iter(x.assays.values())).sparkSession, given)
    if given is not None:
        return given
    if "readcounts" in x.metadata:
        return x.metadata["readcounts"]
    known = next((x.assays[n] for n in COUNT_ASSAYS if n in x.assays), None)
    if known is None:
        warnings.warn("no assay is known to hold read counts: the first one is taken", stacklevel=2)
    return next(iter(x.assays.values())) if known is None else known


def mapping_of(x: Experiment, counts: DataFrame) -> DataFrame:
    """(tx, gene, ord): the metadata's mapping, else the row data's genes, else each feature its own gene."""
    if "tx2gene" in x.metadata:
        return x.metadata["tx2gene"]
    if x.row_data is not None and "gene" in x.row_data.columns:
        return x.row_data.select(F.col("feature").alias("tx"), "gene", "ord")
    return counts.select(F.col("feature").alias("tx"), F.col("feature").alias("gene"), F.lit(0).alias("ord")).distinct()


def with_genes(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts (feature, sample, value) joined with the first gene of each transcript; unmapped ones have none."""
    first = first_of_each(mapping.select("tx", "gene", "ord"), "tx").select("tx", "gene")
    return counts.withColumnRenamed("feature", "tx").join(first, "tx", "left").select("gene", "tx", "sample", F.col("value").alias("count"))


def mapped_rows(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``counts`` (feature, ...) of the features in ``mapping`` (tx, ...)."""
    return counts.join(mapping.select(F.col("tx").alias("feature")), "feature", "left_semi")


def unmapped_features(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(feature, rows): what a mapping doesn't know, and in how many rows it is."""
    left = counts.join(mapping.select(F.col("tx").alias("feature")), "feature", "left_anti")
    return left.groupBy("feature").agg(F.count("*").alias("rows"))


def from_assays(assays: Mapping[str, DataFrame], tpm: bool = False) -> DataFrame:
    """Counts of an imported quantification: four parts with ``counts``, or ``abundance`` where ``tpm``."""
    if "counts" not in assays:
        raise ValueError("counts are missing")
    if len(assays) == 4 and tpm:
        return assays["abundance"]
    return assays["counts"]


def calculate_diversity(x: Experiment | DataFrame | Mapping[str, DataFrame], genes: DataFrame | None = None, q: Sequence[float] | float = 2.0, norm: bool = True, what: str = "S", tpm: bool = False, assay: str | int | None = None) -> Experiment:
    """The diversity of every gene, sample and order as an experiment with one assay, diversity or hill.

    ``x`` is an experiment, whose read counts in the metadata go before its assays, or long counts
    (feature, sample, value), which need ``genes`` (tx, gene, ord), or the parts of an imported
    quantification, of which ``tpm`` takes the abundance. Columns are samples, or ``sample_q=...`` for
    several orders.
    """
    if what not in ("S", "D"):
        raise ValueError("what must be 'S' or 'D'")
    if isinstance(x, Mapping):
        x = from_assays(x, tpm)
    if isinstance(x, Experiment):
        if isinstance(assay, int):
            x.assay(assay)
        counts = x.metadata["readcounts"] if "readcounts" in x.metadata else x.assay(assay)
        mapping = genes if genes is not None else mapping_of(x, counts)
        kept = {k: x.metadata[k] for k in ("readcounts", "tx2gene") if k in x.metadata}
    else:
        counts, mapping, kept = x, genes, {}
        if mapping is None:
            raise ValueError("genes are needed for plain counts")
    if dict(counts.dtypes)["value"] in ("string", "boolean"):
        raise ValueError("counts must be numeric")
    if not counts.where(missing_to_null(F.col("value")).isNull()).isEmpty():
        raise ValueError("counts must not be missing")
    rows = with_genes(counts, mapping).where("gene is not null")
    values = diversity(rows, q, norm, what, samples=counts)
    single = isinstance(q, (int, float)) or len(list(q)) == 1
    named = values.withColumn("column", F.col("sample") if single else encode_column(F.col("sample"), F.col("q")))
    assay_ = named.select(F.col("gene").alias("feature"), F.col("column").alias("sample"), "value")
    cols = named.select(F.col("column").alias("sample"), F.col("sample").alias("samples"), "q").distinct()
    meta = {"method": "tsallis", "norm": norm, "q": q, "what": what, "long": values, **kept}
    return Experiment({"diversity" if what == "S" else "hill": assay_}, values.select(F.col("gene").alias("feature")).distinct(), cols, meta)
