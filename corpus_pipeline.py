"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Defined cases, of every stage: an empty table gives no rows; null and empty texts are no toxic,
contaminated or secret ones and stay, as the near duplicates of each other that they are: one of them with
an id; repeated rows are exact duplicates, of which one stays; rows without an id stay if no document with
an id has their text, one for each; texts are taken whole at any length; other columns pass through all
stages but the last. Each stage's operator says more.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varietas.llm.common import small_batches, stored, table
from varietas.llm.decontaminate import keep_uncontaminated
from varietas.llm.neardup import keep_one_of_each
from varietas.llm.packing import pack
from varietas.llm.secretscan import labelled_samples, redact_documents
from varietas.llm.toxicity import fit, keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labelled ones, rejects go."""
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id."""
    small_batches(spark)
    return keep_one_of_each(docs, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of the benchmark in a row go."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), width=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and n_chars follows."""
    small_batches(spark)
    return redact_documents(docs, labelled_samples(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in sequences of at most 1024: one row per piece of a document."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
