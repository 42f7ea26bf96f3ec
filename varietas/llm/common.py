"""What the operators of this subpackage share: checkpoints, table reads, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.operators.settled import shared_folder


#: Most rows in a batch for a Python worker. Texts are long: ten thousand of them, Spark's default, are
#: held several times over while they pass through.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let the session's Python workers take batches of at most BATCH_ROWS rows, which bounds their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, read by Spark so that any file system works, for Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Most partitions that ``numbered`` deals rows to; the driver holds one number for each.
MOST_PARTS = 10_000


def numbered(df: DataFrame, *by: str | Column, rows_per_task: int = 100_000) -> DataFrame:
    """``df``, computed once, with ``ordinal``: each row's place (from 0) in the order of ``by``.

    Rows are dealt by ranges of ``by`` and sorted there, and a range's rows follow those of the ranges
    before it. Equal keys meet in one range, so ``by`` should tell rows apart. Nulls come first.
    """
    parts = min(MOST_PARTS, parts_for(df.count(), rows_per_task))
    placed = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at_", 33)
    first, starts = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy(part).agg(F.count("*")).collect()):
        starts.append((p, first - (p << 33)))
        first += n
    told = F.broadcast(df.sparkSession.createDataFrame(starts, "part_ long, shift_ long"))
    return placed.withColumn("part_", part).join(told, "part_").withColumn("ordinal", F.col("at_") + F.col("shift_")).drop("part_", "shift_", "at_")


def text_or_empty(name: str = "text") -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """How many partitions hold ``rows`` rows at ``per_part`` each."""
    return max(least, -(-rows // per_part))


def slices(texts: list[str], max_chars: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of ``texts`` of about ``max_chars`` characters; a longer text is a run of its own."""
    i, size = 0, 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > max_chars:
            yield i, j
            i, size = j, 0
        size += len(text)
    if i < len(texts):
        yield i, len(texts)
