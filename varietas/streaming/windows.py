"""Diversity of a stream of measurements, in tumbling windows.

An extension beyond batch use. Sums and counts can be merged as data arrive, sums of powered shares
cannot; so the state keeps the counts of a window's parts, and a finished window is handed over with
them for the entropies to be taken in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varietas.operators.diversity import diversity


def windowed_counts(events: DataFrame, time: str, gene: str, part: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(gene, tx, sample, count) per tumbling window, ``sample`` being its start; rows later than ``late`` are dropped."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), F.col(gene).alias("gene"), F.col(part).alias("tx"))
        .agg(F.sum(value).alias("count"))
        .select("gene", "tx", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("sample"), F.col("count").cast("double").alias("count"))
    )


def start(counts: DataFrame, sink: Callable[[DataFrame, int], None], q: Sequence[float] | float = 2.0, norm: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """Give ``sink`` the values (gene, sample, q, value) of the windows that each batch finishes."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(diversity(rows, q, norm, complete=False), number)

    writer = counts.writeStream.outputMode("append").foreachBatch(batch)
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
