"""Exact paired permutation tests over all patterns of swapped labels, without a table of labels.

Patterns are numbers whose bits say which pairs swap their labels. They are dealt in ranges over tasks, each of
which takes some genes and one range: a gene's sums for a pattern are those of the pairs as they are plus, for
every bit, what the swap changes, so all patterns of a range are one matrix product. Each pattern has its own
pseudocount, half the least positive summary among all genes: least ones are found in a first pass, one array a range,
which is left out if no summary can be 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions.numerics import missing_to_null

from .foldchange import fold_change, summary
from .permute import TOLERANCE
from .settled import settled

#: Bits of a range of patterns, and genes that are evaluated at once.
BITS, GENES = 12, 64
#: Most pairs whose patterns are all evaluated.
MOST_PAIRS = 32
#: The pseudocount where no summary is positive.
LEAST = 1e-6


def _sides(values: np.ndarray, labels: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Of genes' values (G, pairs, 2) those labelled ``side`` as the labels are, and with all swapped; NaN elsewhere."""
    return tuple(np.where(marks[None] == side, values, np.nan) for marks in (labels, labels[:, ::-1]))


def summaries(values: np.ndarray, labels: np.ndarray, swaps: np.ndarray, method: str) -> list[np.ndarray]:
    """Summaries (G, patterns) of case and control for the patterns ``swaps`` (patterns, pairs) of 0 and 1; NaN without values."""
    out = []
    for side in (1, 0):
        kept, swapped = _sides(values, labels, side)
        if method == "mean":
            totals = []
            for f in (lambda x: np.nansum(x, axis=2), lambda x: (~np.isnan(x)).sum(axis=2).astype(float)):
                own, other = f(kept), f(swapped)
                totals.append(own.sum(axis=1)[:, None] + (other - own) @ swaps.T)
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(np.where(totals[1] > 0.5, totals[0] / totals[1], np.nan))
        else:
            found = np.empty((len(values), len(swaps)))
            for g in range(len(values)):
                chosen = np.sort(np.where(swaps[:, :, None] == 1, swapped[g][None], kept[g][None]).reshape(len(swaps), -1), axis=1)
                n = (~np.isnan(chosen)).sum(axis=1)
                rows = np.arange(len(swaps))
                found[g] = np.where(n > 0, (chosen[rows, np.maximum((n - 1) // 2, 0)] + chosen[rows, np.minimum(n // 2, chosen.shape[1] - 1)]) / 2, np.nan)
            out.append(found)
    return out


def _swaps(block: int, pairs: int, bits: int) -> np.ndarray:
    first = block << bits
    patterns = np.arange(first, min(first + (1 << bits), 1 << pairs), dtype=np.int64)
    return ((patterns[:, None] >> np.arange(pairs)) & 1).astype(float)


def _by_block(run: Callable[[int, pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches cut into runs of at most GENES genes of one block."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, some in pdf.groupby("block"):
                for i in range(0, len(some), GENES):
                    yield run(int(block), some.iloc[i : i + GENES])

    return of


def signflip_p(values: DataFrame, samples: DataFrame, case: str, control: str, method: str = "mean", bits: int = BITS) -> DataFrame:
    """(gene, raw_p_values): (patterns at least as large as observed + 1) / (known patterns + 1) over all 2 ** pairs patterns.

    ``values`` has (gene, sample, group, value), ``samples`` (sample, group, ord), whose neighbours are partners. The
    pattern without swaps is one of all. A gene without observed or known fold changes has 1. A gene has as many
    values as samples, at most 2 * MOST_PAIRS. A range has 2 ** ``bits`` patterns.
    """
    summary(F.lit(0.0), method)
    placed = [tuple(r) for r in samples.select("sample", "group", "ord").orderBy("ord").limit(2 * MOST_PAIRS + 1).collect()]
    pairs = len(placed) // 2
    if len(placed) % 2:
        raise ValueError("paired permutation needs an even number of samples in pairs")
    if pairs > MOST_PAIRS:
        raise ValueError(f"{pairs} pairs or more have too many patterns: ask for fewer randomizations")
    labels = np.array([1 if g == case else 0 if g == control else -1 for _, g, _ in placed]).reshape(pairs, 2)
    blocks = max(1, (1 << pairs) >> bits)
    value = missing_to_null(F.col("value"))
    by_name = F.map_from_entries(F.collect_list(F.when(value.isNotNull(), F.struct("sample", value.alias("value")))))
    known = F.array(*(F.try_element_at("by_name", F.lit(s)) for s, _, _ in placed))
    genes = settled(values.groupBy("gene").agg(by_name.alias("by_name")).select("gene", known.alias("known")))
    spark, kind = values.sparkSession, genes.schema["gene"].dataType.simpleString()
    dealt = genes.crossJoin(F.broadcast(spark.range(blocks).withColumnRenamed("id", "block"))).repartition(F.col("block"), F.pmod(F.xxhash64("gene"), F.lit(64)))

    def matrix(some: pd.DataFrame) -> np.ndarray:
        return np.array([[np.nan if v is None else v for v in row] for row in some["known"]], dtype=float).reshape(len(some), pairs, 2)

    def least(block: int, some: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate(summaries(matrix(some), labels, _swaps(block, pairs, bits), method))
        return pd.DataFrame({"block": [block], "low": [np.where(both > 0, both, np.inf).min(axis=0).tolist()]})

    def lowest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "low": [np.min(np.stack(pdf["low"]), axis=0).tolist()]})

    zero = genes.where(F.exists("known", lambda v: v <= 0)).limit(1).count() > 0
    if zero:
        lows = dealt.mapInPandas(_by_block(least), "block long, low array<double>").groupBy("block").applyInPandas(lowest, "block long, low array<double>")
        dealt = dealt.join(settled(lows), "block")
    # Where a gene's fold change is compared with those of the patterns, both have their own pseudocounts.
    seen = fold_change(values, case, control, method).select("gene", F.abs("log2_fold_change").alias("seen"))
    dealt = dealt.join(seen, "gene")

    def count(block: int, some: pd.DataFrame) -> pd.DataFrame:
        up, down = summaries(matrix(some), labels, _swaps(block, pairs, bits), method)
        if zero:
            low = np.asarray(some["low"].iloc[0], dtype=float)
            low = np.where(np.isfinite(low), low / 2, LEAST)
            up, down = (np.where(x <= 0, low[None], x) for x in (up, down))
        with np.errstate(invalid="ignore"):
            sizes = np.abs(np.log2(up / down))
        at = some["seen"].to_numpy(float)[:, None] * (1 - TOLERANCE)
        return pd.DataFrame({"gene": some["gene"].to_numpy(), "larger": (sizes >= at).sum(axis=1), "known": (~np.isnan(sizes)).sum(axis=1)})

    counts = dealt.mapInPandas(_by_block(count), f"gene {kind}, larger long, known long").groupBy("gene").agg(F.sum("larger").alias("larger"), F.sum("known").alias("known"))
    p = F.when((F.col("known") > 0) & F.col("seen").isNotNull(), (F.col("larger") + 1) / (F.col("known") + 1)).otherwise(1.0)
    return counts.join(seen, "gene").select("gene", p.alias("raw_p_values"))
