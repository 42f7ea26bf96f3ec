"""Tsallis entropies and Hill numbers of the parts that make up each gene in each sample.

Frames are long: counts (gene, tx, sample, count), one row per non-zero cell or more; values
(gene, sample, q, value). Missing is NULL throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions.numerics import Q_TOLERANCE, missing_to_null

#: Orders per aggregation, which keeps generated methods small.
ORDERS_AT_ONCE = 40
#: Largest order whose powers are summed from counts; powers of higher ones, which may overflow, are those of shares.
MOST_OF_COUNTS = 4.0


def check_orders(q: Sequence[float] | float) -> list[float]:
    orders = [q] if isinstance(q, (int, float)) and not isinstance(q, bool) else list(q)
    if not orders or any(isinstance(x, bool) or not isinstance(x, (int, float)) or math.isnan(x) for x in orders):
        raise ValueError("q must be numeric")
    if any(x <= 0 for x in orders):
        raise ValueError("q must be greater than 0")
    return [float(x) for x in orders]


def is_limit(q: float) -> bool:
    return abs(q - 1) < Q_TOLERANCE


def proportions(counts: DataFrame) -> DataFrame:
    """``counts`` with ``p``, each count's share of its gene's total in the sample; NULL for empty totals."""
    total = F.sum("count").over(Window.partitionBy("gene", "sample"))
    return counts.withColumn("p", F.when(total > 0, F.col("count") / total))


def _power_sum(p: Column, q: float) -> Column:
    if is_limit(q):
        return F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
    return F.sum(F.when(p > 0, F.pow(p, F.lit(q))).otherwise(0.0))


def _sum_of_counts(c: Column, q: float) -> Column:
    """What ``_of_counts`` makes the power sum of: no row needs its group's total, so sums are added up before the shuffle."""
    return F.sum(F.when(c > 0, c * F.ln(c) if is_limit(q) else F.pow(c, F.lit(q))).otherwise(0.0))


def _of_counts(s: Column, total: Column, q: float) -> Column:
    """The sum of p**q (q = 1: the Shannon sum) of counts with this total."""
    return F.ln(total) - s / total if is_limit(q) else s / F.pow(total, F.lit(q))


def entropy_of(power: Column, n: Column, q: float, norm: bool, base: float) -> Column:
    """S of order q from the sum of p**q (q = 1: the Shannon sum in nats) and the number of parts."""
    n = n.cast("double")
    if is_limit(q):
        s, top = power / math.log(base), F.ln(n) / math.log(base)
    else:
        s, top = (1 - power) / (q - 1), (1 - F.pow(n, F.lit(1 - q))) / (q - 1)
    s = F.try_divide(s, F.when(n > 1, top)) if norm else s
    return s + F.lit(0.0)


def hill_of(power: Column, q: float) -> Column:
    """D of order q: the exponential of the Shannon entropy, or (sum p**q) ** (1 / (1 - q))."""
    return F.exp(power) if is_limit(q) else F.pow(power, F.lit(1 / (1 - q)))


def diversity(counts: DataFrame, q: Sequence[float] | float = 2.0, norm: bool = True, what: str = "S", log_base: float = math.e, complete: bool = True, tx2gene: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(gene, sample, q, value): entropy (``what`` S) or Hill number (D) of every gene, sample and order.

    All orders come from one aggregation per gene and sample. The number of parts is that of the
    gene's transcripts in ``tx2gene`` (gene, tx), or by default in ``counts``, zeros included. With
    ``complete`` a gene stays only if its value is known for every sample (of ``samples``, by default
    of ``counts``) and order; without, cells with empty totals or missing counts are NULL. ``what`` both
    gives (gene, sample, q, entropy, hill), complete in both.
    """
    orders = check_orders(q)
    if what not in ("S", "D", "both"):
        raise ValueError("what must be 'S', 'D' or 'both'")
    rows = counts.select("gene", "tx", "sample", missing_to_null(F.col("count")).alias("count"))
    parts = (rows if tx2gene is None else tx2gene).groupBy("gene").agg(F.count_distinct("tx").alias("n"))
    cells_of = {"S": {"value": True}, "D": {"value": False}, "both": {"entropy": True, "hill": False}}[what]
    few, many = ([x for x in orders if (x <= MOST_OF_COUNTS) == low] for low in (True, False))
    out = in_samples = None
    for some in (part[i : i + ORDERS_AT_ONCE] for part in (few, many) for i in range(0, len(part), ORDERS_AT_ONCE)):
        sums = _sums(rows, some)
        in_samples = sums.select("sample").distinct() if in_samples is None else in_samples
        sums = sums.join(parts, "gene")
        value = lambda k, x, entropy: entropy_of(F.col(f"s{k}"), F.col("n"), x, norm, log_base) if entropy else hill_of(F.col(f"s{k}"), x)
        known = lambda k, x, entropy: missing_to_null(F.when(F.col("known").isNotNull(), value(k, x, entropy)))
        cells = F.array(*(F.struct(F.lit(x).alias("q"), *(known(k, x, entropy).alias(c) for c, entropy in cells_of.items())) for k, x in enumerate(some)))
        part = sums.select("gene", "sample", F.explode(cells).alias("cell")).select("gene", "sample", "cell.q", *(f"cell.{c}" for c in cells_of))
        out = part if out is None else out.unionByName(part)
    return complete_genes(out, in_samples if samples is None else samples.select("sample").distinct(), len(orders), tuple(cells_of)) if complete else out


def _sums(rows: DataFrame, orders: Sequence[float]) -> DataFrame:
    """(gene, sample, known, s0, s1, ...): power sums of all orders, which are all above MOST_OF_COUNTS or none; known is NULL for an empty total or a missing count."""
    if orders[0] <= MOST_OF_COUNTS:
        c = F.col("count")
        sums = rows.groupBy("gene", "sample").agg(F.sum("count").alias("total"), F.count_if(c.isNull()).alias("gaps"), *(_sum_of_counts(c, x).alias(f"s{k}") for k, x in enumerate(orders)))
        total = F.when((F.col("total") > 0) & (F.col("gaps") == 0), F.col("total"))
        return sums.select("gene", "sample", total.alias("known"), *(_of_counts(F.col(f"s{k}"), total, x).alias(f"s{k}") for k, x in enumerate(orders)))
    cell = Window.partitionBy("gene", "sample")
    shares = rows.withColumns({"total": F.sum("count").over(cell), "gaps": F.sum(F.col("count").isNull().cast("int")).over(cell)})
    shares = shares.withColumn("p", F.when((F.col("total") > 0) & (F.col("gaps") == 0), F.col("count") / F.col("total")))
    return shares.groupBy("gene", "sample").agg(F.max("p").alias("known"), *(_power_sum(F.col("p"), x).alias(f"s{k}") for k, x in enumerate(orders)))


def complete_genes(values: DataFrame, samples: DataFrame, orders: int, measures: tuple[str, ...] = ("value",)) -> DataFrame:
    """Rows of the genes whose values are known in all cells, of which there are samples times orders."""
    size = samples.agg((F.count("*") * orders).alias("cells"))
    all_known = F.count_if(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in measures)))
    known = all_known.over(Window.partitionBy("gene"))
    return values.withColumn("known", known).join(F.broadcast(size), F.col("known") == F.col("cells")).select(values.columns)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value worked out once: a lambda works out what it takes from outside again for each element."""
    return F.transform(F.array(value), use)[0]


def tsallis(x: Column, q: Sequence[float] | float = 2.0, norm: bool = True, what: str = "S", log_base: float = math.e) -> Column:
    """Entropy or Hill numbers of an array of counts, as a map from order to value, or one value.

    NULL where the total is not positive or a count is missing beside positive ones. ``what`` both gives a
    struct of both, S and D.
    """
    orders = check_orders(q)
    if what == "both":
        return F.struct(*(tsallis(x, q, norm, w, log_base).alias(w) for w in ("S", "D")))
    if what not in ("S", "D"):
        raise ValueError("what must be 'S', 'D' or 'both'")
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + missing_to_null(v))
    n = F.size(x)

    def one(order: float) -> Column:
        term = (lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)) if is_limit(order) else (lambda p: F.when(p > 0, F.pow(p, F.lit(order))).otherwise(0.0))
        power = lambda t: F.aggregate(x, F.lit(0.0), lambda s, v: s + term(v.cast("double") / t))
        return _once(total, lambda t: F.when(t > 0, entropy_of(power(t), n, order, norm, log_base) if what == "S" else hill_of(power(t), order)))

    if isinstance(q, (int, float)):
        return one(orders[0])
    return F.create_map(*(c for o in orders for c in (F.lit(f"q={o:g}"), one(o))))


def encode_column(sample: Column, q: Column) -> Column:
    """The name of an assay column of several orders: ``<sample>_q=<q>``."""
    return F.concat(sample, F.lit("_q="), F.regexp_replace(q.cast("string"), r"\.0$", ""))


def decode_sample(name: Column) -> Column:
    return F.regexp_replace(name, "_q=.*", "")


def decode_order(name: Column) -> Column:
    return F.when(name.contains("_q="), F.regexp_extract(name, "_q=(.*)$", 1).cast("double"))


def sample_base(name: Column) -> Column:
    """A sample's name less its last suffix: ``A_N`` and ``A_T`` share the base ``A``."""
    return F.regexp_replace(name, "_[^_]*$", "")
