"""Permutation tests of log fold changes: shuffled labels, and swaps within pairs.

Labels are a small table (perm, sample, group) made from hashes of the seed, so the same seed gives
the same permutations on any cluster, and SQL can follow them. A gene is one row with its values as an
array in the order of the samples; all permutations are evaluated on it, so rows are not multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions.numerics import missing_to_null

from .foldchange import summary
from .settled import settled

#: Relative tolerance in comparing absolute log fold changes, which mirrored labels give with opposite rounding.
TOLERANCE = 1e-9
#: Most labels, permutations times samples, that are made: they go to every task.
MOST_LABELS = 4_000_000


def _check_size(permutations: int, samples: int) -> None:
    if permutations * samples > MOST_LABELS:
        raise ValueError(f"{permutations} permutations of {samples} samples are too many: ask for fewer randomizations")


def shuffled_labels(samples: DataFrame, randomizations: int, seed: int = 123) -> DataFrame:
    """(perm, sample, group): the groups dealt anew by the order of md5('seed:perm:sample')."""
    samples = settled(samples)
    _check_size(randomizations, samples.count())
    perms = samples.select("sample", "group", "ord").crossJoin(samples.sparkSession.range(1, randomizations + 1).withColumnRenamed("id", "perm"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("sample")).cast("binary"))
    by_hash = Window.partitionBy("perm").orderBy(digest, "sample")
    by_place = Window.partitionBy("perm").orderBy("ord")
    places = perms.withColumns({"drawn": F.row_number().over(by_hash), "place": F.row_number().over(by_place)})
    dealt = places.select("perm", F.col("place").alias("drawn"), "group")
    return places.select("perm", "sample", "drawn").join(dealt, ["perm", "drawn"]).select("perm", "sample", "group")


def all_patterns(samples: int, randomizations: int) -> bool:
    """Whether sign flips of so many samples go through all patterns."""
    return randomizations <= 0 or randomizations >= 2 ** (samples // 2)


def paired_labels(samples: DataFrame, randomizations: int, method: str = "swap", seed: int = 123) -> DataFrame:
    """(perm, sample, group) with the labels of neighbouring columns swapped.

    swap: random swaps of each pair; signflip: all 2**pairs patterns, the unchanged one included, if
    ``randomizations`` is 0 or not below their number, else random ones too. ``samples`` has (sample,
    group, ord) with partners as neighbours. More than MOST_LABELS labels are an error.
    """
    if method not in ("swap", "signflip"):
        raise ValueError("paired_method must be 'swap' or 'signflip'")
    samples = settled(samples)
    n = samples.count()
    if n % 2:
        raise ValueError("paired permutation needs an even number of samples in pairs")
    every = method == "signflip" and all_patterns(n, randomizations)
    count = 2 ** (n // 2) if every else randomizations
    _check_size(count, n)
    place = F.row_number().over(Window.orderBy("ord"))
    pairs = samples.select("sample", "group", place.alias("place")).withColumn("pair", F.floor((F.col("place") - 1) / 2).cast("int"))
    other = pairs.select("pair", F.col("place").alias("other"), F.col("group").alias("other_group"))
    both = pairs.join(other, "pair").where("place <> other")
    perms = both.crossJoin(samples.sparkSession.range(count).withColumnRenamed("id", "perm"))
    if every:
        swap = F.expr("getbit(perm, pair)") == 1
    else:
        swap = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("pair").cast("string")).cast("binary")), 1, 1) >= "8"
    return perms.select("perm", "sample", F.when(swap, F.col("other_group")).otherwise(F.col("group")).alias("group"))


def _summary_of(values: Column, method: str) -> Column:
    """Mean or median of an array without missing values; NULL if it is empty."""
    n = F.size(values)
    if method == "mean":
        return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n)
    ordered = F.array_sort(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def permutation_p(values: DataFrame, labels: DataFrame, case: str, control: str, method: str = "mean") -> DataFrame:
    """(gene, raw_p_values): (nulls as large as observed + 1) / (known nulls + 1); 1 without either.

    ``values`` has (gene, sample, group, value), one value of a gene and sample. Each permutation has its
    own pseudocount, half the smallest positive summary among all its genes. The labels, at most
    MOST_LABELS, are broadcast as one row.
    """
    summary(F.lit(0.0), method)
    own = F.struct("sample", F.when(F.col("group") == case, 1).when(F.col("group") == control, 0).otherwise(-1).cast("byte").alias("side"))
    dealt = labels.groupBy("perm").agg(F.sort_array(F.collect_list(own)).alias("own"))
    table = dealt.agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", "own"))), lambda x: x["own"]["side"]).alias("sides"), F.transform(F.first("own"), lambda x: x["sample"]).alias("names"))
    own_values = lambda group: F.transform(F.filter("cells", lambda c: c["group"] == group), lambda c: c["value"])
    seen = F.struct(_summary_of(own_values(case), method).alias("case"), _summary_of(own_values(control), method).alias("control"))
    value = missing_to_null(F.col("value").cast("double"))
    genes = values.withColumn("value", value).groupBy("gene").agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("sample", "group", "value"))).alias("cells"))
    rows = genes.crossJoin(F.broadcast(table)).withColumn("by_name", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["sample"], c["value"]))))
    rows = rows.withColumn("known", F.transform("names", lambda n: F.try_element_at(F.col("by_name"), n)))

    def of(side: int):
        return lambda sides: _summary_of(F.filter(F.zip_with("known", sides, lambda v, s: F.when(s == side, v)), lambda v: v.isNotNull()), method)

    nulls = F.transform(F.coalesce("sides", F.array()), lambda sides: F.struct(of(1)(sides).alias("case"), of(0)(sides).alias("control")))
    found = settled(rows.select("gene", F.concat(F.array(seen), nulls).alias("pairs")))
    positive = lambda c: F.min(F.when(F.col(c) > 0, F.col(c)))
    low = found.select(F.posexplode("pairs").alias("perm", "pair")).select("perm", "pair.case", "pair.control").groupBy("perm").agg(F.coalesce(F.least(positive("case"), positive("control")) / 2, F.lit(1e-6)).alias("pseudo"))
    pseudo = low.agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", "pseudo"))), lambda x: x["pseudo"]).alias("low"))
    lift = lambda v, least: F.when(v <= 0, least).otherwise(v)
    size = lambda pair, least: F.abs(F.log2(F.try_divide(lift(pair["case"], least), lift(pair["control"], least))))
    sizes = found.crossJoin(F.broadcast(pseudo)).select("gene", F.zip_with("pairs", "low", size).alias("sizes"))
    observed, known = F.get("sizes", F.lit(0)), F.filter(F.slice("sizes", F.lit(2), F.greatest(F.size("sizes") - 1, F.lit(0))), lambda x: x.isNotNull())
    parts = sizes.select("gene", observed.alias("seen"), known.alias("nulls"))
    as_large = F.size(F.filter("nulls", lambda x: x >= F.col("seen") * (1 - TOLERANCE)))
    p = F.when(F.col("seen").isNotNull() & (F.size("nulls") > 0), (as_large + 1) / (F.size("nulls") + 1)).otherwise(1.0)
    return parts.select("gene", p.alias("raw_p_values"))
