"""All named queries with their SQL mirrors. Measurements are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.functions.numerics import format_label
from varietas.operators import curves, difference, diversity, experiment, filters, foldchange, interaction, metadata, mixed, padjust, permute, plotdata, ranktests, signflip
from varietas.operators.settled import settled
from varietas.sources import assembly, tables

from . import fixtures, sql
from .sql import adjusted, exact_p, first_component, fold_change, grouped, hommel, mixed_ratio, normal_p, r, rank_sums, t_p, t_p_any, values, welch, with_

Query = Callable[[SparkSession, str], DataFrame]

#: Orders of the multi-order queries.
ORDERS = (0.5, 1.0, 1.5, 2.0, 3.0)

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if oracle is not None:
            _SQL[name or f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(c: str | Column, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, sql.ROUND) + F.lit(0.0)).alias(name or c)


def _cells(df: DataFrame) -> DataFrame:
    return df.select("gene", "sample", "q", rounded("value"))


CELLS = f"SELECT gene, sample, q, {r('value')} FROM vals"


def _grouped(counts: DataFrame, q=2.0, **options) -> tuple[DataFrame, DataFrame]:
    """Values (gene, sample, q, value, group), rounded so that ties agree in both engines, and the samples."""
    counts = settled(counts)
    samples = settled(fixtures.samples_of(counts))
    rows = diversity.diversity(counts, q, samples=samples, **options).withColumn("value", F.round("value", 9))
    return rows.join(samples.select("sample", "group"), "sample"), samples


# Diversity ------------------------------------------------------------------------------------


@query(with_(fixtures.SQL["retail"]) + f"SELECT gene, tx, sample, {r('cnt / sum(cnt) OVER (PARTITION BY gene, sample)', 'p')} FROM retail")
def proportions(spark, sf_dir):
    return diversity.proportions(fixtures.retail(spark, sf_dir)).select("gene", "tx", "sample", rounded("p"))


@query(with_(*values((2.0,), "retail")) + CELLS)
def tsallis_q2_norm(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.retail(spark, sf_dir), 2.0))


@query(with_(*values((0.5,), "retail", norm=False)) + CELLS)
def tsallis_q05_raw(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.retail(spark, sf_dir), 0.5, norm=False))


@query(with_(*values((1.0,), "retail")) + CELLS)
def shannon_norm(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.retail(spark, sf_dir), 1.0))


@query(with_(*values((1.0,), "retail", norm=False, base=2.0)) + CELLS)
def shannon_base2(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.retail(spark, sf_dir), 1.0, norm=False, log_base=2.0))


@query(with_(*values(ORDERS, "retail")) + CELLS)
def tsallis_multi_q(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.retail(spark, sf_dir), ORDERS))


@query(with_(*values(ORDERS, "retail", what="D")) + CELLS)
def hill_multi_q(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.retail(spark, sf_dir), ORDERS, what="D"))


@query(with_(*values((0.5, 2.0), "retail", norm=False)) + f"SELECT gene, sample, {r('max(value) FILTER (q = 0.5)', 's_half')}, {r('max(value) FILTER (q = 2.0)', 's_two')} FROM vals GROUP BY gene, sample")
def tsallis_of_arrays(spark, sf_dir):
    arrays = fixtures.retail(spark, sf_dir).groupBy("gene", "sample").agg(F.collect_list("count").alias("x"))
    s = diversity.tsallis(F.col("x"), (0.5, 2.0), norm=False)
    found = settled(arrays.select("gene", "sample", rounded(s["q=0.5"], "s_half"), rounded(s["q=2"], "s_two")))
    return diversity.complete_genes(found.where("gene IS NOT NULL"), found.select("sample").dropna().distinct(), 1, ("s_half", "s_two"))


@query(with_(*values((1.0, 2.0), "retail", out="ent"), *values((1.0, 2.0), "retail", what="D", out="hil")[1:]) + f"SELECT gene, sample, q, {r('e.value', 'entropy')}, {r('h.value', 'hill')} FROM ent e JOIN hil h USING (gene, sample, q)")
def both_measures(spark, sf_dir):
    found = diversity.diversity(fixtures.retail(spark, sf_dir), (1.0, 2.0), what="both")
    return found.select("gene", "sample", "q", rounded("entropy"), rounded("hill"))


@query(with_(*values((2.0,), "event_pairs")) + CELLS)
def diversity_finite_filter(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.event_pairs(spark, sf_dir), 2.0))


@query(with_(*values((2.0,), "event_pairs", complete=False)) + CELLS)
def diversity_all_cells(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.event_pairs(spark, sf_dir), 2.0, complete=False))


@query(with_(*values((2.0,), "part_mix")) + CELLS)
def single_tx_excluded(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.part_mix(spark, sf_dir), 2.0))


@query(with_(*values((2.0,), "part_mix", norm=False)) + CELLS)
def single_tx_raw_kept(spark, sf_dir):
    return _cells(diversity.diversity(fixtures.part_mix(spark, sf_dir), 2.0, norm=False))


def _experiment(spark, sf_dir) -> experiment.Experiment:
    counts = fixtures.retail(spark, sf_dir)
    mapping = counts.select(F.col("tx").alias("Transcript"), F.col("gene").alias("Gen")).distinct()
    return experiment.build_experiment(mapping, counts.select(F.col("tx").alias("feature"), "sample", F.col("count").alias("value")))


@query(with_(*values((1.0, 2.0), "retail")) + f"SELECT gene AS feature, sample || '_q=' || CASE WHEN q = 1 THEN '1' ELSE '2' END AS col, {r('value')} FROM vals")
def diversity_of_experiment(spark, sf_dir):
    found = experiment.calculate_diversity(_experiment(spark, sf_dir), q=(1.0, 2.0))
    return found.assay("diversity").select("feature", F.col("sample").alias("col"), rounded("value"))


@query(with_(*values((1.0, 2.0), "retail")) + "SELECT DISTINCT sample, q, sample || '_q=' || CASE WHEN q = 1 THEN '1' ELSE '2' END AS name FROM vals")
def column_names(spark, sf_dir):
    found = experiment.calculate_diversity(_experiment(spark, sf_dir), q=(1.0, 2.0)).assay("diversity").select("sample").distinct()
    return found.select(diversity.decode_sample(F.col("sample")).alias("sample"), diversity.decode_order(F.col("sample")).alias("q"), F.col("sample").alias("name"))


@query("SELECT DISTINCT p_type, upper(left(t, 1)) || lower(substr(t, 2)) AS label FROM (SELECT p_type, trim(regexp_replace(replace('__' || p_type || '_kind  ', '_', ' '), '\\s+', ' ', 'g')) AS t FROM part)")
def formatted_labels(spark, sf_dir):
    kinds = fixtures.read(spark, sf_dir, "part").select("p_type").distinct()
    return kinds.select("p_type", format_label(F.concat(F.lit("__"), "p_type", F.lit("_kind  "))).alias("label"))


# Filters, mappings, reshaping -------------------------------------------------------------------

_EXPRESSED = "SELECT tx FROM retail GROUP BY tx HAVING count(*) FILTER (cnt > {c}) >= least({k}, (SELECT count(DISTINCT sample) FROM retail))"


@query(with_(fixtures.SQL["retail"]) + _EXPRESSED.format(c=30, k=5))
def expr_filter(spark, sf_dir):
    return filters.expressed(fixtures.retail(spark, sf_dir), 30, 5)


@query(with_(fixtures.SQL["part_mix"]) + _EXPRESSED.format(c=5, k=1000).replace("retail", "part_mix"))
def expr_filter_capped(spark, sf_dir):
    return filters.expressed(fixtures.part_mix(spark, sf_dir), 5, 1000)


@query(with_(fixtures.SQL["retail"], f"kept AS ({_EXPRESSED.format(c=30, k=5)})") + "SELECT (SELECT count(*) FROM retail SEMI JOIN kept USING (tx)) AS cells, (SELECT count(DISTINCT tx) FROM retail SEMI JOIN kept USING (tx)) AS features, (SELECT count(DISTINCT gene) FROM retail SEMI JOIN kept USING (tx)) AS genes")
def filtered_experiment(spark, sf_dir):
    x = filters.filter_experiment(_experiment(spark, sf_dir), 30, 5)
    mapping = x.metadata["tx2gene"]
    return x.assay("counts").agg(F.count("*").alias("cells"), F.count_distinct("feature").alias("features")).crossJoin(mapping.agg(F.count_distinct("gene").alias("genes")))


_TOTALS = "tot AS (SELECT gene, sum(cnt) AS total FROM retail GROUP BY gene), big AS (SELECT gene FROM tot ORDER BY total DESC, gene LIMIT 5)"


@query(with_(fixtures.SQL["retail"], _TOTALS) + "(SELECT gene FROM big) UNION ALL (SELECT gene FROM tot WHERE gene NOT IN (SELECT gene FROM big) ORDER BY md5('123:' || gene), gene LIMIT 7)")
def chosen_genes(spark, sf_dir):
    return filters.choose_genes(fixtures.retail(spark, sf_dir), 5, 7)


_MAP = "m AS (SELECT p_partkey AS k, min(p_brand) AS gene FROM part WHERE p_size <= 25 GROUP BY 1)"


def _mapping(spark, sf_dir) -> DataFrame:
    part = fixtures.read(spark, sf_dir, "part").where("p_size <= 25")
    return part.select(F.col("p_partkey").cast("string").alias("tx"), F.col("p_brand").alias("gene"), F.col("p_partkey").alias("ord"))


def _line_counts(spark, sf_dir) -> DataFrame:
    lines = fixtures.read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").cast("string").alias("feature"), F.col("l_returnflag").alias("sample")).agg(F.sum("l_quantity").alias("value"))


@query(with_(_MAP) + "SELECT CAST(l_partkey AS VARCHAR) AS tx, l_returnflag AS sample, gene, sum(l_quantity) AS cnt FROM lineitem LEFT JOIN m ON k = l_partkey GROUP BY ALL")
def tx2gene_left_join_first(spark, sf_dir):
    return experiment.with_genes(_line_counts(spark, sf_dir), _mapping(spark, sf_dir)).select("tx", "sample", "gene", F.col("count").alias("cnt"))


@query("SELECT l_partkey, sum(l_quantity) AS cnt FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def semi_subset(spark, sf_dir):
    lines = fixtures.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("feature"), "l_partkey", "l_quantity")
    return experiment.mapped_rows(lines, _mapping(spark, sf_dir)).groupBy("l_partkey").agg(F.sum("l_quantity").alias("cnt"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def anti_unmatched(spark, sf_dir):
    lines = fixtures.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("feature"))
    found = experiment.unmapped_features(lines, _mapping(spark, sf_dir))
    return found.select(F.col("feature").cast(dict(fixtures.read(spark, sf_dir, "lineitem").dtypes)["l_partkey"]).alias("l_partkey"))


_FLAGS = {"A": "_N", "N": "_T", "R": ""}


@query(with_(_MAP) + "SELECT 'P' || l_partkey AS feature, any_value(gene) AS gene, " + ", ".join(f"sum(l_quantity) FILTER (l_returnflag = '{f}') AS \"{f}{s}\"" for f, s in _FLAGS.items()) + " FROM lineitem LEFT JOIN m ON k = l_partkey GROUP BY l_partkey")
def matrix_of_samples(spark, sf_dir):
    rows = _line_counts(spark, sf_dir).withColumn("feature", F.concat(F.lit("P"), "feature", F.lit(".1|old")))
    suffixes = spark.createDataFrame([(f, s) for f, s in _FLAGS.items() if s], "sample string, suffix string")
    mapping = _mapping(spark, sf_dir).withColumn("tx", F.concat(F.lit("P"), "tx"))
    return assembly.count_matrix(rows, mapping, suffixes)


@query("SELECT CAST(l_partkey AS VARCHAR) AS feature, count(DISTINCT l_returnflag) AS rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def unmapped_features(spark, sf_dir):
    return experiment.unmapped_features(_line_counts(spark, sf_dir), _mapping(spark, sf_dir))


@query(with_(fixtures.SQL["retail"]) + "SELECT gene, sample, sum(cnt) AS cnt FROM retail GROUP BY gene, sample")
def gene_rowsum(spark, sf_dir):
    return plotdata.gene_counts(fixtures.retail(spark, sf_dir)).withColumnRenamed("count", "cnt")


@query(with_(fixtures.SQL["part_mix"]) + "SELECT gene, " + ", ".join(f"sum(cnt) FILTER (sample = 'Y{y}') AS \"Y{y}.0\"" for y in range(1995, 2002)) + " FROM part_mix GROUP BY gene")
def wide_matrix(spark, sf_dir):
    counts = plotdata.gene_counts(fixtures.part_mix(spark, sf_dir))
    return experiment.to_wide(counts.withColumn("sample", F.concat("sample", F.lit(".0"))), "gene", "sample", "count", [f"Y{y}.0" for y in range(1995, 2002)])


@query(with_(fixtures.SQL["part_mix"]) + ", ".join(["SELECT g.gene AS feature", "y.sample", "sum(cnt) AS value"]) + " FROM (SELECT DISTINCT gene FROM part_mix) g CROSS JOIN (SELECT 'Y' || unnest(range(1995, 2002)) AS sample) y LEFT JOIN part_mix p ON p.gene = g.gene AND p.sample = y.sample GROUP BY ALL")
def long_from_wide(spark, sf_dir):
    counts = plotdata.gene_counts(fixtures.part_mix(spark, sf_dir))
    return experiment.from_wide(experiment.to_wide(counts, "gene", "sample", "count", [f"Y{y}" for y in range(1995, 2002)]), "gene")


@query("SELECT r_regionkey AS ord, 'P' || row_number() OVER (ORDER BY r_name DESC) AS feature FROM region WHERE r_regionkey = r_regionkey ORDER BY 1")
def positional_ids(spark, sf_dir):
    region = fixtures.read(spark, sf_dir, "region")
    counts = region.select(F.lit("").alias("feature"), F.lit("s").alias("sample"), F.lit(1.0).alias("value"), F.col("r_regionkey").alias("ord"))
    from pyspark.sql import Window

    ids = region.select(F.concat(F.lit("P"), F.row_number().over(Window.orderBy(F.desc("r_name"))).cast("string")).alias("Transcript"), F.row_number().over(Window.orderBy(F.col("r_regionkey"))).alias("ord"))
    return experiment.map_transcripts(counts.withColumn("feature", F.col("ord").cast("string")), ids).select(F.col("ord"), "feature")


# Metadata ---------------------------------------------------------------------------------------


def _columns(counts: DataFrame) -> DataFrame:
    orders = counts.sparkSession.createDataFrame([(1.0,), (2.0,)], "q double")
    return counts.select("sample").distinct().crossJoin(orders).withColumn("ord", F.lit(0))


def _coldata(counts: DataFrame) -> DataFrame:
    return fixtures.samples_of(counts).select(F.col("sample").alias("Sample"), F.col("group").alias("Condition"), (-F.col("ord")).alias("ord"))


_SAMPLES = "s AS (SELECT sample, grp, regexp_replace(sample, '_[^_]*$', '') AS base, -row_number() OVER (ORDER BY sample) AS ord FROM (SELECT DISTINCT sample, grp FROM {of}))"


@query(with_(fixtures.SQL["event_pairs"], _SAMPLES.format(of="event_pairs")) + "SELECT sample, q, grp AS sample_type, base AS sample_base, row_number() OVER (ORDER BY bo, base, grp, ord, q) AS col_ord FROM (SELECT *, min(ord) OVER (PARTITION BY base) AS bo FROM s, (VALUES (1.0), (2.0)) o(q))")
def map_metadata_paired(spark, sf_dir):
    counts = fixtures.event_pairs(spark, sf_dir)
    return metadata.map_metadata(_columns(counts), _coldata(counts), paired=True)


@query(with_(fixtures.SQL["retail"], _SAMPLES.format(of="retail")) + "SELECT sample, q, grp AS sample_type, base AS sample_base, row_number() OVER (ORDER BY ord, q) AS col_ord FROM s, (VALUES (1.0), (2.0)) o(q)")
def map_metadata_order(spark, sf_dir):
    counts = fixtures.retail(spark, sf_dir)
    return metadata.map_metadata(_columns(counts), _coldata(counts))


@query(with_(fixtures.SQL["retail"], _SAMPLES.format(of="retail")) + "SELECT base FROM s GROUP BY base HAVING count(DISTINCT grp) < (SELECT count(DISTINCT grp) FROM s)")
def pair_validation(spark, sf_dir):
    return metadata.unpaired_bases(metadata.sample_groups(_coldata(fixtures.retail(spark, sf_dir))))


@query(with_(fixtures.SQL["retail"]) + "SELECT grp, count(DISTINCT sample) AS n FROM retail GROUP BY grp")
def samples_per_group(spark, sf_dir):
    return fixtures.samples_of(fixtures.retail(spark, sf_dir)).groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("n"))


@query(with_(*values((1.0, 2.0), "event_pairs"), *grouped("event_pairs")) + f"SELECT gene, sample, q, grp, {r('value')} FROM v")
def long_with_groups(spark, sf_dir):
    counts = fixtures.event_pairs(spark, sf_dir)
    rows = metadata.long_values(diversity.diversity(counts, (1.0, 2.0)).withColumn("value", F.round("value", 9)), metadata.sample_groups(_coldata(counts)))
    return rows.select("gene", "sample", "q", F.col("group").alias("grp"), rounded("value"))


@query("SELECT c AS column_name, n AS levels FROM (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS c, unnest([count(DISTINCT o_orderstatus), count(DISTINCT o_orderpriority), count(DISTINCT o_custkey)]) AS n FROM orders) ORDER BY CASE WHEN n = 2 THEN 0 WHEN n > 1 THEN n ELSE 1e18 END LIMIT 1")
def inferred_group_column(spark, sf_dir):
    """The column of orders that serves as groups, as no known name is among them, and its levels."""
    table = fixtures.read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    found = metadata.infer_group_column(table)
    return table.agg(F.lit(found).alias("column_name"), F.count_distinct(found).alias("levels"))


@query("SELECT wanted, CASE WHEN wanted IN (SELECT c_mktsegment FROM customer) THEN wanted ELSE (SELECT min(c_mktsegment) FROM customer) END AS control FROM (VALUES ('MACHINERY'), ('nothing')) w(wanted)")
def chosen_controls(spark, sf_dir):
    """The control that a wish for a segment of customers gives, and the first one where there is no such segment."""
    groups = fixtures.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sample_type"))
    return spark.createDataFrame([(w, metadata.control_group(groups, w)) for w in ("MACHINERY", "nothing")], "wanted string, control string")


# Fold changes -----------------------------------------------------------------------------------

_FC = f"SELECT gene, {r('c')}, {r('k')}, {r('difference')}, {r('log2_fold_change')} FROM fc"


def _fc(df: DataFrame) -> DataFrame:
    return df.select("gene", rounded("case", "c"), rounded("control", "k"), rounded("difference"), rounded("log2_fold_change"))


@query(with_(*values((2.0,), "retail"), *grouped("retail"), *fold_change("odd", "even")) + _FC)
def group_mean_fc(spark, sf_dir):
    return _fc(foldchange.fold_change(_grouped(fixtures.retail(spark, sf_dir))[0], "odd", "even", "mean"))


@query(with_(*values((2.0,), "retail"), *grouped("retail"), *fold_change("odd", "even", "median")) + _FC)
def group_median_fc(spark, sf_dir):
    return _fc(foldchange.fold_change(_grouped(fixtures.retail(spark, sf_dir))[0], "odd", "even", "median"))


_VECTORS = "v AS (SELECT vec_id AS gene, CAST(unnest(embedding) AS DOUBLE) AS value, CASE WHEN unnest(range(1, len(embedding) + 1)) % 2 = 0 THEN 'b' ELSE 'a' END AS grp FROM embeddings)"


def _vectors(spark, sf_dir) -> DataFrame:
    rows = fixtures.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene"), F.posexplode("embedding").alias("dim", "value"))
    return rows.select("gene", F.col("value").cast("double").alias("value"), F.when((F.col("dim") + 1) % 2 == 0, "b").otherwise("a").alias("group"))


@query(with_(_VECTORS, *fold_change("b", "a")) + _FC)
def fc_auto_pseudocount(spark, sf_dir):
    return _fc(foldchange.fold_change(_vectors(spark, sf_dir), "b", "a"))


@query(with_(_VECTORS, *fold_change("b", "a", pseudocount=0.001)) + _FC)
def fc_explicit_pseudocount(spark, sf_dir):
    return _fc(foldchange.fold_change(_vectors(spark, sf_dir), "b", "a", pseudocount=0.001))


# Rank tests and corrections ---------------------------------------------------------------------


@query(with_(*values((2.0,), "part_mix"), *grouped("part_mix")) + "SELECT gene, count(value) FILTER (grp = 'early') >= 3 AND count(value) FILTER (grp = 'late') >= 3 AND count(value) >= 8 AS rank_test, count(value) >= 5 AS shuffle_test FROM v GROUP BY gene")
def sample_size_gate(spark, sf_dir):
    rows, _ = _grouped(fixtures.part_mix(spark, sf_dir))
    both = filters.sample_size_gate(filters.sample_size_gate(rows, ("early", "late"), "wilcoxon").withColumnRenamed("tested", "rank_test"), ("early", "late"), "shuffle")
    return both.select("gene", "rank_test", F.col("tested").alias("shuffle_test")).distinct()


@query(with_(*values((2.0,), "retail"), *grouped("retail"), *rank_sums("even", "odd")) + f"SELECT gene, n1, n2, u, tie_sum, {r('z')} FROM rs")
def wilcoxon_stats(spark, sf_dir):
    return ranktests.rank_sum_statistics(_grouped(fixtures.retail(spark, sf_dir))[0], "even", "odd").select("gene", "n1", "n2", "u", "tie_sum", rounded("z"))


@query(with_(*values((2.0,), "retail"), *grouped("retail"), *rank_sums("even", "odd")) + f"SELECT gene, {r(normal_p('z'), 'p')} FROM rs")
def wilcoxon_p(spark, sf_dir):
    found = ranktests.wilcoxon(_grouped(fixtures.retail(spark, sf_dir))[0], "even", "odd")
    return found.select("gene", rounded("raw_p_values", "p"))


@query(with_(_VECTORS, *rank_sums("a", "b")) + f"SELECT gene, {r(normal_p('z'), 'p')} FROM rs")
def wilcoxon_p_vectors(spark, sf_dir):
    return ranktests.wilcoxon(_vectors(spark, sf_dir), "a", "b").select("gene", rounded("raw_p_values", "p"))


_PAIRED = [
    "pairs AS (SELECT gene, regexp_replace(sample, '_[^_]*$', '') AS base, max(value) FILTER (grp = 'N') - max(value) FILTER (grp = 'T') AS d FROM v GROUP BY ALL)",
    "pr AS (SELECT gene, d, rank() OVER (PARTITION BY gene ORDER BY abs(d)) + (count(*) OVER (PARTITION BY gene, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, abs(d)) AS t FROM pairs WHERE d IS NOT NULL AND d <> 0)",
    "ps AS (SELECT gene, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS vv, sum(t * t - 1) AS tie_sum FROM pr GROUP BY gene)",
    "pz AS (SELECT gene, n, vv, CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48 > 0 THEN (vv - n * (n + 1) / 4 - 0.5 * sign(vv - n * (n + 1) / 4)) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48) END AS z FROM ps)",
]


def _with_pairs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pair", diversity.sample_base(F.col("sample")))


@query(with_(*values((2.0,), "event_pairs"), *grouped("event_pairs"), *_PAIRED) + f"SELECT gene, {r(normal_p('z'), 'p')} FROM pz")
def wilcoxon_paired_p(spark, sf_dir):
    rows = _with_pairs(_grouped(fixtures.event_pairs(spark, sf_dir))[0])
    return ranktests.wilcoxon(rows, "N", "T", paired=True).select("gene", rounded("raw_p_values", "p"))


_RANKED = "ranked AS (SELECT gene, n1 + n2 AS n, n1 AS k, round(u + n1 * (n1 + 1) / 2) AS s, tie_sum = 0 AND n1 > 0 AND n2 > 0 AS fair FROM rs)"
_SIGNED = "ranked AS (SELECT gene, coalesce(n, 0) AS n, 0 AS k, round(coalesce(vv, 0)) AS s, coalesce(n, 0) > 0 AND coalesce(tie_sum, 0) = 0 AND zeros = 0 AS fair FROM (SELECT gene, count(*) FILTER (d = 0) AS zeros FROM pairs GROUP BY gene) LEFT JOIN ps USING (gene))"


@query(with_(*values((2.0,), "retail"), *grouped("retail"), *rank_sums("even", "odd"), _RANKED, *exact_p("rank sum", "ranked")) + f"SELECT gene, {r('p')} FROM ex")
def wilcoxon_exact_p(spark, sf_dir):
    return ranktests.wilcoxon(_grouped(fixtures.retail(spark, sf_dir))[0], "even", "odd", exact=True).select("gene", rounded("raw_p_values", "p"))


@query(with_(*values((2.0,), "event_pairs"), *grouped("event_pairs"), *_PAIRED, _SIGNED, *exact_p("signed", "ranked")) + f"SELECT gene, {r('p')} FROM ex")
def signed_rank_exact_p(spark, sf_dir):
    rows = _with_pairs(_grouped(fixtures.event_pairs(spark, sf_dir))[0])
    return ranktests.wilcoxon(rows, "N", "T", paired=True, exact=True).select("gene", rounded("raw_p_values", "p"))


_P = [_VECTORS, *rank_sums("a", "b"), f"ps AS (SELECT gene, {normal_p('z')} AS p FROM rs)"]


def _adjusted(method: str) -> Query:
    def run(spark, sf_dir):
        found = ranktests.wilcoxon(_vectors(spark, sf_dir), "a", "b")
        return padjust.adjust(found, method).select("gene", rounded("raw_p_values", "p"), rounded("adjusted_p_values", "a"))

    return run


for _method in ("BH", "BY", "holm", "hochberg", "bonferroni"):
    query(with_(*_P, *adjusted(_method, "ps")) + f"SELECT gene, {r('p')}, {r('a')} FROM adj", f"padjust_{_method.lower()}")(_adjusted(_method))
query(with_(*_P, *hommel("ps")) + f"SELECT gene, {r('p')}, {r('a')} FROM adj", "padjust_hommel")(_adjusted("hommel"))


# Permutation tests ------------------------------------------------------------------------------


def _permuted(case: str, control: str, labels: str) -> list[str]:
    """CTE perm_p (gene, p) from v and the CTE text of ``labels`` (perm, sample, grp)."""
    return [
        *fold_change(case, control),
        labels,
        "pv AS (SELECT perm, gene, value, l.grp FROM v JOIN labels l USING (sample))",
        *fold_change(case, control, source="pv", out="pf", by="perm"),
        "perm_p AS (SELECT f.gene, CASE WHEN f.log2_fold_change IS NULL OR count(p.log2_fold_change) = 0 THEN 1.0 ELSE (count(*) FILTER (abs(p.log2_fold_change) >= abs(f.log2_fold_change) * (1 - 1e-9)) + 1) / (count(p.log2_fold_change) + 1) END AS p FROM fc f LEFT JOIN pf p ON p.gene = f.gene GROUP BY f.gene, f.log2_fold_change)",
    ]


_PLACED = "placed AS (SELECT *, CAST(floor((ord - 1) / 2) AS INT) AS pair FROM samples)"
_SWAP = "labels AS (SELECT perm, a.sample, CASE WHEN {swap} THEN b.grp ELSE a.grp END AS grp FROM placed a JOIN placed b ON a.pair = b.pair AND a.ord <> b.ord CROSS JOIN (SELECT unnest(range(0, {n})) AS perm))"
_SHUFFLE = """labels AS (SELECT x.perm, x.sample, y.grp FROM
    (SELECT perm, sample, row_number() OVER (PARTITION BY perm ORDER BY md5('123:' || perm || ':' || sample), sample) AS drawn FROM samples, (SELECT unnest(range(1, {n} + 1)) AS perm)) x
    JOIN samples y ON y.ord = x.drawn)"""


@query(with_(*values((2.0,), "event_pairs_six"), *grouped("event_pairs_six"), _PLACED, *_permuted("T", "N", _SWAP.format(swap="(perm >> a.pair) & 1 = 1", n=64))) + f"SELECT gene, {r('p')} FROM perm_p")
def perm_signflip_exact(spark, sf_dir):
    rows, samples = _grouped(fixtures.event_pairs(spark, sf_dir, 6))
    return permute.permutation_p(rows, permute.paired_labels(samples, 0, "signflip"), "T", "N").select("gene", rounded("raw_p_values", "p"))


@query(with_(*values((2.0,), "event_pairs_ten"), *grouped("event_pairs_ten"), _PLACED, *_permuted("T", "N", _SWAP.format(swap="(perm >> a.pair) & 1 = 1", n=1024))) + f"SELECT gene, {r('p')} FROM perm_p")
def perm_signflip_ranges(spark, sf_dir):
    rows, samples = _grouped(fixtures.event_pairs(spark, sf_dir, 10))
    return signflip.signflip_p(rows, samples, "T", "N").select("gene", rounded("raw_p_values", "p"))


@query(with_(*values((2.0,), "event_pairs"), *grouped("event_pairs"), _PLACED, *_permuted("T", "N", _SWAP.format(swap="md5('123:' || perm || ':' || a.pair)[1] >= '8'", n=100))) + f"SELECT gene, {r('p')} FROM perm_p")
def perm_swap_sampled(spark, sf_dir):
    rows, samples = _grouped(fixtures.event_pairs(spark, sf_dir))
    return permute.permutation_p(rows, permute.paired_labels(samples, 100, "swap"), "T", "N").select("gene", rounded("raw_p_values", "p"))


@query(with_(*values((2.0,), "retail"), *grouped("retail"), *_permuted("odd", "even", _SHUFFLE.format(n=100))) + f"SELECT gene, {r('p')} FROM perm_p")
def perm_shuffle(spark, sf_dir):
    rows, samples = _grouped(fixtures.retail(spark, sf_dir))
    return permute.permutation_p(rows, permute.shuffled_labels(samples, 100), "odd", "even").select("gene", rounded("raw_p_values", "p"))


_DIFFERENCE = f"SELECT gene AS genes, {r('c', 'case_mean')}, {r('k', 'control_mean')}, {r('difference', 'mean_difference')}, {r('log2_fold_change')}, {r('p', 'raw_p_values')}, {r('a', 'adjusted_p_values')}, 1 AS part FROM fc JOIN adj USING (gene)"


def _difference(df: DataFrame, case: str, control: str) -> DataFrame:
    names = {f"{case}_mean": "case_mean", f"{control}_mean": "control_mean"}
    measures = [c for c in df.columns if c not in ("genes", "part")]
    return df.select("genes", *(rounded(c, names.get(c, c)) for c in measures), "part")


@query(with_(*values((2.0,), "retail"), *grouped("retail"), *fold_change("odd", "even"), *rank_sums("even", "odd"), f"tested AS (SELECT gene, {normal_p('z')} AS p FROM rs)", *adjusted("BH", "tested")) + _DIFFERENCE)
def difference_wilcoxon(spark, sf_dir):
    rows, samples = _grouped(fixtures.retail(spark, sf_dir))
    return _difference(difference.calculate_difference(rows.drop("group"), samples, "even"), "odd", "even")


@query(with_(*values((2.0,), "part_mix"), *grouped("part_mix"), *_permuted("late", "early", _SHUFFLE.format(n=100)), "tested AS (SELECT gene, p FROM perm_p)", *adjusted("BH", "tested")) + _DIFFERENCE)
def difference_shuffle(spark, sf_dir):
    rows, samples = _grouped(fixtures.part_mix(spark, sf_dir))
    return _difference(difference.calculate_difference(rows.drop("group"), samples, "early", test="shuffle"), "late", "early")


@query(with_(*values((2.0,), "part_mix"), *grouped("part_mix"), *fold_change("late", "early")) + f"SELECT gene AS genes, {r('c', 'case_mean')}, {r('k', 'control_mean')}, {r('difference', 'mean_difference')}, {r('log2_fold_change')}, CAST(NULL AS DOUBLE) AS raw_p_values, CAST(NULL AS DOUBLE) AS adjusted_p_values, 2 AS part FROM fc")
def difference_low_samples(spark, sf_dir):
    rows, samples = _grouped(fixtures.part_mix(spark, sf_dir))
    return _difference(difference.calculate_difference(rows.drop("group"), samples, "early"), "late", "early")


# Interaction of order and group -----------------------------------------------------------------

GRID = tuple(round(0.1 + 0.1 * i, 1) for i in range(20))
_LINEAR = [
    "parts AS (SELECT gene, grp, regr_count(value, q) AS n, regr_sxx(value, q) AS sxx, regr_sxy(value, q) AS sxy, regr_syy(value, q) AS syy FROM v GROUP BY gene, grp)",
    "fits AS (SELECT gene, sum(syy - sxy * sxy / sxx) / (sum(n) - 4) AS s2, sum(n) - 4 AS df, sum(CASE WHEN grp = '{b}' THEN sxy / sxx ELSE -sxy / sxx END) AS slope, sum(1 / sxx) AS spread FROM parts GROUP BY gene)",
    "tests AS (SELECT gene, slope / sqrt(s2 * spread) AS t, CAST(df AS BIGINT) AS df FROM fits)",
]


@query(with_(*values(GRID, "retail"), *grouped("retail"), *(x.format(b="odd") for x in _LINEAR), f"ps AS (SELECT gene, t, {t_p('t', 'df')} AS p FROM tests)", *adjusted("BH", "ps")) + f"SELECT gene, {r('p', 'p_interaction')}, {r('a', 'adj_p_interaction')} FROM adj")
def lm_interaction(spark, sf_dir):
    rows, _ = _grouped(fixtures.retail(spark, sf_dir), GRID)
    found = interaction.calculate_interaction(rows, "linear")
    return found.select("gene", rounded("p_interaction"), rounded("adj_p_interaction"))


def _fits(method: str) -> Query:
    def run(spark, sf_dir):
        return interaction.calculate_interaction(_grouped(fixtures.retail(spark, sf_dir), GRID)[0], method)

    return run


@query(with_(*values(GRID, "retail"), *grouped("retail"), *(x.format(b="odd") for x in _LINEAR), f"ps AS (SELECT gene, {t_p('t', 'df')} AS p FROM tests)", *adjusted("BH", "ps")) + "SELECT gene, row_number() OVER (ORDER BY round(a, 9), round(p, 9), gene) AS place FROM adj")
def interaction_order(spark, sf_dir):
    """The place of each gene in the interaction table as it is returned."""
    rows, _ = _grouped(fixtures.retail(spark, sf_dir), GRID)
    table = interaction.calculate_interaction(rows, "linear").withColumns({c: F.round(c, 9) for c in ("adj_p_interaction", "p_interaction")})
    return interaction.in_order(table).select("gene", "place")


@query(with_(*values(GRID, "event_pairs", complete=False), *grouped("event_pairs")) + f"SELECT gene, q, {r('avg(value)', 'filled')}, count(*) FILTER (value IS NULL) AS gaps FROM v GROUP BY gene, q HAVING count(value) > 0")
def filled_gaps(spark, sf_dir):
    """What a missing point of a gene's curves is filled with at each order, and how often."""
    rows, _ = _grouped(fixtures.event_pairs(spark, sf_dir), GRID, complete=False)
    return curves.order_means(rows).select("gene", "q", rounded("mean", "filled"), "gaps")


for _method in ("lmm", "gam"):
    query(None, f"{_method}_interaction")(_fits(_method))


@query(with_(*values(GRID, "retail"), *grouped("retail"), *first_component(), *welch("odd", "even"), f"ps AS (SELECT gene, {t_p_any('t', 'df')} AS p FROM wt)", *adjusted("BH", "ps")) + f"SELECT gene, {r('p', 'p_interaction')}, {r('a', 'adj_p_interaction')} FROM adj")
def fpca_interaction(spark, sf_dir):
    return _fits("fpca")(spark, sf_dir).select("gene", rounded("p_interaction"), rounded("adj_p_interaction"))


#: Ratios of standard deviations that the mirrored mixed fits choose from.
THETAS = tuple(round(0.05 * 1.3**i, 4) for i in range(24))


@query(with_(*values(GRID, "retail"), *grouped("retail"), *mixed_ratio(THETAS), f"ps AS (SELECT gene, {normal_p('z')} AS p FROM lr)", *adjusted("BH", "ps")) + f"SELECT gene, {r('p', 'p_lrt')}, {r('a', 'adj_p_lrt')} FROM adj")
def lmm_lrt_on_grid(spark, sf_dir):
    rows, _ = _grouped(fixtures.retail(spark, sf_dir), GRID)
    fits = mixed.mixed_interaction(rows.withColumn("subject", F.col("sample")), pvalue="lrt", thetas=THETAS)
    return padjust.adjust(fits, "BH", "p_lrt", "adj_p_lrt").select("gene", rounded("p_lrt"), rounded("adj_p_lrt"))


@query()
def lmm_fit_summary(spark, sf_dir):
    return interaction.fit_summary(_fits("lmm")(spark, sf_dir))


# Plot frames ------------------------------------------------------------------------------------

_CURVE = "SELECT {keys}, {m}, {i}, {lo}, {hi} FROM (SELECT {keys}, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM {of} GROUP BY {keys})"
_CURVE_OF = lambda keys, of: _CURVE.format(keys=keys, of=of, m=r("m", "median"), i=r("i", "iqr"), lo=r("m - i / 2", "low"), hi=r("m + i / 2", "high"))


@query(with_(*values(ORDERS, "retail"), *grouped("retail")) + _CURVE_OF("grp, q", "v"))
def q_curve(spark, sf_dir):
    found = plotdata.q_curve(_grouped(fixtures.retail(spark, sf_dir), ORDERS)[0])
    return found.select(F.col("group").alias("grp"), "q", *(rounded(c) for c in ("median", "iqr", "low", "high")))


@query(with_(*values(ORDERS, "retail"), *grouped("retail")) + _CURVE_OF("gene, grp, q", "v WHERE gene IN ('Brand#11', 'Brand#23')"))
def gene_profile(spark, sf_dir):
    found = plotdata.gene_profile(_grouped(fixtures.retail(spark, sf_dir), ORDERS)[0], ["Brand#11", "Brand#23"])
    return found.select("gene", F.col("group").alias("grp"), "q", *(rounded(c) for c in ("median", "iqr", "low", "high")))


@query(with_(*values((2.0,), "retail"), *grouped("retail")) + f"SELECT grp, gene, {r('avg(value)', 'mean')} FROM v GROUP BY grp, gene")
def mean_violin(spark, sf_dir):
    return plotdata.mean_by_group(_grouped(fixtures.retail(spark, sf_dir))[0]).select(F.col("group").alias("grp"), "gene", rounded("mean"))


@query(with_(*values(ORDERS, "event_pairs"), *grouped("event_pairs")) + f"SELECT q, grp, count(value) AS n, {r('quantile_cont(value, 0.25)', 'lower')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.75)', 'upper')} FROM v GROUP BY q, grp")
def box_stats_multq(spark, sf_dir):
    found = plotdata.box_statistics(_grouped(fixtures.event_pairs(spark, sf_dir), ORDERS)[0])
    return found.select("q", F.col("group").alias("grp"), "n", rounded("lower"), rounded("median"), rounded("upper"))


def _density(keys: str, of: str = "v") -> list[str]:
    on = " AND ".join(f"s.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    return [
        f"st AS (SELECT {keys}, count(value) AS n, stddev_samp(value) AS sd, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 AS ir, min(value) AS lo, max(value) AS hi FROM {of} v GROUP BY {keys})",
        "sg AS (SELECT *, 0.9 * CASE WHEN ir > 0 THEN least(sd, ir) ELSE sd END * pow(n, -0.2) AS h, unnest(range(0, 64)) AS i FROM st WHERE sd > 0)",
        f"de AS (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, s.i, max(lo + (hi - lo) * s.i / 63) AS x, sum(exp(-pow((lo + (hi - lo) * s.i / 63 - value) / h, 2) / 2) / sqrt(2 * pi()) / h) / max(n) AS density FROM sg s JOIN {of} v ON {on} GROUP BY {', '.join('s.' + k.strip() for k in keys.split(','))}, s.i)",
    ]


def _density_sql(q: tuple[float, ...], keys: str) -> str:
    return with_(*values(q, "retail"), *grouped("retail"), *_density(keys)) + f"SELECT {keys}, {r('x')}, {r('density')} FROM de"


_MEANS = "vm AS (SELECT grp, gene, avg(value) AS value FROM v GROUP BY grp, gene)"


@query(with_(*values((2.0,), "retail"), *grouped("retail"), _MEANS, *_density("grp", "vm")) + f"SELECT grp, {r('x')}, {r('density')} FROM de")
def mean_violin_density(spark, sf_dir):
    found = plotdata.mean_density(_grouped(fixtures.retail(spark, sf_dir))[0])
    return found.select(F.col("group").alias("grp"), rounded("x"), rounded("density"))


@query(_density_sql((2.0,), "grp, sample"))
def diversity_density(spark, sf_dir):
    found = plotdata.density(_grouped(fixtures.retail(spark, sf_dir))[0], ["group", "sample"])
    return found.select(F.col("group").alias("grp"), "sample", rounded("x"), rounded("density"))


@query(_density_sql(ORDERS, "grp, q"))
def density_multq(spark, sf_dir):
    found = plotdata.density(_grouped(fixtures.retail(spark, sf_dir), ORDERS)[0], ["group", "q"])
    return found.select(F.col("group").alias("grp"), "q", rounded("x"), rounded("density"))


_TABLE = [*values((2.0,), "retail"), *grouped("retail"), *fold_change("odd", "even"), *rank_sums("even", "odd"), f"tested AS (SELECT gene, {normal_p('z')} AS p FROM rs)", *adjusted("BH", "tested"), "tab AS (SELECT * FROM fc JOIN adj USING (gene))"]


def _table(counts: DataFrame) -> DataFrame:
    rows, samples = _grouped(counts)
    return difference.calculate_difference(rows.drop("group"), samples, "even")


@query(with_(*_TABLE) + f"SELECT gene AS genes, {r('(c + k) / 2', 'x')}, {r('log2_fold_change', 'y')}, {r('a', 'padj')}, coalesce(abs(log2_fold_change) > 0 AND a < 0.05, false) AS significant FROM tab")
def ma_tsallis(spark, sf_dir):
    return plotdata.ma_frame(_table(fixtures.retail(spark, sf_dir))).select("genes", rounded("x"), rounded("y"), rounded("padj"), "significant")


_EXPRESSION = ["ev AS (SELECT gene, sample, grp, sum(cnt) AS value FROM retail GROUP BY ALL)", *fold_change("odd", "even", "median", source="ev", out="ef")]


@query(with_(*_TABLE, *_EXPRESSION) + f"SELECT t.gene AS genes, {r('(t.c + t.k) / 2', 'x')}, {r('coalesce(e.log2_fold_change, t.log2_fold_change)', 'y')}, {r('a', 'padj')}, coalesce(abs(coalesce(e.log2_fold_change, t.log2_fold_change)) > 0 AND a < 0.05, false) AS significant FROM tab t LEFT JOIN ef e ON e.gene = t.gene")
def ma_expression(spark, sf_dir):
    counts = settled(fixtures.retail(spark, sf_dir))
    found = plotdata.ma_expression(_table(counts), counts, fixtures.samples_of(counts), "odd", "even")
    return found.select("genes", rounded("x"), rounded("y"), rounded("padj"), "significant")


@query(with_(*_TABLE) + f"SELECT gene AS genes, {r('difference', 'x')}, {r('a', 'padj')}, {r('-log10(a)', 'y')}, abs(difference) >= 0.1 AND a < 0.05 AS significant FROM tab WHERE a > 0")
def volcano(spark, sf_dir):
    return plotdata.volcano_frame(_table(fixtures.retail(spark, sf_dir))).select("genes", rounded("x"), rounded("padj"), rounded("y"), "significant")


_TOP = ["top AS (SELECT gene FROM (SELECT gene, round(a, 6) AS ra, round(p, 6) AS rp FROM tab) ORDER BY ra, rp, gene LIMIT 3)"]


def _top(counts: DataFrame) -> DataFrame:
    steady = _table(counts).withColumns({c: F.round(c, sql.ROUND) for c in ("adjusted_p_values", "raw_p_values")})
    return plotdata.top_genes(steady, 3)


@query(with_(*_TABLE, *_TOP) + "SELECT gene FROM top")
def top_genes(spark, sf_dir):
    return _top(fixtures.retail(spark, sf_dir))


_FIRST = [*_TOP, "mp AS (SELECT p_brand AS gene, CAST(p_partkey AS VARCHAR) AS tx, p_partkey AS ord FROM part)", "chosen AS (SELECT gene, tx FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY ord) AS place FROM mp JOIN top USING (gene)) WHERE place <= 3)"]
_METRICS = {"median": "median(cnt)", "mean": "avg(cnt)", "variance": "var_samp(cnt)", "iqr": "quantile_cont(cnt, 0.75) - quantile_cont(cnt, 0.25)"}


def _summary_sql(metric: str) -> list[str]:
    return [*_TABLE, *_FIRST, f"su AS (SELECT c.gene, c.tx, grp, {_METRICS[metric]} AS expression FROM retail JOIN chosen c USING (tx) GROUP BY c.gene, c.tx, grp)", "sl AS (SELECT *, log2(expression + 1e-6) AS log2expr FROM su)"]


def _summaries(metric: str) -> Query:
    def run(spark, sf_dir):
        counts = settled(fixtures.retail(spark, sf_dir))
        mapping = fixtures.read(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").cast("string").alias("tx"), F.col("p_partkey").alias("ord"))
        chosen = plotdata.first_transcripts(mapping, _top(counts), 3)
        return plotdata.transcript_summary(counts, chosen, fixtures.samples_of(counts), metric)

    return run


def _summary_query(metric: str) -> Query:
    def run(spark, sf_dir):
        found = _summaries(metric)(spark, sf_dir)
        return found.select("gene", "tx", F.col("group").alias("grp"), rounded("expression"), rounded("log2expr"))

    return run


for _metric in _METRICS:
    query(with_(*_summary_sql(_metric)) + f"SELECT gene, tx, grp, {r('expression')}, {r('log2expr')} FROM sl", f"top_transcripts_{_metric}")(_summary_query(_metric))


@query(with_(*_summary_sql("median")) + f"SELECT {r('min(log2expr)', 'low')}, {r('max(log2expr)', 'high')} FROM sl")
def fill_limits(spark, sf_dir):
    return plotdata.fill_limits(_summaries("median")(spark, sf_dir)).select(rounded("low"), rounded("high"))


# Sources and sinks ------------------------------------------------------------------------------


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS tx, p_brand AS gene FROM part")
def tsv_round_trip(spark, sf_dir):
    part = fixtures.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("Transcript"), F.col("p_brand").alias("Gen"))
    folder = tables.scratch(spark, "tx2gene")
    tables.write_tsv(part, folder)
    return experiment.resolve_tx2gene(tables.read_tsv(spark, folder)).select("tx", "gene")
