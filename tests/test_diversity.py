import math
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from varietas.functions.numerics import format_label
from varietas.operators import diversity, experiment, filters
from varietas.plans import catalogue


def counts(spark, cells):
    return spark.createDataFrame(cells, "gene string, tx string, sample string, count double")


def gene(spark, x, sample="s1", name="g"):
    return counts(spark, [(name, f"{name}{i}", sample, float(v)) for i, v in enumerate(x)])


def one(df):
    return {round(r["q"], 6): r["value"] for r in df.collect()}


@pytest.mark.parametrize(
    "x, raw, norm, hill",
    [
        ((0, 0, 5, 4, 1), (1.311580158474, 0.943348392329, 0.58), (0.530545318845, 0.586135311615, 0.725), (2.741640786500, 2.568567607416, 2.380952380952)),
        ((10, 5, 0), (0.787693700235, 0.636514168295, 0.444444444444), (0.538004802461, 0.579380164286, 2 / 3), (1.942809041582, 1.889881574842, 1.8)),
        ((100, 50, 25, 25), (1.828427124746, 1.213007565980, 0.65625), (0.914213562373, 0.875, 0.875), (3.664213562373, 3.363585661015, 2.909090909091)),
        ((10, 0, 0), (0, 0, 0), (0, 0, 0), (1, 1, 1)),
        ((1, 1, 1), (1.4641016151, math.log(3), 2 / 3), (1, 1, 1), (3, 3, 3)),
    ],
)
def test_closed_forms(spark, x, raw, norm, hill):
    df, q = gene(spark, x), (0.5, 1.0, 2.0)
    for want, found in ((raw, diversity.diversity(df, q, norm=False)), (norm, diversity.diversity(df, q)), (hill, diversity.diversity(df, q, what="D"))):
        assert list(one(found).values()) == pytest.approx(want, abs=1e-9) and set(one(found)) == set(q)


def test_base_two(spark):
    df = gene(spark, (1, 1))
    assert one(diversity.diversity(df, 1.0, norm=False, log_base=2.0))[1.0] == pytest.approx(1)
    assert one(diversity.diversity(df, 1.0, what="D"))[1.0] == pytest.approx(2)


def test_single_transcript_genes_have_no_normalised_value(spark):
    df = gene(spark, (7,))
    assert diversity.diversity(df, 2.0).count() == 0
    assert one(diversity.diversity(df, 2.0, norm=False)) == {2.0: 0.0}
    assert one(diversity.diversity(df, 2.0, what="D")) == {2.0: 1.0}


def test_an_empty_cell_removes_the_gene_everywhere(spark):
    df = gene(spark, (1, 2), "s1").union(gene(spark, (0, 0), "s2")).union(gene(spark, (1, 2), "s1", "h")).union(gene(spark, (3, 2), "s2", "h"))
    assert {r["gene"] for r in diversity.diversity(df, 2.0).collect()} == {"h"}
    assert diversity.diversity(df, 2.0, complete=False).where("value is null").count() == 1


def test_absent_cells_are_zeros(spark):
    dense = gene(spark, (0, 0, 5, 4, 1))
    sparse, mapping = dense.where("count > 0"), dense.select("gene", "tx")
    assert one(diversity.diversity(sparse, 2.0, tx2gene=mapping))[2.0] == pytest.approx(0.725)


@pytest.mark.parametrize("bad", [0, -1, [1, 0], "2", [], None, True])
def test_orders_are_checked(bad):
    with pytest.raises((ValueError, TypeError)):
        diversity.check_orders(bad)


def test_many_orders_and_empty_tables(spark):
    df = gene(spark, (3, 2, 1))
    q = [0.1 + 0.05 * i for i in range(60)]
    values = [v for _, v in sorted(one(diversity.diversity(df, q, what="D")).items())]
    assert len(values) == 60 and all(a >= b for a, b in zip(values, values[1:]))
    assert diversity.diversity(df.limit(0), q).count() == 0


def test_array_form(spark):
    df = spark.createDataFrame([([0.0, 0.0, 5.0, 4.0, 1.0],), ([0.0, 0.0],), ([1.0, None],), ([],)], "x array<double>")
    got = [r["s"] for r in df.select(diversity.tsallis(F.col("x"), 2.0).alias("s")).collect()]
    assert got == [pytest.approx(0.725), None, None, None]


def test_long_arrays_take_time_in_proportion(spark):
    x = [float(i % 97) for i in range(20_000)]
    p = [c / sum(x) for c in x if c]
    want = {"q=0.5": (sum(v**0.5 for v in p) - 1) / 0.5, "q=1": -sum(v * math.log(v) for v in p), "q=2": 1 - sum(v * v for v in p)}
    df = spark.createDataFrame([(x,), (x + [None],), ([-c for c in x],)], "x array<double>")
    begun = time.monotonic()
    got = [r["s"] for r in df.select(diversity.tsallis(F.col("x"), (0.5, 1.0, 2.0), norm=False).alias("s")).collect()]
    assert time.monotonic() - begun < 20
    assert got[0] == pytest.approx(want) and got[1] == got[2] == dict.fromkeys(want)


def test_the_query_of_arrays_keeps_complete_genes_as_its_mirror(spark, tmp_path):
    """A brand that one nation lacks, and parts without a brand, have no rows in the SQL."""
    tables = {
        "part": "SELECT * FROM (VALUES (1, 'a'), (2, 'a'), (3, 'b'), (4, NULL)) t(p_partkey, p_brand)",
        "supplier": "SELECT * FROM (VALUES (1, 5), (2, 6)) t(s_suppkey, s_nationkey)",
        "lineitem": "SELECT * FROM (VALUES (1, 1, 3.0::DOUBLE), (2, 1, 1.0), (1, 2, 2.0), (2, 2, 5.0), (3, 1, 4.0), (4, 1, 1.0), (4, 2, 1.0)) t(l_partkey, l_suppkey, l_quantity)",
    }
    with duckdb.connect() as duck:
        for name, rows in tables.items():
            duck.execute(f"CREATE TABLE {name} AS {rows}")
            duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        want = duck.execute(catalogue.oracle_sql()["tsallis_of_arrays"]).fetchall()
    found = catalogue.queries()["tsallis_of_arrays"](spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(want) and {r[0] for r in want} == {"a"}


def test_names_round_trip(spark):
    df = spark.createDataFrame([("A_N", 0.5), ("B_T", 1.0)], "s string, q double").select("s", "q", diversity.encode_column(F.col("s"), F.col("q")).alias("c"))
    got = df.select("c", diversity.decode_sample(F.col("c")), diversity.decode_order(F.col("c")), diversity.sample_base(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("A_N_q=0.5", "A_N", 0.5, "A"), ("B_T_q=1", "B_T", 1.0, "B")]
    assert spark.range(1).select(format_label(F.lit("__FOO_bar  "))).first()[0] == "Foo bar"


def test_expression_filter_is_strict_and_capped(spark):
    rows = [(f"t{i}", s, float(v)) for i, both in enumerate([(0, 2), (6, 8), (7, 9)]) for s, v in zip("ab", both)]
    df = spark.createDataFrame(rows, "tx string, sample string, count double")
    assert {r["tx"] for r in filters.expressed(df, 5, 1).collect()} == {"t1", "t2"}
    assert {r["tx"] for r in filters.expressed(df, 6, 9).collect()} == {"t2"}


def test_experiment_prefers_metadata_and_checks(spark):
    long = spark.createDataFrame([("t1", "a", 1.0), ("t2", "a", 1.0), ("t1", "b", 3.0), ("t2", "b", 1.0)], "feature string, sample string, value double")
    mapping = spark.createDataFrame([("t1", "g"), ("t2", "g")], "Transcript string, Gen string")
    x = experiment.build_experiment(mapping, long)
    found = {r["sample"]: r["value"] for r in experiment.calculate_diversity(x, q=2.0).assay("diversity").collect()}
    assert found == {"a": pytest.approx(1.0), "b": pytest.approx(0.75)}
    assert {r[0] for r in experiment.calculate_diversity(x, q=[1, 2], what="D").assay("hill").select("sample").distinct().collect()} == {"a_q=1", "a_q=2", "b_q=1", "b_q=2"}
    with pytest.raises(ValueError):
        experiment.build_experiment(mapping, long.withColumn("value", F.lit("x")))
    with pytest.raises(ValueError):
        experiment.calculate_diversity(long)
    with pytest.raises(ValueError):
        experiment.calculate_diversity(experiment.build_experiment(mapping, long.withColumn("value", F.lit(None).cast("double"))))


def test_wide_and_long_with_dotted_names(spark):
    wide = spark.createDataFrame([("t1", 1.0, None), ("t2", 2.0, 3.0)], "id string, `s.1` double, `s.2` double")
    long = experiment.from_wide(wide, "id")
    assert {(r["feature"], r["sample"], r["value"]) for r in long.collect()} == {("t1", "s.1", 1.0), ("t1", "s.2", None), ("t2", "s.1", 2.0), ("t2", "s.2", 3.0)}
    back = experiment.to_wide(long, "feature", "sample", "value", ["s.1", "s.2"])
    assert sorted(map(tuple, back.collect())) == [("t1", 1.0, None), ("t2", 2.0, 3.0)]


def test_transcripts_by_position_or_name(spark):
    ids = spark.createDataFrame([("x", 5), ("y", 9)], "Transcript string, ord long")
    rows = spark.createDataFrame([("1", "s", 1.0, 0), ("2", "s", 2.0, 1)], "feature string, sample string, value double, ord long")
    assert {(r["feature"], r["value"]) for r in experiment.map_transcripts(rows, ids).collect()} == {("x", 1.0), ("y", 2.0)}
    some = rows.limit(1).withColumn("feature", F.lit("y"))
    assert experiment.map_transcripts(some, ids).first()["feature"] == "y"
    with pytest.raises(ValueError):
        experiment.map_transcripts(some.withColumn("feature", F.lit("z")), ids)


def test_both_measures_at_once(spark):
    df = gene(spark, (3, 2, 1))
    both = {r["q"]: (r["entropy"], r["hill"]) for r in diversity.diversity(df, [1.0, 2.0], what="both").collect()}
    s, d = one(diversity.diversity(df, [1.0, 2.0])), one(diversity.diversity(df, [1.0, 2.0], what="D"))
    assert both == {q: (pytest.approx(s[q]), pytest.approx(d[q])) for q in (1.0, 2.0)}
    r = spark.createDataFrame([([3.0, 2.0, 1.0],)], "x array<double>").select(diversity.tsallis(F.col("x"), 2.0, what="both").alias("b")).first()["b"]
    assert (r["S"], r["D"]) == (pytest.approx(s[2.0]), pytest.approx(d[2.0]))


def test_warnings_of_assays_and_filters(spark):
    long = spark.createDataFrame([("t1", "a", 1.0), ("t2", "a", 1.0)], "feature string, sample string, value double")
    x = experiment.Experiment({"other": long})
    with pytest.warns(UserWarning):
        assert x.assay("misspelt") is long
    with pytest.warns(UserWarning):
        assert experiment.counts_of(x) is long
    with pytest.warns(UserWarning):
        assert filters.filter_experiment(x, 5, 1, "other").assay("other").count() == 0
    with pytest.raises(ValueError):
        filters.filter_experiment(experiment.Experiment({"counts": long.withColumn("value", F.lit("x"))}))
    parts = {"counts": long, "abundance": long.withColumn("value", F.col("value") * 2), "length": long, "countsFromAbundance": long}
    genes = spark.createDataFrame([("t1", "g", 0), ("t2", "g", 1)], "tx string, gene string, ord int")
    assert experiment.calculate_diversity(parts, genes, tpm=True).assay().first()["value"] == pytest.approx(1.0)


def test_the_first_transcript_in_order_wins(spark):
    table = spark.createDataFrame([("t", "late", 2), ("t", "early", 1), ("u", "g", 3)], "Transcript string, Gen string, ord int").repartition(3)
    assert {(r["tx"], r["gene"]) for r in experiment.resolve_tx2gene(table).collect()} == {("t", "early"), ("u", "g")}
