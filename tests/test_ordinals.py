import random

import pytest
from pyspark.sql import functions as F

from varietas.operators import experiment, ordinals
from varietas.operators.experiment import Experiment, counts_of
from varietas.operators.metadata import samples_in_order
from varietas.sources import tables


@pytest.fixture(autouse=True)
def small_blocks(spark):
    """Files are read in many blocks, packed into tasks by size, and ranges stay apart."""
    options = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield
    for k in options:
        spark.conf.unset(k)


def test_rows_of_files_of_different_sizes(spark, tmp_path):
    rng, lines = random.Random(1), []
    for name, n in (("a.tsv", 30), ("b.tsv", 900), ("c.tsv", 3), ("d.tsv", 400)):
        rows = [f"{name}{i}\t{'x' * rng.randint(0, 40)}" for i in range(n)]
        lines += [r.split("\t")[0] for r in rows]
        (tmp_path / name).write_text("\n".join(["id\ttext", *rows]) + "\n")
    table = tables.read_tsv(spark, str(tmp_path))
    assert table.rdd.getNumPartitions() > 8
    found = ordinals.in_file_order(table)
    assert found.columns == ["id", "text", "ord"] and [r["id"] for r in sorted(found.collect(), key=lambda r: r["ord"])] == lines
    assert sorted(r["ord"] for r in found.collect()) == list(range(len(lines)))


def test_the_first_row_of_a_transcript_wins_over_blocks(spark, tmp_path):
    rows = [f"t{i % 300}\tg{i}" for i in range(1500)]
    (tmp_path / "map.tsv").write_text("\n".join(["Transcript\tGen", *rows]) + "\n")
    found = tables.read_tx2gene(spark, str(tmp_path / "map.tsv"), strict=True)
    assert {r["tx"]: r["gene"] for r in found.collect()} == {f"t{i}": f"g{i}" for i in range(300)}


def test_numbers_over_ranges(spark):
    df = spark.range(1000).select(F.hash("id").alias("a"), F.col("id").alias("b"))
    found = ordinals.numbered(df, "a", "b").collect()
    assert [r["place"] for r in sorted(found, key=lambda r: (r["a"], r["b"]))] == list(range(1, 1001))
    assert ordinals.numbered(df.where("false"), "a").count() == 0


def test_positions_give_transcripts_their_names(spark):
    counts = spark.createDataFrame([(3 * i, s, float(i), f"row{i}") for i in range(500) for s in ("A", "B")], "ord long, sample string, value double, feature string").repartition(7)
    ids = spark.createDataFrame([(f"t{i}", 1000 - i) for i in range(500)], "Transcript string, ord long").repartition(5)
    found = experiment.map_transcripts(counts, ids).collect()
    assert len(found) == 1000 and all(r["feature"] == f"t{499 - int(r['value'])}" for r in found)


def test_row_names_of_sample_tables(spark, tmp_path):
    (tmp_path / "named.tsv").write_text("Condition\tbatch\nA\tNormal\t1\nB\tTumor\t2\nC\tTumor\t1\n")
    (tmp_path / "plain.tsv").write_text("sample\tCondition\nA\tNormal\nB\tTumor\n")
    named, plain = (tables.read_coldata(spark, str(tmp_path / f"{n}.tsv")) for n in ("named", "plain"))
    assert named.columns == ["row_names", "Condition", "batch", "ord"] and plain.columns == ["sample", "Condition", "ord"]
    samples = spark.createDataFrame([("A",), ("B",)], "sample string")
    for table in (named, plain):
        assert {tuple(r) for r in samples_in_order(table, samples, "Condition").collect()} == {("A", "Normal"), ("B", "Tumor")}
    # Row names that don't name all samples give way to the id column.
    other = plain.withColumn("row_names", F.lit("x"))
    assert samples_in_order(other, samples, "Condition").count() == 2
    with pytest.raises(ValueError):
        samples_in_order(named.where("row_names <> 'A'"), samples, "Condition")


def test_counts_at_a_path(spark, tmp_path):
    (tmp_path / "counts.tsv").write_text("id\tA\tB\nt1\t1\t2\n")
    x = Experiment({"counts": spark.createDataFrame([("t", "s", 1.0)], "feature string, sample string, value double")})
    assert {tuple(r) for r in counts_of(x, str(tmp_path / "counts.tsv")).collect()} == {("t1", "A", 1.0), ("t1", "B", 2.0)}
