import pytest
from pyspark.sql import functions as F

from varietas.operators.experiment import Experiment, counts_of, from_assays, mapping_of
from varietas.operators.metadata import pair_number, samples_in_order
from varietas.sources import tables


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_mapping_tables(spark, tmp_path):
    path = put(tmp_path, "map.tsv", "Transcript\tGen\nt1\tg1\nt2\tg1\nt1\tg2\n")
    assert sorted((r["tx"], r["gene"]) for r in tables.read_tx2gene(spark, path, strict=True).collect()) == [("t1", "g1"), ("t2", "g1")]
    other = put(tmp_path, "other.tsv", "txid\tgeneid\na\tb\n")
    assert tables.read_tx2gene(spark, other).first()["gene"] == "b"
    with pytest.raises(ValueError):
        tables.read_tx2gene(spark, other, strict=True)
    with pytest.raises(TypeError):
        tables.read_tx2gene(spark, 3)


def test_counts_and_samples(spark, tmp_path):
    path = put(tmp_path, "counts.tsv", "id\tA_N\tA.1_T\nt1\t1\t2\nt2\t0\t5\n")
    long = tables.read_counts(spark, path)
    assert {(r["feature"], r["sample"], r["value"]) for r in long.collect()} == {("t1", "A_N", 1.0), ("t1", "A.1_T", 2.0), ("t2", "A_N", 0.0), ("t2", "A.1_T", 5.0)}
    data = tables.read_coldata(spark, put(tmp_path, "coldata.tsv", "Sample\tCondition\nA_N\tNormal\nA.1_T\tTumor\n"))
    samples = long.select("sample").distinct()
    assert {tuple(r) for r in samples_in_order(data, samples, "Condition").collect()} == {("A_N", "Normal"), ("A.1_T", "Tumor")}
    with pytest.raises(ValueError, match="A.1_T"):
        samples_in_order(data.where("Condition = 'Normal'"), samples, "Condition")
    with pytest.raises(ValueError):
        samples_in_order(data.drop("Sample"), samples, "Condition")


def test_files_of_samples(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "S1.results.txt", "transcript\tn\nt1.3|x\t4\n")
    put(folder, "S2.results.txt", "transcript\tn\nt1.3|x\t6\n")
    suffixes = spark.createDataFrame([("S1", "_N")], "sample string, suffix string")
    rows = tables.read_sample_files(spark, f"{folder}/*.txt", "transcript", "n", suffixes).collect()
    assert {tuple(r[c] for c in ("feature", "sample", "value")) for r in rows} == {("t1", "S1_N", 4.0), ("t1", "S2", 6.0)}


def test_precedence_of_counts(spark):
    frame = lambda v: spark.createDataFrame([("t", "s", v)], "feature string, sample string, value double")
    a, b, c = frame(1.0), frame(2.0), frame(3.0)
    assert counts_of(Experiment({"x": a, "counts": b})) is b and counts_of(Experiment({"x": a})) is a
    assert counts_of(Experiment({"x": a}, metadata={"readcounts": c})) is c and counts_of(Experiment({"x": a}), b) is b
    assert mapping_of(Experiment({"x": a}), a).first()["gene"] == "t"
    parts = {"counts": a, "abundance": b, "length": c, "other": c}
    assert from_assays(parts) is a and from_assays(parts, tpm=True) is b
    with pytest.raises(ValueError):
        from_assays({"abundance": b})
    with pytest.raises(ValueError):
        Experiment({"x": a}).assay(2)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, g string")
    tables.write_parquet(df, f"{tmp_path}/p", ["g"])
    tables.write_tsv(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/p").first()["n"] == 1 and tables.read_tsv(spark, f"{tmp_path}/t").columns == ["n", "g"]
    assert tables.scratch(spark, "x") != tables.scratch(spark, "x")
    assert [r[0] for r in spark.range(1, 5).select(pair_number(F.col("id"))).collect()] == [1, 1, 2, 2]
