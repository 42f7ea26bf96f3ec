import json

import pytest
from pyspark.sql import functions as F

from varietas.operators import experiment, plotdata
from varietas.sources import assembly


@pytest.fixture(scope="module")
def parts(spark):
    rows = [("t1.3|x", "S1", 4.0), ("t2", "S1", 1.0), ("t1.1", "S2", 6.0), ("t3|y", "S2", 0.0), ("t4", "S.3", None)]
    mapping = [("t1", "g1", 2), ("t1", "g9", 5), ("t2", "g1", 1), ("t4", "g2", 3)]
    return (
        spark.createDataFrame(rows, "feature string, sample string, value double").repartition(3),
        spark.createDataFrame(mapping, "tx string, gene string, ord int"),
        spark.createDataFrame([("S1", "_N"), ("S2", "_T")], "sample string, suffix string"),
    )


def test_a_matrix_of_samples(spark, parts):
    found = assembly.count_matrix(*parts)
    assert found.columns == ["feature", "gene", "S.3", "S1_N", "S2_T"]
    assert {tuple(r) for r in found.collect()} == {("t1", "g1", None, 4.0, 6.0), ("t2", "g1", None, 1.0, None), ("t3", None, None, None, 0.0), ("t4", "g2", None, None, None)}
    given = assembly.count_matrix(*parts, samples=["S1_N", "S9"])
    assert given.columns == ["feature", "gene", "S1_N", "S9"] and given.count() == 4
    left = experiment.unmapped_features(assembly.cleaned(parts[0]), parts[1])
    assert [tuple(r) for r in left.collect()] == [("t3", 1)]
    kept = experiment.mapped_rows(assembly.cleaned(parts[0]), parts[1])
    assert sorted(r["feature"] for r in kept.collect()) == ["t1", "t1", "t2", "t4"]


def test_cells_with_several_values_and_too_many_samples(spark, parts, monkeypatch):
    rows, mapping, suffixes = parts
    with pytest.raises(ValueError, match="t1 in S1_N"):
        assembly.count_matrix(rows.union(spark.createDataFrame([("t1.7", "S1", 2.0)], rows.schema)), mapping, suffixes)
    monkeypatch.setattr(assembly, "MOST_SAMPLES", 2)
    with pytest.raises(ValueError):
        assembly.count_matrix(rows, mapping, suffixes)
    assert assembly.count_matrix(rows.where("false"), mapping, suffixes).columns == ["feature", "gene"]


def test_panels_share_their_limits(spark, tmp_path, monkeypatch):
    rows = [("b", "t9", "N", -1.5, 1), ("b", "t9", "T", 3.0, 1), ("b", "t1", "N", None, 2), ("a", "t2", "N", 0.0, 1), ("a", "t2", "T", 7.25, 1)]
    frame = spark.createDataFrame(rows, "gene string, tx string, group string, log2expr double, place int").repartition(3)
    drawing = json.loads(plotdata.transcript_panels(frame, "median"))
    assert drawing["title"] == "median" and [p["title"] for p in drawing["hconcat"]] == ["a", "b"]
    assert all(p["encoding"]["color"]["scale"]["domain"] == [-1.5, 7.25] and p["encoding"]["color"]["legend"]["orient"] == "bottom" for p in drawing["hconcat"])
    assert drawing["resolve"] == {"scale": {"color": "shared"}, "legend": {"color": "shared"}}
    b = drawing["hconcat"][1]
    assert b["encoding"]["y"]["sort"] == ["t9", "t1"] and {"tx": "t1", "group": "N", "log2expr": None} in b["data"]["values"] and len(b["data"]["values"]) == 3
    order = json.loads(plotdata.transcript_panels(frame.drop("place"), "x", ["b", "a"]))
    assert [p["title"] for p in order["hconcat"]] == ["b", "a"] and order["hconcat"][0]["encoding"]["y"]["sort"] == ["t1", "t9"]
    with pytest.raises(ValueError, match="nobody"):
        plotdata.transcript_panels(frame, "x", ["a", "nobody"])
    plotdata.save_drawing(spark, json.dumps(drawing, indent=1), f"{tmp_path}/drawing")
    assert json.loads("\n".join(r[0] for r in spark.read.text(f"{tmp_path}/drawing").collect())) == drawing
    empty = json.loads(plotdata.transcript_panels(frame.where("log2expr is null"), "x"))
    assert "domain" not in empty["hconcat"][0]["encoding"]["color"]["scale"]
    monkeypatch.setattr(plotdata, "MOST_DRAWN", 4)
    with pytest.raises(ValueError):
        plotdata.transcript_panels(frame, "x")


def test_panels_of_summaries(spark):
    """From counts to a drawing: the first transcripts of two genes."""
    counts = spark.createDataFrame([(f"t{t}", f"s{s}", float(t * s)) for t in range(6) for s in range(4)], "tx string, sample string, count double")
    groups = spark.createDataFrame([(f"s{s}", "NT"[s % 2]) for s in range(4)], "sample string, group string")
    mapping = spark.createDataFrame([(f"t{t}", f"g{t % 2}", t) for t in range(6)], "tx string, gene string, ord int")
    chosen = plotdata.first_transcripts(mapping, mapping.select("gene").distinct(), 2)
    summaries = plotdata.transcript_summary(counts, chosen, groups).join(chosen, ["gene", "tx"])
    limits = plotdata.fill_limits(summaries).first()
    drawing = json.loads(plotdata.transcript_panels(summaries, "median"))
    assert drawing["hconcat"][0]["encoding"]["color"]["scale"]["domain"] == [limits["low"], limits["high"]]
    assert [p["encoding"]["y"]["sort"] for p in drawing["hconcat"]] == [["t0", "t2"], ["t1", "t3"]]
    assert summaries.where(F.col("log2expr").isNull()).count() == 0
