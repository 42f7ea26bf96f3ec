import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.operators import plotdata, quantiles

SCHEMA = "group string, q double, value double"


def rows_of(seed=1):
    """Groups of one value, of ties, of two clusters far apart, with missing values, and one hot group."""
    rng = np.random.default_rng(seed)
    groups = {
        ("A", 1.0): rng.normal(3, 1, 2500),
        ("A", 2.0): np.round(rng.random(700), 1),
        ("B", 1.0): np.concatenate([rng.normal(0, 1, 300), rng.normal(1000, 1, 40)]),
        ("B", 2.0): np.array([5.0]),
        (None, 1.0): np.array([1.0, 2.0, 4.0]),
        ("C", 1.0): np.repeat(2.5, 900),
        ("C", 2.0): np.concatenate([np.zeros(800), rng.random(100)]),
    }
    rows = [(g, q, float(v)) for (g, q), vs in groups.items() for v in vs]
    return groups, [*rows, ("A", 1.0, None), ("A", 2.0, float("nan")), ("D", 1.0, None)]


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small ranges stay apart, as those of large tables do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_of()[1], SCHEMA).repartition(7)


def test_quantiles_against_sorted_values(frame):
    keys, asked = ["group", "q"], (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    ranges = quantiles.ranged(frame, keys)
    assert ranges.select("part").distinct().count() > 1
    found = {(r["group"], r["q"]): (r["n"], r["p"]) for r in quantiles.quantiles(ranges, keys, asked).collect()}
    assert found == {k: (len(v), pytest.approx(list(np.quantile(v, asked)), abs=1e-12)) for k, v in rows_of()[0].items()}


def plain_density(v, points):
    """Every value's kernel at every point."""
    sd, iqr = v.std(ddof=1), np.subtract(*np.quantile(v, (0.75, 0.25)))
    h = 0.9 * (min(sd, iqr / 1.34) if iqr > 0 else sd) * len(v) ** -0.2
    x = np.linspace(v.min(), v.max(), points)
    return h, x, np.exp(-(((x[:, None] - v[None, :]) / h) ** 2) / 2).sum(axis=1) / math.sqrt(2 * math.pi) / h / len(v)


@pytest.mark.parametrize("points", [64, 5])
def test_densities_against_every_kernel(frame, points):
    found = {}
    for r in plotdata.density(frame, ["group", "q"], points).collect():
        found.setdefault((r["group"], r["q"]), []).append((r["x"], r["density"]))
    groups = {k: v for k, v in rows_of()[0].items() if len(v) > 1 and v.std() > 0}
    assert set(found) == set(groups)
    for k, v in groups.items():
        h, x, expected = plain_density(v, points)
        got = dict(sorted(found[k]))
        # A point out of reach of every value has no row, and no density.
        assert all(min(abs(x - at)) < 1e-9 for at in got)
        near = {at: min(got, key=lambda g: abs(g - at), default=math.inf) for at in x}
        told = np.array([got[n] if abs(n - at) < 1e-9 else 0.0 for at, n in near.items()])
        assert told == pytest.approx(expected, abs=2e-11 / h)


def test_curves_and_boxes(frame):
    groups = rows_of()[0]
    curve = {(r["group"], r["q"]): r for r in plotdata.q_curve(frame).collect()}
    box = {(r["group"], r["q"]): r for r in plotdata.box_statistics(frame).collect()}
    assert set(curve) == set(box) == set(groups)
    for k, v in groups.items():
        a, b, c = np.quantile(v, (0.25, 0.5, 0.75))
        assert (curve[k]["median"], curve[k]["iqr"], curve[k]["low"]) == pytest.approx((b, c - a, b - (c - a) / 2), abs=1e-12)
        assert (box[k]["n"], box[k]["lower"], box[k]["median"], box[k]["upper"]) == pytest.approx((len(v), a, b, c), abs=1e-12)


def test_no_group_in_one_task(spark):
    """A hot group is spread over ranges, and of these only those that hold the ranks are sorted."""
    hot = spark.range(0, 40_000, 1, 8).select(F.lit("A").alias("group"), F.lit(1.0).alias("q"), F.hash("id").cast("double").alias("value"))
    ranges = quantiles.ranged(hot, ["group", "q"])
    sizes = [r["n"] for r in ranges.groupBy("part").agg(F.sum("m").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000
    assert quantiles.quantiles(ranges, ["group", "q"], (0.5,)).first()["p"][0] == hot.agg(F.median("value")).first()[0]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert plotdata.density(empty, ["group"]).count() == 0 and plotdata.box_statistics(empty).count() == 0
