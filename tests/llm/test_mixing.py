import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from varietas.llm import mixing
from varietas.llm.mixing import mix, mixture

SCHEMA = "doc_id long, source string, text string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, most):
    """{source: target} by sharing out again and again."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in keys if k not in fixed]
        rest = total - sum(fixed.values())
        shares = {k: Fraction(rest * weight[k], sum(weight[x] for x in free)) for k in free}
        above = [k for k in free if shares[k] > most * sizes[k]]
        if not above:
            return {**fixed, **shares}
        fixed |= {k: most * sizes[k] for k in above}


def plain_multiplier(sizes, target, most):
    """x with sum of size * min(most, exp(x * size)) = target, by halving."""
    low, high = -100.0, 100.0
    for _ in range(200):
        x = (low + high) / 2
        if sum(s * math.exp(min(x * s, math.log(most))) for s in sizes) < target:
            low = x
        else:
            high = x
    return x


def check(rows, found, weights=(5, 2, 1), most=3):
    size, sources = {i: size_of(t) for i, _, t in rows}, defaultdict(list)
    for i, s, _ in rows:
        sources[s].append(i)
    sizes = {s: sum(size[i] for i in ids) for s, ids in sources.items()}
    goal, taken = plain_targets(sizes, weights, most), defaultdict(int)
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(by_id) == len(rows)
    for i, s, _ in rows:
        r = by_id[i]
        assert (r["source"], r["size"], r["source_size"]) == (s, size[i], sizes[s]) and r["target"] == pytest.approx(float(goal[s]), rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= most
        taken[s] += r["taken"]
    for s, ids in sources.items():
        if 0 < goal[s] < most * sizes[s]:
            x = plain_multiplier([size[i] for i in ids if size[i]], float(goal[s]), most)
            assert all(by_id[i]["rate"] == pytest.approx(min(most, math.exp(min(5, x * size[i]))), rel=1e-6) for i in ids)
        elif goal[s]:
            assert all(by_id[i]["copies"] == most for i in ids)
    return goal, taken


def rows_of(seed, n=400, sources=("a", "a", "a", "a", "b", "c", "é", "Z", None), longest=60):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), " ".join(["w"] * int(1 + longest * rng.random() ** 3))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"weights": (1, 9), "most": 2}])
def test_rates_and_copies_against_plain_ones(spark, options):
    rows = rows_of(1)
    found = mix(spark.createDataFrame(rows, SCHEMA).repartition(3), rows_per_task=50, **options).collect()
    goal, taken = check(rows, found, **options)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_sources_far_from_their_targets(spark):
    """A source with few words next to its weight, one with one long text, one without words, hot classes."""
    rows = [(i, "a", "w " * (1 + i % 3)) for i in range(9)] + [(100 + i, "b", "w " * 7) for i in range(900)]
    rows += [(2000, "c", "w " * 5000), *((2001 + i, "c", "one two") for i in range(400)), (3000, "d", None), (3001, "d", "\t\n"), (3002, None, "x y z")]
    found = mix(spark.createDataFrame(rows, SCHEMA), rows_per_task=100).collect()
    goal, taken = check(rows, found)
    # Of "c", whole copies make 2,400 words at most without the long text, and 5,000 with it.
    assert 2400 < goal["c"] - 500 and taken["c"] == 5000 and all(abs(taken[s] - goal[s]) <= 7 for s in "abd")
    assert goal["a"] == taken["a"] == 3 * 18 and goal["d"] == taken["d"] == 0 and {r["copies"] for r in found if not r["size"]} == {1}


def test_reruns_agree_in_any_order(spark):
    df = spark.createDataFrame(rows_of(2), SCHEMA)
    first, again = (sorted(map(repr, mix(x).collect())) for x in (df.repartition(5), df.orderBy("text").coalesce(2)))
    assert first == again


def test_odd_tables(spark):
    rows = [(None, "a", "one two three")] * 2500 + [(None, None, None), (7, "a", "same"), (7, "a", "same"), (8, "", "x " * 100_000), (8, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("origin", "size", "n", "copies", "target", "octave", "rate", "piece", "ordinal")})
    found = mix(df, rows_per_task=10).collect()
    assert len(found) == len(rows) and sum(r["size"] for r in found) == 7502 + 100_000
    own = [r for r in found if r["source"] == "a"]
    assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=3)
    assert mix(df.where("false")).count() == 0
    assert [r["taken"] for r in mix(spark.createDataFrame([(1, "a", None), (2, "b", " ")], SCHEMA)).collect()] == [0, 0]


def test_sources_joined_without_broadcast(spark, monkeypatch):
    rows = rows_of(4, 200)
    expected = sorted(map(repr, mix(spark.createDataFrame(rows, SCHEMA)).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(repr, mix(spark.createDataFrame(rows, SCHEMA)).collect())) == expected


def test_mixture_repeats_rows(spark):
    df = spark.createDataFrame(rows_of(3, 60), SCHEMA)
    mixed = mix(df)
    often = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    assert {r[0]: r[1] for r in mixture(df, mixed).groupBy("doc_id").count().collect()} == {i: n for i, n in often.items() if n}


def test_no_python_in_the_plan(spark):
    plan = mix(spark.createDataFrame(rows_of(5, 30), SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])
