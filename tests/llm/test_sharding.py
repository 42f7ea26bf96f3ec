import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.llm.sharding import Remainders, best_fit_decreasing, pack_fixed_capacity, shard_by_bytes, tightest_capacity


def plain_best_fit(sizes, capacity):
    bins, placed = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(left, b) for b, left in enumerate(bins) if left >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(max(capacity, sizes[i]))
        bins[b] -= sizes[i]
        placed[i] = b
    return placed


def loads_of(runs, shards):
    loads = [0] * shards
    for size, shard, n in runs:
        loads[shard] += size * n
    return loads


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_against_its_definition(seed):
    sizes = np.random.default_rng(seed).integers(1, 60, 200).tolist()
    runs, used = best_fit_decreasing(list(Counter(sizes).items()), 100)
    placed = plain_best_fit(sizes, 100)
    assert used == max(placed) + 1
    assert Counter({(s, b): n for s, b, n in runs}) == Counter(zip(sizes, placed))
    runs = tightest_capacity(list(Counter(sizes).items()), 40)
    assert sorted(s for s, _, n in runs for _ in range(n)) == sorted(sizes) and max(loads_of(runs, 40)) <= 1.05 * sum(sizes) / 40


def test_balanced_tree():
    rng, tree, plain = np.random.default_rng(3), Remainders(), []
    for i in range(3000):
        if plain and rng.random() < 0.45:
            least = int(rng.integers(0, 1000))
            assert tree.take(least) == (found := min((k for k in plain if k[0] >= least), default=None))
            plain = [k for k in plain if k != found]
        else:
            plain.append((int(rng.integers(0, 1000)) if i % 3 else i, i))
            tree.add(plain[-1])
    assert tree.root[3] <= 1.45 * np.log2(len(plain) + 2)


def test_every_group_of_many_goes_through_the_method(spark):
    """100,000 groups in few classes, one of which holds most: shards are as even as one by one."""
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit("x"), F.when(F.col("id") % 10 < 8, 4).otherwise((F.col("id") % 977).cast("int")))).alias("text"))
    found = shard_by_bytes(rows, 40, rows_per_task=5_000).groupBy("shard").agg(F.sum("size").alias("n"), F.max("shard_bytes").alias("told"), F.count("*").alias("rows"), F.max("slot").alias("slot")).collect()
    assert len(found) == 40 and all(r["n"] == r["told"] and r["slot"] == r["rows"] - 1 for r in found)
    assert max(r["n"] for r in found) - min(r["n"] for r in found) <= 40


def check(rows, corpus, shards):
    by_text, slots, loads = {}, defaultdict(list), defaultdict(int)
    texts = {i: t or "" for i, t in corpus}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert by_text.setdefault(raw, r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert len(rows) == len(corpus) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["shard_bytes"] == loads[r["shard"]] for r in rows)
    return loads


@pytest.mark.parametrize("options", [{}, {"rows_per_task": 2}])
def test_shards(documents, corpus, options):
    check(shard_by_bytes(documents, 5, **options).collect(), corpus, 5)


def test_sizes_are_nearly_equal(spark):
    rng = np.random.default_rng(1)
    corpus = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(1, 2000, 900))]
    loads = check(shard_by_bytes(spark.createDataFrame(corpus, "doc_id long, text string"), 40).collect(), corpus, 40)
    assert max(loads.values()) <= 1.01 * sum(loads.values()) / 40


def test_fixed_capacity(documents):
    found = pack_fixed_capacity(documents, 50_000)
    assert found.groupBy("shard").agg(F.sum("bytes").alias("n")).where("n > 50000").join(found.where("bytes > 50000").select("shard"), "shard", "left_anti").count() == 0


def test_odd_tables(odd, empty):
    rows = shard_by_bytes(odd, 3).collect()
    assert len(rows) == odd.count() and len({r["shard"] for r in rows if r["size"] == 16}) == 1
    assert shard_by_bytes(empty, 3).count() == 0
