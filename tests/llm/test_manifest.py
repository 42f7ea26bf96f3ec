import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from varietas.llm.manifest import manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def digest(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels of a tree, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, i, start):
    """(siblings, head) of node i, whose digest is taken as ``start``."""
    siblings = []
    for nodes in levels[:-1]:
        first = i // 8 * 8
        run = nodes[first : first + 8]
        siblings += run[: i - first] + run[i - first + 1 :]
        run = run[: i - first] + [start] + run[i - first + 1 :]
        i, start = i // 8, h(*run)
    return siblings, start


def plain(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, digest(row), row))
    keys = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([leaf for _, _, leaf, _ in sorted(langs[k], key=lambda x: x[:3])]) for k in keys}
    over = tree([trees[k][-1][0] for k in keys])
    found = []
    for g, k in enumerate(keys):
        for i, (_, _, leaf, row) in enumerate(sorted(langs[k], key=lambda x: x[:3])):
            start = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                start = digest((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            low, head = walk(trees[k], i, start)
            high, root = walk(over, g, head)
            found.append((row[0], leaf, trees[k][-1][0], over[-1][0], h(*low, *high), root, root == over[-1][0]))
    return found


def told(found):
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(n, langs, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "é", None]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "lower é", f"Upper É {i}", "日本語"])) for i in rng.sample(range(5 * n), n)]


MANY = ["en", "en", "en", "é", "", None, "z"]


@pytest.mark.parametrize(
    "n,langs,options",
    [(1, ["en"], {}), (9, [None], {}), (65, ["en", None], {"depth": 1, "top": 2}), (600, MANY, {}), (600, MANY, {"depth": 1, "top": 1000}), (600, MANY, {"depth": 1, "top": 2}), (600, MANY, {"depth": 2, "top": 5})],
)
def test_trees_against_plain_ones(spark, n, langs, options):
    rows = rows_of(n, langs, n)
    assert told(manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)) == sorted(plain(rows), key=repr)


def test_more_groups_than_the_driver_takes(spark):
    rows = [(i, "s", f"lang{i % 70}", i, f"Text {i}") for i in range(200)]
    assert told(manifest(spark.createDataFrame(rows, SCHEMA), depth=1, top=5)) == sorted(plain(rows), key=repr)


def test_every_change_shows_and_nothing_else(spark):
    rows = rows_of(300, ["en", "de"], 3)
    verified = dict(manifest(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "verified").collect())
    for row in rows:
        changed = zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None and any("A" <= c <= "Z" for c in row[4])
        assert verified[row[0]] != changed


def test_odd_tables(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "s", None, 1, "Same"), (7, "s", None, 1, "Same"), (7, "s", None, 1, "Other"), (8, None, "", None, "A" * 300_000), (9, "1:a", "en", 3, "-")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("leaf", "root", "path", "id", "group_key", "at", "size", "block", "rows", "ordinal")})
    assert told(manifest(df)) == sorted(plain(rows), key=repr)
    assert manifest(df.where("false")).count() == 0


def test_one_row_many_times(spark):
    rows = [(5, "s", "en", 1, "Text")] * 700
    assert told(manifest(spark.createDataFrame(rows, SCHEMA), depth=1, top=20)) == sorted(plain(rows), key=repr)
