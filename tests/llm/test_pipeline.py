import functools
import itertools
import random
import re
from collections import Counter

import pytest

from varietas.llm.decontaminate import contamination
from varietas.llm.neardup import near_duplicate_classes
from varietas.llm.secretscan import base_spans
from varietas.llm.toxicity import fit

from .conftest import words

pipeline = pytest.importorskip("corpus_pipeline")
BAD = ["vilenessa", "grumbolt"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(3), str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(words(rng, 25))
    rows, toxic = [], {}
    for i in range(150):
        own = words(rng, rng.randint(30, 90))
        if i % 5 == 0:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(BAD)
        toxic[i] = int(i % 5 == 0)
        if i % 7 == 1:
            own[5:5] = passage.split(" ")
        if i % 9 == 2:
            own[3:3] = ["password=c1f6c02f845bf3028d"]
        text = rows[i - 3][1] if i % 25 == 4 else " ".join(own)
        rows.append((i, text, "en", "src", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    results, names = [docs], [n for n, _ in pipeline.STAGES]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, results[-1], tables).cache()
        assert out.columns == docs.columns
        results.append(out)
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in results]
    assert names == ["toxicity", "near duplicates", "benchmark decontamination", "secrets", "packing"]
    gone = set(texts[0]) - set(texts[1])
    assert len(gone & set(range(0, 150, 5))) >= 27 and len(gone - set(range(0, 150, 5))) <= 3
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(results[1]).collect()}
    assert set(texts[2]) == set(classes.values()) < set(texts[1])
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    hit = {r["doc_id"] for r in contamination(results[2], bench).where("contaminated").collect()}
    assert hit and set(texts[3]) == set(texts[2]) - hit
    assert set(texts[4]) == set(texts[3]) and any(base_spans(t) for t in texts[3].values()) and not any(base_spans(t) for t in texts[4].values())
    packed = pipeline.STAGES[-1][1](spark, results[-1], tables)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(texts[4])


def test_run_applies_all_stages(spark, tables):
    assert {"doc_id", "sequence_id", "offset"} <= set(pipeline.run(spark, tables).columns)


def by_hand(rows, labels, passage, spark, folder):
    """The rows that each stage keeps, (doc_id, text, extra), by plain loops."""
    net = fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    kept = [r for r, s in zip(rows, net.scores([r[1] or "" for r in rows])) if s < 0.5]
    yield kept
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    @functools.cache
    def shingles(text):
        w = split(text)
        return Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()

    def near(a, b):
        x, y = shingles(a), shingles(b)
        if not x or not y:
            return (a or "") == (b or "")
        common = sum(min(n, y[k]) for k, n in x.items() if k in y)
        return common >= 0.8 * (x.total() + y.total() - common)

    named = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])
    group = {r[0]: r[0] for r in named}
    for a, b in itertools.combinations(named, 2):
        if group[a[0]] != group[b[0]] and near(a[1], b[1]):
            low, high = sorted((group[a[0]], group[b[0]]))
            group = {k: low if g == high else g for k, g in group.items()}
    ones = {}
    for r in named:
        if group[r[0]] == r[0]:
            ones.setdefault(r[0], r)
    texts = {r[1] or "" for r in named}
    lone = {r[1]: r for r in kept if r[0] is None and (r[1] or "") not in texts}
    kept = [*ones.values(), *lone.values()]
    yield kept
    wanted = split(passage)
    windows = {tuple(wanted[k : k + 10]) for k in range(len(wanted) - 9)}
    kept = [r for r in kept if windows.isdisjoint(tuple(split(r[1])[k : k + 10]) for k in range(len(split(r[1])) - 9))]
    yield kept
    yield [(i, t and re.sub(r"password=[0-9a-f]{18}", "[SECRET]", t), x) for i, t, x in kept]


def test_odd_rows_against_plain_loops(spark, tmp_path):
    rng, folder = random.Random(12), str(tmp_path)
    passage = " ".join(words(rng, 20))
    rows = [(i, " ".join(words(rng, rng.randint(20, 60)) + (BAD * 3 if i % 6 == 0 else [])), f"x{i}") for i in range(90)]
    rows += [(100, rows[1][1] + " tail", "near"), (101, rows[1][1], "copy"), (2, rows[2][1], "x2"), (102, passage + " and more", "leak"), (103, "key password=c1f6c02f845bf3028d end", "secret")]
    rows += [(104, None, "null"), (105, "", None), (None, None, None), (None, "only here, without an id, in this one place", "lone"), (None, rows[3][1], "named elsewhere"), (106, " ".join(words(rng, 6_000)), "long"), (107, "...", "no words")]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(90)], "doc_id long, toxic int")
    spark.createDataFrame([(i, t, x, x) for i, t, x in rows], "doc_id long, text string, key string, bucket string").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, hand = spark.read.parquet(f"{folder}/documents.parquet"), by_hand(rows, labels, passage, spark, folder)
    for (name, stage), want in zip(pipeline.STAGES[:-1], hand):
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "key", "bucket"]
        got = sorted(repr((r["doc_id"], r["text"], r["key"])) for r in docs.collect())
        assert got == sorted(map(repr, want)), name
    assert len(docs.collect()) < len(rows) - 15
    packed = pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count()
    assert packed == docs.select("doc_id").distinct().count()


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, key string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert all(stage(spark, docs, folder).count() == 0 for _, stage in pipeline.STAGES)
