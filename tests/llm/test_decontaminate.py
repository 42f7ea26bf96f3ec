import hashlib
import pickle
import random
import re
import time

import pytest

from varietas.llm.decontaminate import TestWindows as Windows
from varietas.llm.decontaminate import contamination, keep_uncontaminated, scan

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    own, hit, ids = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids.add("" if item is None else str(item))
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(1)
    texts = dict(corpus)
    cut = lambda i, a, b: " ".join((texts[i] or "").split(" ")[a:b])
    return [(1, cut(3, 0, 12).upper()), (22, cut(6, 5, 40)), (3, cut(6, 5, 40)), (4, "one two"), (5, " ".join(words(rng, 30))), (None, cut(9, 2, 14)), (7, None), (8, ""), (9, "..."), (10, "日本語 テスト 日本語"), (10, cut(12, 0, 11)), (11, "ab " * 15)]


@pytest.mark.parametrize("width, block", [(10, 16 << 20), (10, 60), (3, 200)])
def test_against_all_windows(spark, documents, corpus, items, width, block):
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_hit int")
    found = contamination(documents, bench, width, block)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    want = {i: brute(t, items, width) for i, t in corpus}
    assert got == want
    kept = keep_uncontaminated(documents, bench, width, block)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[4]}


def test_longest_match():
    item = " ".join(f"w{i}" for i in range(30))
    windows = Windows([(1, item)], 10)
    texts = ["x " + " ".join(f"w{i}" for i in range(4, 22)) + " y", item + " " + item, "w1 w2"]
    assert [longest for _, _, _, longest in scan(texts, windows)] == [(18, 1, "1", 4), (30, 0, "1", 0), None]


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_places_of_the_longest_match(spark, documents, corpus, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, own = {i: split(t) for i, t in corpus}, {}
    for item, t in items:
        own.setdefault("" if item is None else str(item), []).append(split(t))
    found = contamination(documents, bench, 10, block).where("contaminated").collect()
    for r in found:
        here = texts[r["doc_id"]][r["longest_at"] : r["longest_at"] + r["longest"]]
        assert any(w[r["longest_item_at"] : r["longest_item_at"] + r["longest"]] == here for w in own[r["longest_item"]])
    assert found and {r["doc_id"]: (r["longest"], r["longest_at"]) for r in found} == {r["doc_id"]: (r["longest"], r["longest_at"]) for r in contamination(documents, bench, 10).where("contaminated").collect()}


def test_very_long_text_and_repeated_rows(spark):
    long = "x y " * 400_000 + "a b c d e f g h i j " + "z " * 10
    docs = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (None, None, None), (2, "", "")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, "a b c d e f g h i j")], "item_id long, text string")
    assert sorted((r["n_words"], r["n_hit"]) for r in contamination(docs, bench).collect()) == [(0, 0), (0, 0), (800_020, 10), (800_020, 10)]
    assert keep_uncontaminated(docs, bench).count() == 2


def test_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd, none).where("contaminated").count() == 0 and contamination(odd, none).count() == odd.count()
    assert contamination(empty, none).count() == 0 and keep_uncontaminated(odd, none).count() == odd.count()


def longest_by_loops(text, items, width):
    """(words, first word, item, first word there) of the longest common run of at least a window, of equal ones the first."""
    own, best = split(text), None
    for item, t in items:
        w = split(t)
        least = min(width, len(w))
        for a in range(len(own) if w else 0):
            for p in range(len(w)):
                n = 0
                while a + n < len(own) and p + n < len(w) and own[a + n] == w[p + n]:
                    n += 1
                if n >= least and (best is None or (-n, a, str(item), p) < (-best[0], *best[1:])):
                    best = (n, a, str(item), p)
    return best


def test_longest_match_against_loops():
    rng = random.Random(5)
    for letters in ("a", "ab", "abc"):
        for _ in range(60):
            some = lambda most: " ".join(rng.choices(letters, k=rng.randrange(most)))  # noqa: E731, B023
            items = [(k, some(14)) for k in range(rng.randrange(1, 5))]
            text = some(40) + " z " + some(20)
            (n_words, hit, ids, longest), want = next(scan([text], Windows(items, 3))), brute(text, items, 3)
            assert (n_words, len(hit), len(ids)) == want[:3] and longest == longest_by_loops(text, items, 3)


def test_repeated_words_and_shared_windows_take_little_time():
    begun = time.time()
    n, hit, ids, longest = next(scan(["ab " * 1_000_000], Windows([(1, "ab " * 500)], 10)))
    assert (n, len(hit), ids, longest) == (1_000_000, 1_000_000, {"1"}, (500, 0, "1", 0))
    head = " ".join(f"h{k}" for k in range(10))
    shared = Windows([(k, f"{head} own{k} words{k}") for k in range(3_000)], 10)
    (_, hit, ids, longest), = scan([" x ".join([head] * 300)], shared)
    assert len(hit) == 3_000 and len(ids) == 3_000 and longest == (10, 0, "0", 0)
    assert time.time() - begun < 30


def test_a_block_is_about_as_large_as_its_windows(spark):
    from varietas.llm.decontaminate import benchmark_blocks

    rng = random.Random(8)
    bench = spark.createDataFrame([(k, " ".join(str(rng.random()) for _ in range(200))) for k in range(300)], "item_id long, text string")
    blocks = list(benchmark_blocks(bench, 10, 1 << 20))
    assert sum(len(b) for b in blocks) == 300 and len(blocks) > 1
    assert all(len(pickle.dumps(Windows(b, 10))) < 1.2 * (1 << 20) for b in blocks)
