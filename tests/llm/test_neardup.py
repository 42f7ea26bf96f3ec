import re
from collections import Counter

import numpy as np
import pytest

from varietas.llm.components import components
from varietas.llm.neardup import band_hashes, keep_one_of_each, near_duplicate_classes, near_links, occurrences, overlap, shingles_of, signatures
from varietas.llm.wordhash import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes_of(corpus, threshold=0.8):
    parent = {i: i for i, _ in corpus}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: shingles(t) for i, t in corpus}
    for i, t in corpus:
        for j, u in corpus:
            if j < i:
                a, b = bags[i], bags[j]
                same = (t or "") == (u or "") or bool(a) and bool(b) and sum((a & b).values()) >= threshold * sum((a | b).values())
                if same and find(i) != find(j):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in corpus}


def test_classes_against_all_pairs(documents, corpus):
    found = near_duplicate_classes(documents)
    assert found.columns == ["doc_id", "class_id"]
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == classes_of(corpus)


def test_one_of_each_stays(documents, corpus):
    kept = keep_one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes_of(corpus).values()))


def test_a_crowd_whose_members_are_only_sometimes_near(spark):
    """Copies of one text with edits of their own: links that no pivot sees must still be found."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(130)]
    corpus = []
    for i in range(80):
        own = list(base)
        for k in rng.choice(130, rng.integers(1, 7), replace=False):
            own[k] = f"x{rng.integers(12)}"
        corpus.append((i, " ".join(own)))
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(df).collect()} == classes_of(corpus)


def test_odd_tables(odd, empty):
    found = sorted((tuple(r) for r in near_duplicate_classes(odd).collect()), key=str)
    assert found == sorted([(None, 8), (None, 7), (7, 7), (7, 7), (7, 7), (8, 8), (9, 8)], key=str)
    assert sorted(r["doc_id"] for r in keep_one_of_each(odd).collect()) == [7, 8]
    assert near_duplicate_classes(empty).count() == 0 and keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("edits", [6, 20, 60])
def test_signatures_are_unbiased(edits):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 300, 500)]
    other = list(base)
    for i in rng.choice(500, edits, replace=False):
        other[i] = "zz"
    texts = [" ".join(base * 3), " ".join(other * 2 + base)]
    a, b = map(shingles, texts)
    want = sum((a & b).values()) / sum((a | b).values())
    bags = shingles_of(words_of(texts))
    s = signatures(*bags, 2, 4000)
    doc, h = occurrences(*bags)
    assert overlap(np.sort(h[doc == 0]), np.sort(h[doc == 1])) == pytest.approx(want)
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.03) and np.isfinite(s).all()


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g h", "x", "", "a b c d e f g h"]
    one = [band_hashes(signatures(*shingles_of(words_of([t])), 1)) for t in texts if t]
    all_ = band_hashes(signatures(*shingles_of(words_of(texts)), 4))
    assert (all_[[0, 1, 3]] == np.concatenate(one)).all() and (all_[0] == all_[3]).all()


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(500, 600 + i) for i in range(40)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links + [(1, 1), (None, 3)], "a long, b long")).collect()}
    label = {n: n for e in links for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_links_without_buckets(spark, empty):
    nodes = spark.createDataFrame([], "doc long, bands array<long>")
    assert near_links(empty, nodes).count() == 0
