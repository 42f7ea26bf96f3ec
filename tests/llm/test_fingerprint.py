import hashlib
import statistics

import pytest

from varietas.llm.fingerprint import fingerprint, fingerprint_edited, hashes, likeness, parse, render, smallest


def print_of(text):
    parse(text, phrases := set(), 0, 0)
    return smallest(hashes(phrases))


def want(corpus):
    docs = sorted(((i, t or "") for i, t in corpus), reverse=True)
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        a, b, c = print_of(t), print_of(edited), print_of(following)
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), render(a), render(b), likeness(a, b), likeness(a, c))


@pytest.mark.parametrize("bytes_per_task", [1 << 30, 3000])
def test_every_document_meets_its_next(documents, corpus, bytes_per_task):
    found = fingerprint_edited(documents, bytes_per_task=bytes_per_task)
    assert sorted(map(tuple, found.collect())) == sorted(want(corpus))


def test_edited_texts_are_nearer_than_next_ones(corpus):
    rows = [r for r in want(corpus) if r[1] > 300]
    assert statistics.median(r[5] for r in rows) > 0.4 > statistics.median(r[6] for r in rows)


def test_phrases():
    parse("aababbbab", phrases := set(), 0, 0)
    assert phrases == {"a", "ab", "abb", "b"}
    assert likeness([], []) == 1 and likeness([], [1]) == 0 and likeness([1, 2], [1, 2]) == 1 and likeness([1], [2]) == 0


def test_equal_texts_have_equal_prints(documents, corpus):
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprint(documents).collect()}
    by_text = {}
    for i, t in corpus:
        assert by_text.setdefault(t or "", found[i]) == found[i]


def test_odd_tables(spark, odd, empty):
    rows = fingerprint_edited(odd).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 2
    assert fingerprint_edited(empty).count() == 0 and fingerprint(empty).count() == 0
    one = fingerprint_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
