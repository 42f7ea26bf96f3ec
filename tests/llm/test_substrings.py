import hashlib
from itertools import groupby

import numpy as np
import pytest

from varietas.llm import substrings
from varietas.llm.substrings import DEPTH, Chunk, radix_repeats, remove_repeats


def brute(corpus):
    seen, out = set(), {}
    for i, text in sorted(corpus, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - DEPTH + 1):
            window = raw[at : at + DEPTH]
            if window in seen:
                gone[at : at + DEPTH] = b"\1" * DEPTH
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(k for k, _ in groupby(gone)), hashlib.sha256(kept).hexdigest())
    return out


def rows_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_against_all_windows(documents, corpus):
    assert rows_of(remove_repeats(documents)) == brute(corpus)


def test_many_blocks_under_one_digit(spark):
    """More different surroundings of one passage than are sorted under one digit."""
    rng = np.random.default_rng(1)
    noise = lambda: "".join(rng.choice(list("abcdefgh "), 120))
    passage = "".join(rng.choice(list("stuvwxyz "), 260))
    corpus = [(i, noise() + passage + noise()) for i in range(substrings.MANY + 60)]
    for parts in (1, 4):
        df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(parts)
        assert rows_of(remove_repeats(df)) == brute(corpus)


def test_runs_hold_every_window_once():
    texts = [b"x" * 99, b"y" * 150, b"", bytes(np.random.default_rng(2).integers(97, 123, 5000, dtype=np.uint8)), b"ab" * 200]
    doc, low, high, anchor = Chunk(texts).runs()
    first = np.cumsum([0, *map(len, texts)])
    windows = [w for a, b in zip(low, high) for w in range(a, b + 1)]
    assert sorted(windows) == [w for d, t in enumerate(texts) for w in range(first[d], first[d] + max(len(t) - DEPTH + 1, 0))]
    assert ((anchor >= high) & (anchor <= low + DEPTH - 16)).all() and (first[doc] <= low).all()


def test_radix_passes():
    rng = np.random.default_rng(3)
    raw = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (130, 140, 120)]
    raw += [raw[0][5:125], raw[1]]
    ones = np.ones(len(raw), dtype=np.int64)
    row, window = radix_repeats(ones, np.arange(len(raw)), 0 * ones, 50 * ones - np.array([0, 0, 0, 5, 0]), raw)
    assert set(zip(row.tolist(), window.tolist())) == {(3, w) for w in range(21)} | {(4, w) for w in range(41)}


def test_odd_tables(odd, empty):
    assert remove_repeats(odd).count() == odd.count() and remove_repeats(empty).count() == 0


def test_repeated_ids_and_rows(spark):
    text = "some text that is longer than a hundred bytes, so that its second coming can be told from the first one"
    rows = remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 0, len(text), len(text)]
    assert [r["doc_id"] for r in rows if r["n_removed"] == 0 and r["n_bytes"]] == [1]


@pytest.mark.parametrize("text", ["é" * 120, "a" * 5000, "xyz" * 400])
def test_repeats_within_a_text(spark, text):
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    assert rows_of(remove_repeats(df)) == brute([(0, text)])
