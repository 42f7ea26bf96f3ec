import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varietas.llm.packing import cut_lengths, load_encoder, pack, pack_lengths, sum_of_squares
from varietas.llm.packing import encode as encode_text

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, corpus, encode, capacity):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in corpus:
        ids = encode(text)
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            assert length == capacity or k == 0
            at += length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_all_tokens_are_packed_once(documents, corpus, encode):
    rows = pack(documents, FILE, capacity=256).collect()
    used = check(rows, corpus, encode, 256)
    assert used <= 1.05 * sum(r["length"] for r in rows) / 256 + 1


def test_groups_pack_apart(documents, corpus, encode):
    check(pack(documents, FILE, capacity=256, per_group=20).collect(), corpus, encode, 256)


def test_odd_tables(odd, empty):
    rows = pack(odd, FILE).collect()
    assert len(rows) == odd.count() and sum(r["length"] == 1 for r in rows) == 3
    assert pack(empty, FILE).count() == 0


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "  <|endoftext|>  \n x<|endoftext|", "<|endoftext"])
def test_special_tokens_as_the_tokenizer_has_them(text, encode):
    assert encode_text(load_encoder(FILE), text).tolist() == encode(text)[:-1]


def test_equal_rows_are_dealt_over_groups(spark):
    df = spark.createDataFrame([(None, "the same words")] * 300, "doc_id long, text string")
    groups = {r["sequence_id"] >> 32 for r in pack(df, FILE, per_group=50).collect()}
    assert len(groups) == 6


@pytest.mark.parametrize("sf, over", [("sf0.01", 1), ("sf0.1", 0)])
def test_driver_tables_need_no_more_than_best_fit_decreasing(sf, over):
    encoder = load_encoder(FILE)
    texts = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].fillna("")
    rest = [n for t in texts for n in cut_lengths(len(encode_text(encoder, t)) + 1, 1024) if n < 1024]
    gaps, opened = [], 0
    for n in sorted(rest, reverse=True):
        k = bisect.bisect_left(gaps, n)
        opened += k == len(gaps)
        gap = gaps.pop(k) if k < len(gaps) else 1024
        bisect.insort(gaps, gap - n)
    used = len(pack_lengths(rest, 1024))
    assert used <= opened + over and used <= -(-sum(rest) // 1024) + 3


def test_long_white_space(encode):
    for text in (" " * 1_500_000, "a  b" + " " * 1_200_000 + "b c", "x\n" + "\n\t \u3000" * 300_000 + "\n" + " " * 1_200_000 + "<|endoftext|>"):
        assert encode_text(load_encoder(FILE), text).tolist() == encode(text)[:-1]


def test_rule_against_its_definition():
    """Every placement has the least sum of squares among the open gaps that hold the item."""
    rng = np.random.default_rng(2)
    lengths, capacity = rng.integers(1, 40, 120).tolist(), 40
    gaps = []
    squares = lambda g: sum(g.count(x) ** 2 for x in set(g) if x)
    for n in lengths:
        options = [(squares([*gaps[:k], g - n, *gaps[k + 1 :]]), g) for k, g in enumerate(gaps) if g >= n]
        gap = min(options, default=(0, capacity))[1]
        if gap == capacity:
            gaps.append(capacity - n)
        else:
            gaps[len(gaps) - 1 - gaps[::-1].index(gap)] -= n
    found = sum_of_squares(lengths, capacity)
    assert sorted(capacity - sum(lengths[i] for i in s) for s in found) == sorted(gaps)


def test_repacking_comes_near_the_bound():
    lengths = np.random.default_rng(3).integers(1, 1024, 3000).tolist()
    found = pack_lengths(lengths, 1024)
    assert sorted(i for s in found for i in s) == list(range(3000)) and max(sum(lengths[i] for i in s) for s in found) <= 1024
    assert len(found) <= 1.01 * sum(lengths) / 1024 and pack_lengths([], 1024) == []


@pytest.mark.parametrize("n, want", [(1, [1]), (1024, [1024]), (1025, [1, 1024]), (3000, [952, 1024, 1024])])
def test_cuts(n, want):
    assert cut_lengths(n, 1024) == want
