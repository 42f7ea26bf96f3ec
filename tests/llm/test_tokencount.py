import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from varietas.llm.tokencount import BLANK, UnigramCounter, read_pieces, token_counts

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def exact():
    pieces = read_pieces(FILE)
    low = min(s for _, s in pieces)
    tokenizer = Tokenizer(models.Unigram([("<unk>", low), *pieces, *((f"<0x{b:02X}>", low) for b in range(256))], unk_id=0, byte_fallback=True))
    return lambda text: len(tokenizer.encode(BLANK + text.replace(" ", BLANK)).ids) if text else 0


def test_counts_equal_the_tokenizers(documents, corpus, exact):
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts(documents, FILE).collect()}
    assert found == {i: exact(t or "") for i, t in corpus}


@pytest.mark.parametrize("text", ["a\n\nb", "  two  blanks ", "日本語 😀😀 x", "<unk> <0x0A>", "   ", BLANK, "naïvé", "word" * 50])
def test_edges(text, exact):
    assert UnigramCounter(read_pieces(FILE))(text) == exact(text)


def test_ties_keep_the_longest_last_piece():
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -4.0), ("c", -2.0), (BLANK, -1.0)]
    tokenizer = Tokenizer(models.Unigram([("<unk>", -4.0), *pieces], unk_id=0))
    count = UnigramCounter(pieces)
    for text in ("ab", "abc", "abab", "cab", "abcab"):
        assert count(text) == len(tokenizer.encode(BLANK + text).ids)


def test_pieces_across_blanks_are_counted_whole():
    pieces = [("a", -1.0), ("b", -1.0), (BLANK, -1.0), (f"a{BLANK}b", -1.0)]
    assert UnigramCounter(pieces)("a b") == 2


def test_odd_tables(odd, empty):
    assert sorted(r["n_tokens"] for r in token_counts(odd, FILE).collect())[:3] == [0, 0, 0]
    assert token_counts(empty, FILE).count() == 0


def test_long_texts_without_blanks(exact):
    """The states held don't grow with the text, and the count is the tokenizer's."""
    rng = random.Random(4)
    count = UnigramCounter(read_pieces(FILE))
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    assert count(text) == exact(text)
    long = text * 20
    tracemalloc.start()
    count(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(long)
