"""Token counts of a unigram vocabulary without building the tokens.

For every text the best-scoring segmentation into vocabulary pieces is found by dynamic programming
over the pieces that an Aho-Corasick automaton finds, carrying only the best score and its number of
tokens. Ties, unknown characters and byte fallback follow the public ``tokenizers`` Unigram model:
of equally good ways to reach a place, the one whose last piece begins first (the longest) stays; a
character that is no piece costs the lowest score less 10 and becomes its UTF-8 bytes.

A vocabulary piece has its blanks, if any, in front. So no piece spans the place between another
character and a blank, the best segmentation is made of those of the chunks between these places,
and chunks are counted once and then looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import text_or_empty

BLANK = "▁"
#: How far below the lowest piece an unknown character scores, in the public unigram model.
UNKNOWN_PENALTY = 10.0
#: Chunks remembered by a task before it starts anew, which bounds its memory.
REMEMBERED = 500_000


class UnigramCounter:
    """Counts tokens for ``pieces`` = [(piece, score)], byte pieces such as <0x0A> left out."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        if any(BLANK in p.lstrip(BLANK) for p, _ in pieces):
            self.chunks = re.compile(r"(?s).+")
        self.known: dict[str, int] = {}

    def of_chunk(self, chunk: str) -> int:
        """Tokens of the best segmentation of ``chunk`` by dynamic programming, while the automaton reads it.

        Only the states that the longest piece may reach back to are held, in a ring.
        """
        size = min(len(chunk), self.longest) + 1
        best, count = [0.0] * size, [0] * size
        matches = self.automaton.iter(chunk)
        at, match = next(matches, (-1, None))
        for end, char in enumerate(chunk):
            ways = []
            while at == end:
                ways.append(match)
                at, match = next(matches, (-1, None))
            if len(ways) > 1:
                ways.sort(reverse=True)
            if char not in self.single:
                ways.append((1, None))
            top = None
            for length, score in ways:
                begin = (end + 1 - length) % size
                sum_ = best[begin] + (self.unknown if score is None else score)
                if top is None or sum_ > top:
                    top, tokens = sum_, count[begin] + (len(char.encode("utf-8", "surrogatepass")) if score is None else 1)
            best[(end + 1) % size], count[(end + 1) % size] = top, tokens
        return count[len(chunk) % size]

    def __call__(self, text: str) -> int:
        """Tokens of ``text``, a blank put in front as the tokenizer does; 0 for an empty text."""
        if not text:
            return 0
        known, total = self.known, 0
        marked = BLANK + text.replace(" ", BLANK)
        for chunk in self.chunks.findall(marked):
            n = known.get(chunk)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.of_chunk(chunk)
                if len(chunk) <= 64:
                    known[chunk] = n
            total += n
        return total


def read_pieces(model_file: str) -> list[tuple[str, float]]:
    """The ordinary pieces and scores of a sentencepiece model file, read with its library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


@lru_cache(maxsize=1)
def _counter(model_file: str) -> UnigramCounter:
    return UnigramCounter(read_pieces(model_file))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and n_tokens (long) of each row of ``docs`` (doc_id, text).

    ``model_file`` is the place of a sentencepiece model on every node; its pieces and scores serve
    as the unigram vocabulary.

    Defined cases: null and empty texts have 0 tokens; texts of any length are counted whole; null
    and repeated doc_ids are rows like others; an empty table gives no rows; other columns are not
    read.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(model_file)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [count(t) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, f"doc_id {kind}, n_tokens long")
