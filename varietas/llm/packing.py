"""Sum-of-squares packing of token sequences.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. A piece of full length
is a sequence by itself. Each other piece, the longest first, goes to the place among the open
sequences that hold it where the squared counts of open sequences per residual gap sum to the least; only
where none holds it is a sequence opened. Unfilled sequences are then taken apart and packed again by the
same rule. The packing runs in groups of a fixed number of pieces side by side; what one group
leaves open is far below one sequence in a hundred.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for, text_or_empty

#: Pieces that one task packs; below the rows of a group the loss of packing in groups would show.
PIECES_PER_GROUP = 50_000

#: White space as the vocabulary's pattern has it, in runs that its search for a run's end may not get through.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")

#: Rounds in which a group takes unfilled sequences apart and packs their pieces again.
REPACK_ROUNDS = 4


@lru_cache(maxsize=1)
def load_encoder(tokenizer_json: str):
    """A fast encoder with the vocabulary of a byte-level BPE file of the ``tokenizers`` library.

    Ids in such a file follow the order of its merges, so they serve as ranks. As in that library, the
    string of a special token in a text is that token.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(tokenizer_json, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(encoder, text: str) -> np.ndarray:
    """Ids of ``text``, whatever its length.

    In a run of about a million white space characters the pattern's search gives up. All of such a run
    but its last character, or all of it at the end of the text or before a special token, is one piece for
    the merges, and nothing before it depends on it, so the text can be divided there.
    """
    try:
        return encoder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        ids, special = [], "|".join(map(re.escape, sorted(encoder.special_tokens_set))) or "(?!)"
        for part in re.split(f"({special})", text):
            at = 0
            for m in LONG_SPACE.finditer(part):
                end = m.end() if m.end() == len(part) else m.end() - 1
                ids += [encoder.encode_to_numpy(part[at : m.start()], disallowed_special=()), encoder._encode_single_piece(part[m.start() : end])]
                at = end
            ids.append(encoder.encode_to_numpy(part[at:], allowed_special="all"))
        return np.concatenate(ids).astype(np.uint32)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: full ones, and the remainder, if any, in front."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(tokenizer_json)
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encode(encoder, text).astype("<u4").tobytes() + end
                start = 0
                for i, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": pdf["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: list[int], capacity: int, filled: list[list[int]] | None = None, items: list[int] | None = None) -> list[list[int]]:
    """Sequences as lists of item numbers, after placing ``items`` (default: all) in the order given.

    open_[g] counts open sequences of residual gap g. An item of length n that enters gap g changes
    the sum of squares by 2 * (open_[g - n] - open_[g]) + 2, where a closed sequence (gap 0) counts
    nothing. A new sequence is opened where no gap holds the item. Of equally good gaps the smallest is
    taken, and of its sequences the last opened. ``filled`` are sequences that exist already.
    """
    sequences = [list(s) for s in filled or ()]
    open_ = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for at, own in enumerate(sequences):
        if gap := capacity - sum(lengths[i] for i in own):
            stacks[gap].append(at)
            open_[gap] += 1
    for i in range(len(lengths)) if items is None else items:
        n = lengths[i]
        change = 2 * (open_[: capacity + 1 - n] - open_[n:]) + 2
        change[0] -= 1
        change[open_[n:] == 0] = np.iinfo(np.int64).max
        at_best = int(change.argmin())
        gap = n + at_best if open_[n + at_best] else capacity
        if gap == capacity:
            at = len(sequences)
            sequences.append([])
        else:
            at = stacks[gap].pop()
            open_[gap] -= 1
        sequences[at].append(i)
        if gap > n:
            stacks[gap - n].append(at)
            open_[gap - n] += 1
    return sequences


def pack_lengths(lengths: list[int], capacity: int, rounds: int = REPACK_ROUNDS) -> list[list[int]]:
    """Sum-of-squares packing, longest first, then repacking of what is not full.

    A round takes the sequences with gaps apart, the wider half of them and all of them in turn, and
    places their items anew by the same rule; it stays only if no more sequences result.
    """
    by_length = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best = sum_of_squares(lengths, capacity, items=by_length)
    for k in range(rounds):
        gaps = sorted(((capacity - sum(lengths[i] for i in s), at) for at, s in enumerate(best)), key=lambda x: (-x[0], x[1]))
        open_ = [at for gap, at in gaps if gap]
        apart = set(open_[: -(-len(open_) // 2)] if k % 2 == 0 else open_)
        loose = sorted((i for at in apart for i in best[at]), key=lambda i: (-lengths[i], i))
        again = sum_of_squares(lengths, capacity, [s for at, s in enumerate(best) if at not in apart], loose)
        if len(again) <= len(best):
            best = again
    return best


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 2, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """All tokens of ``docs`` (doc_id, text), each text ended by ``end_id``, packed into sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. Only
    documents above ``capacity`` tokens are cut, the remainder first.

    Defined cases: null and empty texts are one piece that holds ``end_id`` alone; null and repeated
    doc_ids are rows like others; texts of any length are tokenised whole; an empty table gives no
    rows; other columns are not read.
    """
    all_ = cut(pieces(docs, tokenizer_json, capacity, end_id))
    full = all_.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = all_.where(F.col("length") < capacity)
    groups = parts_for(rest.count(), per_group)
    nth = F.monotonically_increasing_id()  # of checkpointed rows, so it stays; equal rows differ in it
    part = F.pmod(F.xxhash64(nth), F.lit(groups)).cast("int")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        held = pd.concat(got, ignore_index=True)
        for group, own in held.groupby("group", sort=True):
            own = own.sort_values(["order", "ids_crc32"], kind="stable")
            lengths = own["length"].tolist()
            sequence, offset = np.empty(len(own), dtype=np.int64), np.empty(len(own), dtype=np.int64)
            for at, items in enumerate(pack_lengths(lengths, capacity)):
                begin = 0
                for i in items:
                    sequence[i], offset[i] = at, begin
                    begin += lengths[i]
            yield own.drop(columns=["group", "order"]).assign(sequence_id=(int(group) << 32) + sequence, offset=offset)

    packed = (
        rest.withColumns({"group": part, "order": F.xxhash64("ids_crc32", "doc_id", "start")})
        .repartitionById(groups, F.col("group"))
        .mapInPandas(run, full.schema)
    )
    return full.unionByName(packed)
