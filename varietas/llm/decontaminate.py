"""Benchmark decontamination by suffix arrays of the training text.

Each task treats its documents as training shards: it sorts the word suffixes of a shard, to the
depth of a window, into a suffix array, and finds every suffix of the benchmark by binary search
in it. A suffix whose words don't stay in the benchmark's vocabulary for as long as its shortest
window can't match, so it is left out of the array; on other text the array is short. An interval
of the array gives the verbatim places of a window; neighbouring places on one diagonal chain into
longest matches. The benchmark goes to the tasks in blocks of bounded size, one pass over the documents
for each: its windows are sorted once, on the driver, and broadcast, and the hits of a pass are written.
Words are compared by 64-bit hashes.

Documents aren't shuffled, and no row meets another one: a passage that many documents share costs
each of them its own matches only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty
from .wordhash import Words, words_of

#: Bytes of benchmark windows that one pass over the documents takes along.
BLOCK_BYTES = 16 << 20


class TestWindows:
    """The windows of a block of benchmark items, as sorted keys of word numbers.

    A window is ``width`` consecutive words of an item, or the whole of a shorter item. Word numbers
    are dense and start at 1; 0 stands for any word outside the block. Keys are big-endian, so that
    they compare as bytes like the word sequences they stand for.
    """

    def __init__(self, items: list[tuple[object, str]], width: int):
        words = words_of([t for _, t in items])
        self.width, self.vocabulary = width, np.unique(words.hashes)
        numbers = self.numbers(words.hashes)
        size = np.diff(words.first)
        own = np.minimum(size, width)
        count = np.where(size > 0, size - own + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        padded = np.concatenate([numbers, np.zeros(width, dtype=np.uint32)])
        grid = padded[(words.first[:-1][item] + at)[:, None] + np.arange(width)].astype(">u4")
        beyond = np.arange(width) >= own[item][:, None]
        grid[beyond] = 0
        self.low, first, which = np.unique(np.ascontiguousarray(grid).view(f"S{4 * width}").ravel(), return_index=True, return_inverse=True)
        self.lengths = own[item][first].astype(np.int32)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.window, self.item, self.at = which.astype(np.int32), item.astype(np.int32), at.astype(np.int32)
        self.by_window = np.argsort(which, kind="stable").astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(self.low)))]).astype(np.int32)
        self.ids = ["" if i is None else str(i) for i, _ in items]

    def high(self) -> np.ndarray:
        """The largest keys that begin with the windows' words; those of whole windows are ``low`` itself."""
        short = np.flatnonzero(self.lengths < self.width)
        out = self.low.copy()
        grid = np.frombuffer(self.low[short].tobytes(), dtype=">u4").reshape(-1, self.width).copy()
        grid[np.arange(self.width) >= self.lengths[short][:, None]] = 0xFFFFFFFF
        out[short] = grid.view(f"S{4 * self.width}").ravel()
        return out

    def places(self, windows: np.ndarray) -> np.ndarray:
        """Where any of the windows, distinct numbers, stands, by ``window``, ``item`` and ``at``."""
        count = self.begin[windows + 1] - self.begin[windows]
        return self.by_window[np.repeat(self.begin[windows] - (np.cumsum(count) - count), count) + np.arange(count.sum())]

    def name(self, item: int) -> str:
        """The id of an item as text, empty if it has none."""
        return self.ids[item]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


def suffix_array(numbers: np.ndarray, first: np.ndarray, width: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the suffixes that can match, in the order of their first ``width`` words.

    ``numbers`` holds the word numbers of a shard whose documents begin at ``first``; a key ends
    with zeros at the end of its document and after its first word outside the vocabulary.
    """
    inside = np.flatnonzero(numbers)
    begins = np.zeros(len(numbers) + 1, dtype=bool)
    begins[first] = True
    breaks = np.flatnonzero(begins[inside] | (np.diff(inside, prepend=-2) != 1))
    lengths = np.diff(np.concatenate([breaks, [len(inside)]]))
    run = np.repeat(breaks + lengths, lengths) - np.arange(len(inside))
    kept = run >= max(shortest, 1)
    places, run = inside[kept], run[kept]
    padded = np.concatenate([numbers, np.zeros(width, dtype=np.uint32)])
    grid = padded[places[:, None] + np.arange(width)]
    grid[np.arange(width) >= run[:, None]] = 0
    order = np.lexsort(grid.T[::-1]) if len(places) else np.array([], dtype=np.int64)
    keys = np.ascontiguousarray(grid[order].astype(">u4")).view(f"S{4 * width}").ravel()
    return places[order], keys


def matches(words: Words, windows: TestWindows) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shard, window) of every verbatim occurrence, ordered by place."""
    if not len(windows.low):
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    places, keys = suffix_array(windows.numbers(words.hashes), words.first, windows.width, windows.shortest)
    if not len(places):
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    low, high = np.searchsorted(keys, windows.low), np.searchsorted(keys, windows.high(), side="right")
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    at = places[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    order = np.lexsort((which, at))
    return at[order], which[order]


#: A longest match: words, first word in the document, item id and first word there.
Match = tuple[int, int, str, int]


def _of_document(at: np.ndarray, which: np.ndarray, begin: int, windows: TestWindows) -> tuple[np.ndarray, np.ndarray, Match]:
    """Hit words of one document (relative), the items found, and its longest verbatim match, of equal ones the first."""
    at, lengths = at - begin, windows.lengths[which]
    end = int((at + lengths).max())
    edges = np.bincount(at, minlength=end + 1) - np.bincount(at + lengths, minlength=end + 1)
    items = np.unique(windows.item[windows.places(np.unique(which))])
    return np.flatnonzero(np.cumsum(edges) > 0), items, _longest(at, which, items, windows)


def _longest(at: np.ndarray, which: np.ndarray, items: np.ndarray, windows: TestWindows) -> Match:
    """The longest run of windows that stand in a row in the document and in one of the ``items``.

    Runs of 1, 2, 4, ... windows are numbered, those of the document and the items alike, so that equal numbers are
    equal runs, until the document shares none with an item; the longest shared run is put together from them. The
    work grows with the windows of the document and the items and the logarithm of the run, however often they repeat.
    """
    whole = windows.lengths[which] == windows.width
    if not whole.any():
        n = windows.lengths[which]
        i = np.lexsort((at, -n))[0]
        return int(n[i]), int(at[i]), *_first_place(windows.places(which[i : i + 1]), windows)
    at, which = at[whole], which[whole]
    place = np.flatnonzero(np.isin(windows.item, items))
    own_gap = np.cumsum(np.diff(at, prepend=at[0]) > 1)
    item_gap = np.cumsum(np.diff(windows.item[place], prepend=windows.item[place[0]]) > 0)
    own = np.zeros(len(at) + own_gap[-1] + 1, dtype=np.int64)
    own[np.arange(len(at)) + own_gap] = which + 1
    theirs = np.zeros(len(place) + item_gap[-1] + 1, dtype=np.int64)
    theirs[np.arange(len(place)) + item_gap] = windows.window[place] + 1
    split, runs, length = len(own), [np.concatenate([own, theirs])], 1
    while (longer := _joined(runs[-1], runs[-1], length, split)).any():
        runs.append(longer)
        length *= 2
    found = runs[-1]
    for k in range(len(runs) - 2, -1, -1):
        longer = _joined(found, runs[k], length, split)
        if longer.any():
            found, length = longer, length + (1 << k)
    first = np.flatnonzero(found[:split])[0]
    same = np.flatnonzero(found[split:] == found[first])
    inside = np.flatnonzero(theirs > 0)
    a = int(at[np.searchsorted(np.arange(len(at)) + own_gap, first)])
    return length - 1 + windows.width, a, *_first_place(place[np.searchsorted(inside, same)], windows)


def _joined(a: np.ndarray, b: np.ndarray, length: int, split: int) -> np.ndarray:
    """Numbers of the runs a at each place followed by b ``length`` places on; 0 where either is missing or one side of ``split`` lacks the run."""
    out = np.zeros(len(a), dtype=np.int64)
    left, right = a[: max(len(a) - length, 0)], b[length:]
    there = np.flatnonzero((left > 0) & (right > 0))
    values, number = np.unique(left[there] << 32 | right[there], return_inverse=True)
    shared = np.zeros(len(values), dtype=bool)
    shared[number[there < split]] = True
    beyond = np.zeros(len(values), dtype=bool)
    beyond[number[there >= split]] = True
    out[there] = np.where((shared & beyond)[number], number + 1, 0)
    return out


def _first_place(places: np.ndarray, windows: TestWindows) -> tuple[str, int]:
    """Of places of windows the first: by the item's id as text, then by the word."""
    return min((windows.name(i), p) for i, p in zip(windows.item[places].tolist(), windows.at[places].tolist(), strict=True))


#: Of a text: words, hit words, ids of the items found, longest match.
Overlap = tuple[int, np.ndarray, set[str], Match | None]


def scan(texts: list[str], windows: TestWindows) -> Iterator[Overlap]:
    """The overlap of each text with the windows."""
    for i, j in slices(texts, 1 << 20):
        words = words_of(texts[i:j])
        at, which = matches(words, windows)
        for d in range(j - i):
            begin, end = words.first[d], words.first[d + 1]
            lo, hi = np.searchsorted(at, (begin, end))
            hit, items, longest = _of_document(at[lo:hi], which[lo:hi], begin, windows) if lo < hi else (at[:0], [], None)
            yield int(end - begin), hit, {windows.name(k) for k in items}, longest


def benchmark_blocks(benchmark: DataFrame, width: int, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items (item_id, text), null texts left out, in blocks whose windows take about ``block_bytes``.

    A word counts as one window: its key, three numbers of its place, and its hash, length and first place.
    Items come to the driver one at a time, and one block of them is held at once.
    """
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(words_of([r[1]]).hashes) * (4 * width + 32)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


FOUND = "n_words long, hit array<int>, item_ids array<string>, longest struct<n: int, at: int, item: string, item_at: int>"


def _overlaps(texts: pd.Series, windows: TestWindows) -> pd.DataFrame:
    """The columns FOUND of a batch of texts."""
    rows = [(n, hit.astype(np.int32), sorted(ids), dict(zip(("n", "at", "item", "item_at"), longest, strict=True)) if longest else None) for n, hit, ids, longest in scan(texts.tolist(), windows)]
    return pd.DataFrame(rows, columns=["n_words", "hit", "item_ids", "longest"])


def _shared(rows: DataFrame, block: list[tuple[object, str]], width: int) -> Broadcast:
    return rows.sparkSession.sparkContext.broadcast(TestWindows(block, width))


def _pass(rows: DataFrame, shared: Broadcast, keep: Callable[[pd.DataFrame], pd.Series], columns: list[str], schema: str) -> DataFrame:
    """``rows`` (columns, text) with FOUND of one block of the benchmark, those that ``keep`` says."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.concat([pdf[columns], _overlaps(pdf["text"], shared.value)], axis=1)
            yield found[keep(found)]

    return rows.select(*columns, "text").mapInPandas(run, f"{schema}, {FOUND}")


def _hits(rows: DataFrame, blocks: Iterable[list[tuple[object, str]]], width: int, columns: list[str], schema: str) -> DataFrame:
    """FOUND of the rows that any block hits, by ``columns``, which tell texts apart; a pass is written before the next begins."""
    passes = []
    for b in blocks:
        shared = _shared(rows, b, width)
        passes.append(stored(_pass(rows, shared, lambda found: found["item_ids"].str.len() > 0, columns, schema), "hits"))
        shared.unpersist()
    merged = reduce(DataFrame.unionByName, passes).groupBy(*columns)
    best = F.min(F.when(F.col("longest").isNotNull(), F.struct((-F.col("longest.n")).alias("less"), "longest.at", "longest.item", "longest.item_at")))
    out = merged.agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best.alias("b"))
    return out.select(*columns, "hit", "item_ids", F.struct((-F.col("b.less")).alias("n"), "b.at", "b.item", "b.item_at").alias("longest"))


#: What stands for equal texts where the benchmark takes several passes.
TEXT_KEY = "text_key binary"


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verbatim overlap of each document (doc_id, text) with the benchmark (item_id, text).

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256
    (of the item ids, sorted as strings and comma-joined), contaminated, item_ids, longest (words
    of the longest verbatim match), longest_at (its first word in the document), longest_item and
    longest_item_at (the item, and its first word there). A benchmark whose windows take more than ``block_bytes`` takes one pass
    over the documents for each block; the hits are merged by the texts' SHA-256.

    Defined cases: null and empty texts have no words; an empty benchmark hits nothing; a null
    item_id counts as the empty string, repeated item_ids as one item; null and repeated doc_ids are
    rows like others; of equally long matches the first in the document, then in the items' order as
    strings, is told; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = benchmark_blocks(benchmark, width, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    if second is None:
        found = _pass(rows, _shared(rows, first, width), lambda found: pd.Series(True, found.index), ["doc_id"], f"doc_id {kind}")
    else:
        rows = rows.withColumn("text_key", F.unhex(F.sha2("text", 256)))
        hits = _hits(rows, _again(first, second, blocks), width, ["text_key"], TEXT_KEY)
        counted = _pass(rows, _shared(rows, [], width), lambda found: pd.Series(True, found.index), ["doc_id", "text_key"], f"doc_id {kind}, {TEXT_KEY}")
        found = counted.select("doc_id", "text_key", "n_words").join(hits, "text_key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        F.greatest(n_hit, F.lit(0)).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        ids.alias("item_ids"),
        F.coalesce(F.col("longest.n").cast("long"), F.lit(0)).alias("longest"),
        F.col("longest.at").alias("longest_at"),
        F.col("longest.item").alias("longest_item"),
        F.col("longest.item_at").alias("longest_item_at"),
    )


def _again(first: list, second: list, rest: Iterator[list]) -> Iterator[list]:
    yield first
    yield second
    yield from rest


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with all their columns.

    Defined cases as in ``contamination``: null and empty texts stay, repeated rows stay or go together,
    an empty benchmark keeps all, an empty table gives no rows.
    """
    blocks = benchmark_blocks(benchmark, width, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        keyed = docs.select(text_or_empty().alias("text")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
        hit = _hits(keyed, _again(first, second, blocks), width, ["text_key"], TEXT_KEY).select(F.col("text_key").alias("_text_key"))
        return docs.withColumn("_text_key", F.unhex(F.sha2(text_or_empty(), 256))).join(hit, "_text_key", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    shared = _shared(docs, first, width)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(hit) == 0 for _, hit, _, _ in scan(texts.tolist(), shared.value)], dtype=bool)

    return docs.where(clean(text_or_empty()))
