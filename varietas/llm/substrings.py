"""Exact removal of repeated substrings by a depth-limited radix sort of suffixes.

The suffixes of all texts, cut to the threshold of 100 bytes, are grouped by most-significant digits;
a group of one suffix is done, and the groups that are left at the full depth are exactly the
repeated windows. Sorting every suffix of a corpus would move many times its size, so the first digit
is chosen by content: of the 16-byte strings in a window the one with the least hash, the window's
anchor, is the digit under which the window is filed. Equal windows have equal anchors at equal
places, and neighbouring windows mostly share theirs, so one row stands for a run of some forty
suffixes.

1. Rows (digit, block): the block is all bytes of a run. Runs that repeat an earlier block of the same
   digit are repeated windows throughout; digits with one block are done.
2. Runs of digits with several blocks are sorted window by window, through digits of 8 bytes, to the
   full depth. A digit under which many different blocks are filed (the edge of a passage that many
   texts share) is split: its windows are filed by a hash of all their 100 bytes instead.
3. The windows that have an earlier equal are merged to byte spans by document and cut out.

Equal blocks of a digit are told by 64 bits of a hash that is another one than the digit's, so with two
blocks of one digit in 2**64 as the odds of a mistake; windows filed singly by two such hashes of all
their bytes. The passes inside a digit compare bytes.

Each task first settles repeats among its own rows, so a string sends one row per task at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, text_or_empty
from .wordhash import BASE, _upto, mix

#: Threshold and anchor length in bytes, and digit length of the inner passes.
DEPTH, ANCHOR, DIGIT = 100, 16, 8
#: Blocks under one digit, within a task and in all, from which on its windows are filed singly.
MANY_IN_TASK, MANY = 64, 256
#: Text bytes that are hashed at once, and within which a task settles repeats.
CHUNK, SETTLE = 1 << 20, 16 << 20
#: Bytes of a table that is broadcast at most; above, it is joined by a shuffle.
MOST_BROADCAST = 64 << 20

_SALT = np.uint64(0x9FB21C651E98DF25)
#: What the second hash takes for each byte.
_OTHER = mix(np.arange(1, 257, dtype=np.uint64) * _SALT)
#: Kinds of rows: runs of windows, known repeats, rows filed singly, and signs that a digit has such.
_RUN, _KNOWN, _HOT, _WITNESS = 0, 1, 2, 3


class Chunk:
    """Some texts as one byte array, with prefix sums for hashes of any stretch."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.up, down = _upto(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * down[: len(self.data)], out=self.sums[1:])
        self.others = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_OTHER[self.data] * down[: len(self.data)], out=self.others[1:])

    def other(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A second hash of each stretch, which takes bytes by random numbers instead of their values."""
        return mix((self.others[end] - self.others[begin]) * self.up[begin] + (end - begin).astype(np.uint64) * _SALT)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes, by content and length."""
        return mix((self.sums[end] - self.sums[begin]) * self.up[begin] ^ mix((end - begin).astype(np.uint64) * _SALT))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first window, last window, anchor) of every run of windows with one anchor."""
        n = len(self.data)
        if n < DEPTH:
            return (np.array([], dtype=np.int64),) * 4
        h, base, size = self.data.astype(np.uint64) + np.uint64(1), BASE, 1
        while size < ANCHOR:
            h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
            size *= 2
        bits = max(n.bit_length(), 1)
        low = (mix(h) >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
        width, span = DEPTH - ANCHOR + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        anchor = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
        inside = np.zeros(n + 1, dtype=np.int32)
        lengths = np.diff(self.first)
        long = lengths >= DEPTH
        inside[self.first[:-1][long]] += 1
        np.add.at(inside, self.first[1:][long] - DEPTH + 1, -1)
        valid = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
        if not len(valid):
            return (np.array([], dtype=np.int64),) * 4
        a = anchor[valid]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(valid)]]) - 1
        begin = valid[new]
        return np.searchsorted(self.first, begin, side="right") - 1, begin, valid[last], a[new]


def _chunks(uids: list[int], texts: list[str]) -> Iterator[tuple[np.ndarray, Chunk]]:
    held, ids, size = [], [], 0
    for uid, text in zip(uids, texts, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK:
            yield np.array(ids, dtype=np.int64), Chunk(held)
            held, ids, size = [], [], 0
        held.append(raw)
        ids.append(uid)
        size += len(raw)
    if held:
        yield np.array(ids, dtype=np.int64), Chunk(held)


def _settled(batches: Iterable[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """Batches gathered to about SETTLE bytes of text."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += int(pdf["text"].str.len().sum())
        if size >= SETTLE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _earlier_in_group(keys: tuple[np.ndarray, ...], order_by: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether a row with equal keys comes before, by ``order_by``."""
    order = np.lexsort((*order_by[::-1], *keys[::-1]))
    same = np.ones(len(order), dtype=bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    out = np.empty(len(order), dtype=bool)
    out[order] = same
    return out


ROWS = "key long, block long, digit long, uid long, place long"


def _place(low: np.ndarray, high: np.ndarray, anchor: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """First window, further windows, anchor and kind of a run in one number, which orders by the first."""
    return low << 16 | (high - low) << 9 | (anchor - low) << 2 | kind


def _first_pass(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each run, filed by its digit; repeats within the task are known at once, their high in ``digit``.

    Where many blocks stand under one digit, they are filed by block as well, and one witness stays
    under the digit to tell other tasks' runs.
    """
    for group in _settled(batches):
        found = []
        for pdf in group:
            for uids, chunk in _chunks(pdf["uid"].tolist(), pdf["text"].tolist()):
                doc, low, high, anchor = chunk.runs()
                digit = chunk.hash(anchor, anchor + ANCHOR)
                block = mix(chunk.other(low, high + DEPTH) ^ mix((anchor - low).astype(np.uint64) + _SALT))
                begin = chunk.first[doc]
                found.append((digit, block, uids[doc], low - begin, high - begin, anchor - begin, chunk.hash(low, high + DEPTH)))
        if not found:
            continue
        digit, block, uid, low, high, anchor, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        known = _earlier_in_group((digit, block), (uid, low))
        values, inverse = np.unique(digit, return_inverse=True)
        hot = (np.bincount(inverse, weights=~known, minlength=len(values)) >= MANY_IN_TASK)[inverse] & ~known
        n_uid, n_low, n_high = _joined_runs(uid[known], low[known], high[known])
        digit, block, uid, low, high, anchor, whole, hot = (x[~known] for x in (digit, block, uid, low, high, anchor, whole, hot))
        witness = np.unique(digit[hot])
        zero, none = np.zeros(len(witness), dtype=np.uint64), np.zeros(len(n_uid), dtype=np.uint64)
        columns = {
            "key": np.concatenate([np.where(hot, mix(block ^ digit), digit), witness, n_uid.view(np.uint64)]),
            "block": np.concatenate([block, zero, none]),
            "digit": np.concatenate([np.where(hot, whole, np.uint64(0)), zero, n_high.view(np.uint64)]),
            "uid": np.concatenate([uid, zero.view(np.int64), n_uid]),
            "place": np.concatenate([_place(low, high, anchor, np.where(hot, _HOT, _RUN)), zero.view(np.int64) + _WITNESS, n_low << 16 | _KNOWN]),
        }
        yield pd.DataFrame({c: v.view(np.int64) for c, v in columns.items()})


def _joined_runs(uid: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (uid, low, high), those that follow each other made one."""
    order = np.lexsort((low, uid))
    uid, low, high = (x[order].astype(np.int64) for x in (uid, low, high))
    new = np.ones(len(uid), dtype=bool)
    new[1:] = (uid[1:] != uid[:-1]) | (low[1:] > high[:-1] + 1)
    first = np.flatnonzero(new)
    return uid[first], low[first], high[np.concatenate([first[1:], [len(uid)]])[: len(first)] - 1]


SORTED = "key long, block long, uid long, low int, high int, anchor int, kind int, bytes binary"


def _second_pass(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each run to sort: its bytes, or, where hot, each of its windows by a hash of all its bytes.

    Windows that repeat within the task come out as known, those that follow each other as one row.
    """
    for group in _settled(batches):
        plain, single = [], []
        for pdf in group:
            runs = dict(zip(pdf["uid"].tolist(), pdf["places"], strict=True))
            for uids, chunk in _chunks(pdf["uid"].tolist(), pdf["text"].tolist()):
                for uid, begin in zip(uids.tolist(), chunk.first.tolist(), strict=False):
                    place = np.asarray(runs[uid])
                    hot, low, more, anchor = place & 3 == _HOT, place >> 16, place >> 9 & 127, place >> 2 & 127
                    digit = chunk.hash(begin + low + anchor, begin + low + anchor + ANCHOR).view(np.int64)
                    for k, a, n, p in zip(digit[~hot].tolist(), low[~hot].tolist(), more[~hot].tolist(), anchor[~hot].tolist(), strict=True):
                        plain.append((k, k, uid, a, a + n, p, _RUN, chunk.data[begin + a : begin + a + n + DEPTH].tobytes()))
                    count = more[hot] + 1
                    start = np.repeat(low[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    single.append((chunk.hash(begin + start, begin + start + DEPTH), chunk.other(begin + start, begin + start + DEPTH).view(np.int64), np.full(len(start), uid), start))
        columns = SORTED.replace(",", "").split()[::2]
        if plain:
            yield pd.DataFrame(plain, columns=columns).astype({"low": np.int32, "high": np.int32, "anchor": np.int32, "kind": np.int32})
        if single:
            key, other, uid, start = (np.concatenate(x) for x in zip(*single, strict=True))
            known = _earlier_in_group((key, other.view(np.uint64)), (uid, start))
            first = {"key": key[~known].view(np.int64), "block": other[~known], "uid": uid[~known], "low": start[~known], "high": start[~known], "kind": _HOT}
            u, lo, hi = _joined_runs(uid[known], start[known], start[known])
            again = {"key": u, "block": lo, "uid": u, "low": lo, "high": hi, "kind": _KNOWN}
            for rows in (first, again):
                out = pd.DataFrame(rows).assign(anchor=0, bytes=None)[columns]
                yield out.astype({"key": np.int64, "block": np.int64, "uid": np.int64, "low": np.int32, "high": np.int32, "anchor": np.int32, "kind": np.int32})


def radix_repeats(digit: np.ndarray, uid: np.ndarray, low: np.ndarray, anchor: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of every window that an earlier row of its digit has too.

    The windows of a row are the 100-byte stretches of its bytes; ``anchor`` is where the digit
    stands in them. Most-significant-digit passes of 8 bytes; suffixes alone in their group leave.
    """
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw) + b"\0" * DIGIT, dtype=np.uint8)
    first = np.cumsum(lengths) - lengths
    count = lengths - DEPTH + 1
    row = np.repeat(np.arange(len(raw)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = first[row] + window
    group = _groups((digit[row], anchor[row] - window))
    for depth in range(0, DEPTH, DIGIT):
        width = min(DIGIT, DEPTH - depth)
        many = np.bincount(group)[group] > 1 if len(group) else np.array([], dtype=bool)
        row, window, at, group = row[many], window[many], at[many], group[many]
        value = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            value = value << np.uint64(8) | data[at + depth + k].astype(np.uint64)
        group = _groups((group, value))
    again = _earlier_in_group((group,), (uid[row], low[row] + window))
    return row[again], window[again]


def _groups(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """A dense number of each distinct combination of keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _sort_runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks (uid, low, high) of windows that have an earlier equal; rows come by key, block and place."""

    def marks(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, uid, low = (pdf[c].to_numpy() for c in ("kind", "uid", "low"))
        out = [pdf[["uid", "low", "high"]][kind == _KNOWN]]
        single = pdf[kind == _HOT]
        out.append(single[["uid", "low", "high"]][single.duplicated(["key", "block"]).to_numpy()])
        runs = kind == _RUN
        if runs.any():
            uid, low = uid[runs], low[runs].astype(np.int64)
            row, window = radix_repeats(pdf["key"].to_numpy()[runs], uid, low, pdf["anchor"].to_numpy()[runs].astype(np.int64), pdf["bytes"][runs].tolist())
            u, a, b = _joined_runs(uid[row], low[row] + window, low[row] + window)
            out.append(pd.DataFrame({"uid": u, "low": a.astype(np.int32), "high": b.astype(np.int32)}))
        return pd.concat(out, ignore_index=True)

    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        rows = pd.concat(held, ignore_index=True)
        if len(rows) >= 4096:
            whole = (rows["key"] != rows["key"].iloc[-1]).to_numpy()
            yield marks(rows[whole])
            rows = rows[~whole]
        held = [rows]
    if held and len(held[0]):
        yield marks(held[0])


def _merged(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Byte spans (begin, end) covered by each document's marked windows, merged."""
    for pdf in batches:
        spans = []
        for lows, highs in zip(pdf["lows"], pdf["highs"], strict=True):
            order = np.argsort(lows, kind="stable")
            begin, end = np.asarray(lows)[order].astype(np.int64), np.maximum.accumulate(np.asarray(highs)[order].astype(np.int64) + DEPTH)
            new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
            spans.append(np.stack([begin[new], end[np.concatenate([new[1:], [len(end)]]) - 1]], axis=1).astype("<i4").tobytes())
        yield pd.DataFrame({"uid": pdf["uid"], "spans": spans})


def _cut_out(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text, raw in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            spans = [] if raw is None else np.frombuffer(raw, dtype="<i4").reshape(-1, 2).tolist()
            kept, at = [], 0
            for begin, end in spans:
                kept.append(data[at:begin])
                at = end
            kept = b"".join([*kept, data[at:]])
            out.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]).astype({"doc_id": pdf["doc_id"].dtype})


def _beside(texts: DataFrame, table: DataFrame, size: int, how: str) -> DataFrame:
    """``texts`` joined with a table by uid, broadcast if its ``size`` in bytes is below the bound."""
    return texts.join(F.broadcast(table) if size <= MOST_BROADCAST else table, "uid", how)


def _numbered(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text) with uid unique and in the order of documents: doc_id itself where it can be."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    n, ids, there = rows.agg(F.count("*"), F.count_distinct("doc_id"), F.count("doc_id")).first()
    if n == ids == there and docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        return rows.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "text")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return cut(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut out of each text of ``docs`` (doc_id, text) what an earlier 100-byte string repeats.

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of smaller
    doc_id, or before in its own. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept_text (the bytes left as text; a character cut in two becomes a replacement sign).

    Defined cases: null texts count as empty; texts below 100 bytes stay whole; rows with equal ids
    follow each other by text, and null ids come last; an empty table gives no rows; other columns
    are not read.
    """
    texts = _numbered(docs)
    state = stored(_filed(texts.select("uid", "text").mapInPandas(_first_pass, ROWS)), "runs")
    open_ = state.where("not mark")
    to_sort = open_.groupBy("uid").agg(F.collect_list("place").alias("places"))
    second = _beside(texts.select("uid", "text"), to_sort, open_.count() * 12, "inner").select("uid", "text", "places")
    by_digit = second.mapInPandas(_second_pass, SORTED).repartition("key").sortWithinPartitions("key", "block", "uid", "low")

    low = F.shiftright("place", 16).cast("int")
    high = F.coalesce("high", low + F.shiftright("place", 9).bitwiseAND(127)).cast("int")
    marks = state.where("mark").select("uid", low.alias("low"), high.alias("high")).union(by_digit.mapInPandas(_sort_runs, "uid long, low int, high int"))
    spans = cut(marks.groupBy("uid").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")).mapInPandas(_merged, "uid long, spans binary"))
    size = spans.agg(F.coalesce(F.sum(F.octet_length("spans") + 40), F.lit(0))).first()[0]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return _beside(texts, spans, size, "left").select("doc_id", "text", "spans").mapInPandas(_cut_out, schema)


def _filed(rows: DataFrame) -> DataFrame:
    """(uid, place, high, mark) of runs that repeat a block (marks) and of those to be sorted.

    The kind in ``place`` tells whether a run is sorted with others of its digit or window by window;
    ``high`` is the last window of joined runs.
    """
    by_block = Window.partitionBy("key", "block", "digit").orderBy("uid", "place")
    by_key = Window.partitionBy("key")
    kind = F.col("place").bitwiseAND(3)
    filed = (
        rows.repartition("key")
        .withColumn("nth", F.row_number().over(by_block))
        .withColumns({"least": F.min("block").over(by_key), "most": F.max("block").over(by_key), "n": F.count("*").over(by_key), "hottest": F.max(kind).over(by_key)})
        .where(kind != _WITNESS)
    )
    mark = (kind == _KNOWN) | (F.col("nth") > 1)
    open_ = (F.col("least") != F.col("most")) | (kind == _HOT)
    hot = (F.col("hottest") >= _HOT) | (F.col("n") > MANY)
    place = F.when(mark, F.col("place")).otherwise(F.col("place") - kind + F.when(hot, _HOT).otherwise(_RUN))
    return filed.where(mark | open_).select("uid", place.alias("place"), F.when(kind == _KNOWN, F.col("digit")).alias("high"), mark.alias("mark"))
