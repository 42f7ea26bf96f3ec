"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Every run of so many words of a text is a window: one begins at each word. A word's input is its own vector beside the
element-wise largest of the vectors of its character n-grams; gated recurrent units read a window in
both directions; attention pools their states into one logit. A document scores as its worst window.
Windows that hold no known word or n-gram differ by their length only, so one of each length is read;
a full window that holds one depends on that word and its place alone, so it is read once. Full windows with
several are sorted by the known words that they begin (for the way back: end) with, and what they share is read once.

The network is trained on a bounded sample of labelled documents, by gradient descent through time:
of a toxic document the window that the network finds worst counts as toxic, of a clean one every
window is clean. Known are the words and n-grams whose share of toxic texts can't be chance among as
many candidates, so the vocabulary is as large as the sample allows. Vectors start from the log-odds
of their word or n-gram. A part of the sample is set aside: the round whose scores part it best is
chosen there on the windows of training, and the cut on all windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .wordhash import _WORD, BASE, Words, words_of

#: Words in a window, and the step from one to the next, in scoring and in training.
WINDOW, STEP, TRAINING_STEP = 32, 1, 2
#: Most labelled rows of each class that are read to train (those whose ids hash lowest), most bytes of one of
#: their texts, a longer one isn't trained on, and of all of them.
TRAINING_ROWS, TEXT_BYTES, TRAINING_BYTES = 1_000, 1 << 20, 32 << 20
#: Of so many training rows one is set aside to choose the round and the cut.
SET_ASIDE = 5
#: Lengths, below 8, of the n-grams of bytes that stand for a word: stems, and stems at their place in the word.
GRAMS = (4, 7)
#: Most known words and n-grams, vector lengths, states per direction.
WORDS_KEPT, GRAMS_KEPT, WORD_DIM, GRAM_DIM, STATES = 6_000, 6_000, 6, 6, 10
ROUNDS, RATE = 12, 0.01
#: Share of the logarithm of the number of candidates that a known key must gain in likelihood.
SURE = 0.4
#: Windows in a batch at least and at most; in between, a round has so many batches.
BATCH_LEAST, BATCH_MOST, BATCHES = 32, 256, 40
#: Text characters that are read, windows that are scored, and windows that are sorted to find what they share, at once.
READ, WINDOWS_AT_ONCE, SORTED_AT_ONCE = 1 << 20, 6_000, 60_000
#: Columns that are multiplied at once: numpy's library reads more of them slower, and with threads that wait busily.
MULTIPLIED = 2_000
#: Most words whose logits as the only known one of a window are remembered, by place; then all are forgotten.
REMEMBERED = 1 << 14


@dataclass
class Inputs:
    """Distinct words of a batch as network inputs, and each place's distinct word."""

    word: np.ndarray
    gram: np.ndarray
    gram_first: np.ndarray
    at: np.ndarray


def grams_of(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte n-grams of the chosen words, marked at both ends, and where each word's begin."""
    start, length = words.start[chosen], (words.end - words.start)[chosen]
    counts = [np.maximum(length + 3 - n, 1) for n in GRAMS]
    first = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0))])
    code = np.empty(first[-1], dtype=np.uint64)
    before = first[:-1]
    marked = np.ones(len(words.data) + 9, dtype=np.uint8)
    marked[1:-8] = np.where(_WORD[words.data], words.data, 1)
    eight = np.lib.stride_tricks.as_strided(marked.view(), (len(marked) - 7, 8), (1, 1))
    for n, count in zip(GRAMS, counts, strict=True):
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own = eight[np.repeat(start, count) + offset].view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - 8 * n)
        over = np.maximum(n - 2 - length, 0)  # a short word's bytes from the mark at its end on are marks
        short = np.flatnonzero(over)
        at = (np.cumsum(count) - count)[short]
        rest = (np.uint64(1) << (8 * over[short]).astype(np.uint64)) - np.uint64(1)
        own[at] = own[at] & ~rest | np.uint64(0x0101010101010101) & rest
        code[np.repeat(before, count) + offset] = own | np.uint64(n << 8 * n)
        before = before + count
    return code, first


def _number(vocabulary: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """1 + place in the sorted vocabulary, 0 for what isn't in it."""
    if not len(vocabulary):
        return np.zeros(len(wanted), dtype=np.int64)
    out, spread = np.zeros(len(wanted), dtype=np.int64), lambda v: v * np.uint64(BASE) >> np.uint64(46)
    marks = np.zeros(1 << 18, dtype=bool)
    marks[spread(vocabulary)] = True
    some = np.flatnonzero(marks[spread(wanted)])
    at = np.minimum(np.searchsorted(vocabulary, wanted[some]), len(vocabulary) - 1)
    out[some] = np.where(vocabulary[at] == wanted[some], at + 1, 0)
    return out


def windows_of(first: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number of words of every window; documents without words have none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // step), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][doc] + k * step
    return doc, begin, np.minimum(first[1:][doc] - begin, WINDOW)


def _chosen(x: Inputs, words: np.ndarray) -> Inputs:
    """The inputs of some of the distinct words."""
    count = np.diff(x.gram_first)[words]
    first = np.concatenate([[0], np.cumsum(count)])
    places = np.repeat(x.gram_first[words] - first[:-1], count) + np.arange(first[-1])
    return Inputs(x.word[words], x.gram[places], first, x.at)


def _shared_steps(at: np.ndarray, start: np.ndarray, move: int, places: np.ndarray, from_: np.ndarray, count: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows by the known words they meet first, and how many steps each shares with the one before, at least.

    A window begins at ``start``, goes by ``move`` and meets ``count`` words, from ``places[from_]`` on, numbers of ``bits``
    bits. As many of its words count as fit a number of 63 bits, by step and word; windows without others that agree share all steps.
    """
    key, met = np.zeros(len(start), dtype=np.int64), []
    for k in range(63 // (6 + bits)):
        place = places[from_ + move * np.minimum(k, count - 1)]
        step, word = np.where(k < count, (place - start) * move, WINDOW), np.where(k < count, at[place], 0)
        key = key << (6 + bits) | step << bits | word
        met.append((step, word))
    order = np.argsort(key)
    pairs = lambda v: (v[order[1:]], v[order[:-1]])
    alike = np.where(np.maximum(*pairs(count)) <= len(met), WINDOW, np.minimum(*pairs(met[-1][0])) + 1)
    for step, word in met[::-1]:
        alike = np.where(np.equal(*pairs(step)) & np.equal(*pairs(word)), alike, np.minimum(*pairs(step)))
    return order, np.concatenate([[0], alike])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = 0.5 * x
    np.tanh(y, out=y)
    y *= 0.5
    y += 0.5
    return y


class ToxicityNet:
    """The network: vocabularies, parameters, forward pass and training."""

    def __init__(self, words: np.ndarray, word_odds: np.ndarray, grams: np.ndarray, gram_odds: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words, self.grams, self.threshold, self.trainable = words, grams, 0.0, None
        self.alone: dict[bytes, np.ndarray] = {}
        d, h = WORD_DIM + GRAM_DIM, STATES
        normal = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": normal(len(words) + 1, WORD_DIM, scale=0.05), "gram": normal(len(grams) + 1, GRAM_DIM, scale=0.05)}
        self.p["word"][1:, 0], self.p["gram"][1:, 0] = word_odds, gram_odds
        self.p["word"][0], self.p["gram"][0] = 0, 0
        for way in ("f", "b"):
            self.p |= {f"w{way}": normal(d, 3 * h), f"u{way}": normal(h, 3 * h, scale=0.2), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": normal(2 * h), "o": normal(2 * h), "o0": np.full(1, -1.0, np.float32)}

    def inputs(self, words: Words) -> Inputs:
        _, chosen, at = np.unique(words.hashes, return_index=True, return_inverse=True)
        code, first = grams_of(words, chosen)
        return Inputs(_number(self.words, words.hashes[chosen]), _number(self.grams, code), first, at)

    def vectors(self, x: Inputs) -> np.ndarray:
        """The input vector of each distinct word, and a last row of zeros for padding."""
        out = np.zeros((len(x.word) + 1, WORD_DIM + GRAM_DIM), dtype=np.float32)
        out[:-1, :WORD_DIM] = self.p["word"][x.word]
        if len(x.word):
            out[:-1, WORD_DIM:] = np.maximum.reduceat(self.p["gram"][x.gram], x.gram_first[:-1], axis=0)
        return out

    def forward(self, gates: dict[str, np.ndarray], index: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. gates: each word's input share of the gates by direction; index (windows, WINDOW)."""
        n, h = len(index), STATES
        there = np.arange(WINDOW) < sizes[:, None]
        full = there.all(axis=0)
        states = np.empty((n, WINDOW, 2 * h), dtype=np.float32)
        for way, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            s, u = np.zeros((n, h), dtype=np.float32), self.p[f"u{way}"]
            for t in order:
                g, r_s = gates[way][index[:, t]], s @ u
                rz = _sigmoid(g[:, : 2 * h] + r_s[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                c = r * r_s[:, 2 * h :]
                c += g[:, 2 * h :]
                np.tanh(c, out=c)
                new = s - c
                new *= z
                new += c
                if not full[t]:
                    new = np.where(there[:, t, None], new, s)
                if keep is not None:
                    keep[way, t] = (s, r, z, c, r_s[:, 2 * h :])
                s = new
                states[:, t, h * (way == "b") : h * (way == "b") + h] = s
        e = np.where(there, states @ self.p["a"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        share = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", share, states)
        if keep is not None:
            keep.update(states=states, share=share, pooled=pooled, there=there)
        return pooled @ self.p["o"] + self.p["o0"][0]

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {way: vectors @ self.p[f"w{way}"] + self.p[f"c{way}"] for way in ("f", "b")}

    def logits(self, x: Inputs, begin: np.ndarray, size: np.ndarray, alone: dict[bytes, np.ndarray] | None = None) -> np.ndarray:
        """Logits of the windows of ``size`` words from word ``begin``, a bounded number at a time.

        Words without known parts have the zero vector, and a window of such words the logit of any other of its size.
        ``alone`` remembers, by input vector, the logits of full windows with one known word, at each place.
        """
        known = x.word > 0
        if len(known):
            known |= np.maximum.reduceat(x.gram, x.gram_first[:-1]) > 0
        vectors = self.vectors(_chosen(x, np.flatnonzero(known)))
        _, chosen, alike = np.unique(vectors[:-1].view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        vectors = vectors[[*chosen, -1]]
        gates, out, zero = self.gates(vectors), np.empty(len(begin), dtype=np.float32), len(vectors) - 1
        numbers = np.full(len(known), zero, dtype=np.int32)
        numbers[known] = alike
        at = np.concatenate([numbers[x.at], np.full(WINDOW, zero, dtype=np.int32)])
        places = np.flatnonzero(at != zero)
        before = np.searchsorted(places, np.arange(len(at) + 1))
        from_, to = before[begin], before[begin + size]
        for n in np.unique(size[from_ == to]):
            alike = (from_ == to) & (size == n)
            some = np.flatnonzero(alike)[:1]
            out[alike] = self.forward(gates, at[begin[some, None] + np.arange(WINDOW)], size[some])
        lone = np.flatnonzero((to - from_ == 1) & (size == WINDOW))
        if len(lone):
            place = places[from_[lone]]
            out[lone] = self._of_one(vectors, gates, at[place], place - begin[lone], {} if alone is None else alone)
        several = np.flatnonzero((to - from_ > 1) & (size == WINDOW))
        for i in range(0, len(several), SORTED_AT_ONCE):
            some = several[i : i + SORTED_AT_ONCE]
            out[some] = self._in_order(gates, at, begin[some], places, from_[some], to[some])
        rest = np.flatnonzero((to > from_) & (size < WINDOW))
        for i in range(0, len(rest), WINDOWS_AT_ONCE):
            some = rest[i : i + WINDOWS_AT_ONCE]
            out[some] = self.forward(gates, at[begin[some, None] + np.arange(WINDOW)], size[some])
        return out

    def _in_order(self, gates: dict[str, np.ndarray], at: np.ndarray, begin: np.ndarray, places: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Logits of full windows that hold the known words at ``places[from_:to]``, one at least.

        A direction's states depend only on the words read so far, so windows are sorted by the known words that they
        begin (or, backward, end) with, and what a window shares with the one before it is read once.
        """
        told, bits = np.zeros((len(begin), WINDOW), dtype=np.complex64), len(gates["f"]).bit_length()
        for way, start, move, first in (("f", begin, 1, from_), ("b", begin + WINDOW - 1, -1, to - 1)):
            order, alike = _shared_steps(at, start, move, places, first, to - from_, bits)
            for i in range(0, len(order), WINDOWS_AT_ONCE):
                some = order[i : i + WINDOWS_AT_ONCE]
                columns, found = self._columns(way, gates[way], at, start[some], move, alike[i : i + WINDOWS_AT_ONCE])
                told[some[columns]] += found.T[:, ::move]
        e, o = told.real, told.imag
        e = np.exp(e - e.max(axis=1, keepdims=True))
        return (e * o).sum(axis=1) / e.sum(axis=1) + self.p["o0"][0]

    def _columns(self, way: str, gates: np.ndarray, at: np.ndarray, start: np.ndarray, move: int, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What one direction tells of sorted windows, of which each shares its first ``alike`` steps with the one before.

        Returns their order as columns, and by step and column the products of the state with attention (real) and
        output (imaginary). A window becomes a column at the first step that it doesn't share, with the state of the window it shared
        the steps before with. The sigmoid of x is (1 + tanh(x / 2)) / 2, so halves go into the weights; attention and
        output are linear in a state, so two products of it are kept instead of the state.
        """
        n, h = len(start), STATES
        alike = np.concatenate([[0], alike[1:]])
        order = np.argsort(alike, kind="stable")
        upto = np.searchsorted(alike[order], np.arange(WINDOW + 1), side="right")
        column = np.empty(n, dtype=np.int64)
        column[order] = np.arange(n)
        unknown = gates[-1]
        halves = np.repeat(np.array([0.5, 0.5, 1], dtype=np.float32), h)
        more = np.ascontiguousarray(((gates - unknown) * halves).T)
        own = slice(h * (way == "b"), h * (way == "b") + h)
        ends = np.stack([self.p["a"][own], self.p["o"][own]])
        weights = np.zeros((3 * h + 2, h + 1), dtype=np.float32)
        weights[: 3 * h, :h], weights[3 * h :, :h] = 0.5 * self.p[f"u{way}"].T, ends
        weights[: 2 * h, h] = 0.5 * unknown[: 2 * h]
        plain = unknown[2 * h :, None]
        words = at[start[order] + move * np.arange(WINDOW)[:, None]]
        told = np.empty((WINDOW, n), dtype=np.complex64)
        room = [np.empty(k * n, dtype=np.float32) for k in (h + 1, h + 1, 3 * h + 2, h)]
        s, turn = np.empty((h + 1, 0), dtype=np.float32), 0
        for t in range(WINDOW + 1):
            m, old = upto[t], s.shape[1]
            if m > old:
                before, s = s, room[turn][: (h + 1) * m].reshape(h + 1, m)
                turn = 1 - turn
                s[:, :old] = before
                s[:h, old:], s[h, old:] = 0, 1
                if t:
                    read = np.flatnonzero(alike < t)
                    parent = column[read[np.searchsorted(read, order[old:m]) - 1]]
                    s[:h, old:] = before[:h].take(parent, axis=1)
                    told[: t - 1, old:m] = told[: t - 1].take(parent, axis=1)
            y, d = room[2][: (3 * h + 2) * m].reshape(3 * h + 2, m), room[3][: h * m].reshape(h, m)
            for i in range(0, m, MULTIPLIED):
                np.matmul(weights, s[:, i : i + MULTIPLIED], out=y[:, i : i + MULTIPLIED])
            if t:
                told.real[t - 1, :m], told.imag[t - 1, :m] = y[3 * h :]
            if t == WINDOW:
                break
            own, rz, c = s[:h], y[: 2 * h], y[2 * h : 3 * h]
            new = more.take(words[t, old:m], axis=1)
            some = np.flatnonzero(words[t, :old] != len(gates) - 1)
            known = more.take(words[t, some], axis=1)
            rz[:, old:] += new[: 2 * h]
            rz[:, some] = rz.take(some, axis=1) + known[: 2 * h]
            np.tanh(rz, out=rz)
            r, z = rz[:h], rz[h:]
            r += 1
            c *= r
            c += plain
            c[:, old:] += new[2 * h :]
            c[:, some] = c.take(some, axis=1) + known[2 * h :]
            np.tanh(c, out=c)
            np.subtract(own, c, out=d)
            d *= z
            own += c
            own += d
            own *= 0.5
        return order, told

    def _of_one(self, vectors: np.ndarray, gates: dict[str, np.ndarray], word: np.ndarray, place: np.ndarray, alone: dict[bytes, np.ndarray]) -> np.ndarray:
        """Logits of full windows whose one known word ``word`` stands at ``place``; words that ``alone`` lacks are added to it, at every place."""
        own, which = np.unique(word, return_inverse=True)
        if len(alone) > REMEMBERED:
            alone.clear()
        keys = [vectors[w].tobytes() for w in own]
        new = np.flatnonzero([k not in alone for k in keys])
        at_once = SORTED_AT_ONCE // WINDOW
        for i in range(0, len(new), at_once):
            some = new[i : i + at_once]
            string = np.full((len(some) + 1, WINDOW), len(vectors) - 1, dtype=np.int32)
            string[:-1, -1] = own[some]
            begin, owner = np.arange(len(some) * WINDOW), np.repeat(np.arange(len(some)), WINDOW)
            found = self._in_order(gates, string.ravel()[:-1], begin, np.arange(1, len(some) + 1) * WINDOW - 1, owner, owner + 1).reshape(-1, WINDOW)[:, ::-1]
            alone.update((keys[k], row.copy()) for k, row in zip(some, found, strict=True))
        return np.array([alone[k] for k in keys])[which, place]

    def worst(self, texts: list[str]) -> np.ndarray:
        """The largest logit of each text's windows; -inf without words."""
        out = np.full(len(texts), -np.inf)
        for i, j in slices(texts, READ):
            words = words_of(texts[i:j])
            doc, begin, size = windows_of(words.first)
            if len(doc):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                out[i + doc[first]] = np.maximum.reduceat(self.logits(self.inputs(words), begin, size, self.alone), first)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1; 0 without words."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.worst(texts) - self.threshold)))

    def gradients(self, x: Inputs, index: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss, through time."""
        h, p, keep = STATES, self.p, {}
        vectors = self.vectors(x)
        y = self.forward(self.gates(vectors), index, sizes, keep)
        dy = ((_sigmoid(y) - labels) / len(labels)).astype(np.float32)
        states, share, pooled = keep["states"], keep["share"], keep["pooled"]
        grad = {"o": pooled.T @ dy, "o0": dy.sum(keepdims=True)}
        dpooled = dy[:, None] * p["o"]
        dshare = np.einsum("nh,nth->nt", dpooled, states)
        de = share * (dshare - (share * dshare).sum(axis=1, keepdims=True))
        grad["a"] = np.einsum("nt,nth->h", de, states)
        dstates = share[:, :, None] * dpooled[:, None, :] + de[:, :, None] * p["a"]
        dvectors, dg_all = np.zeros_like(vectors), np.empty((WINDOW, len(index), 3 * h), dtype=vectors.dtype)
        placed = index.T.ravel()
        by_word = np.argsort(placed, kind="stable")
        used, first = np.unique(placed[by_word], return_index=True)
        for way, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            ds = np.zeros((len(index), h), dtype=np.float32)
            du, dc, dgates = np.zeros_like(p[f"u{way}"]), np.zeros_like(p[f"c{way}"]), np.zeros((len(vectors), 3 * h), dtype=np.float32)
            for t in order:
                s, r, z, c, r_c = keep[way, t]
                ds = ds + dstates[:, t, h * (way == "b") : h * (way == "b") + h]
                on = keep["there"][:, t, None]
                dn = np.where(on, ds, 0)
                dc_ = dn * (1 - z) * (1 - c * c)
                dr = dc_ * r_c * r * (1 - r)
                dz = dn * (s - c) * z * (1 - z)
                dg = np.concatenate([dr, dz, dc_], axis=1)
                back = np.concatenate([dr, dz, dc_ * r], axis=1)
                du += s.T @ back
                dc += dg.sum(axis=0)
                dg_all[t] = dg
                ds = np.where(on, dn * z, ds) + back @ p[f"u{way}"].T
            dgates[used] = np.add.reduceat(dg_all.reshape(-1, 3 * h)[by_word], first, axis=0)
            grad |= {f"u{way}": du, f"c{way}": dc, f"w{way}": vectors.T @ dgates}
            dvectors += dgates @ p[f"w{way}"].T
        grad["word"], grad["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(grad["word"], x.word, dvectors[:-1, :WORD_DIM])
        owner = np.repeat(np.arange(len(x.word)), np.diff(x.gram_first))
        largest = self.p["gram"][x.gram] == vectors[:-1, WORD_DIM:][owner]
        np.add.at(grad["gram"], x.gram, largest * dvectors[:-1, WORD_DIM:][owner])
        grad["word"][0], grad["gram"][0] = 0, 0
        return grad


def _log_odds(keys: list[np.ndarray], labels: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that tell the classes apart, sorted, with their smoothed document log-odds; keys are distinct in each text.

    A key is known if the likelihood ratio of its own share of toxic texts against the sample's exceeds
    the number of candidates; of more than ``most`` the surest stay.
    """
    values, inverse = np.unique(np.concatenate([*keys, np.array([], dtype=np.uint64)]), return_inverse=True)
    label = np.repeat(labels, [len(k) for k in keys])
    yes = np.bincount(inverse, weights=label, minlength=len(values))
    no = np.bincount(inverse, weights=1 - label, minlength=len(values))
    n_yes, n_no = max(labels.sum(), 1), max((1 - labels).sum(), 1)
    share, all_ = n_yes / (n_yes + n_no), yes + no
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(yes > 0, yes * np.log(yes / (all_ * share)), 0) + np.where(no > 0, no * np.log(no / (all_ * (1 - share))), 0)
    odds = np.log((yes + 1) / (n_yes + 2)) - np.log((no + 1) / (n_no + 2)) - np.log((n_no + 2) / (n_yes + 2))
    sure = np.flatnonzero(gain > SURE * np.log(max(len(values), 1)))
    ahead = np.sort(sure[np.argsort(-gain[sure], kind="stable")[:most]])
    return values[ahead], np.clip(odds[ahead], -4, 4).astype(np.float32)


def _read_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their n-grams' codes and where these begin, each place's distinct word, and first places of texts."""
    hashes, counts, known, codes, sizes = [], [], [], [], []
    for i, j in slices(texts, READ):
        words = words_of(texts[i:j])
        values, chosen = np.unique(words.hashes, return_index=True)
        code, first = grams_of(words, chosen)
        hashes.append(words.hashes)
        counts.append(np.diff(words.first))
        known.append(values)
        codes.append(code)
        sizes.append(np.diff(first))
    all_, size = np.concatenate([*known, np.array([], np.uint64)]), np.concatenate([*sizes, np.array([], np.int64)])
    code = np.concatenate([*codes, np.array([], np.uint64)])
    distinct, chosen = np.unique(all_, return_index=True)
    begin = (np.cumsum(size) - size)[chosen]
    first = np.concatenate([[0], np.cumsum(size[chosen])])
    grams = code[np.repeat(begin - first[:-1], size[chosen]) + np.arange(first[-1])]
    at = np.searchsorted(distinct, np.concatenate([*hashes, np.array([], np.uint64)])).astype(np.int32)
    return distinct, grams, first, at, np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.array([], np.int64)]))]).astype(np.int64)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 11) -> ToxicityNet:
    """The network trained on labelled texts; both classes may be of any size, or missing.

    Every SET_ASIDE-th text of each class is set aside to choose the round and the cut, if some are left to train on.
    """
    y = np.asarray(labels, dtype=np.float64)
    aside = np.zeros(len(y), dtype=bool)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        aside[own[SET_ASIDE - 1 :: SET_ASIDE]] = True
    part = lambda on: ([t for t, o in zip(texts, on, strict=True) if o], y[on])
    own, chosen = part(~aside), part(aside if len(np.unique(y[aside])) == 2 else ~aside)
    net, best = _start(*own, seed), -1.0
    if not 0 < own[1].sum() < len(own[1]) or not net.trainable:
        net.p["o"][:] = 0
        return net
    distinct, grams, gram_first, at, first = _read_all(chosen[0])
    x = Inputs(_number(net.words, distinct), _number(net.grams, grams), gram_first, at)

    def best_cut(step: int) -> tuple[float, float]:
        worst, (doc, begin, size) = np.full(len(chosen[0]), -np.inf), windows_of(first, step)
        np.maximum.at(worst, doc, net.logits(x, begin, size))
        return _best_cut(worst, chosen[1])

    for _ in _rounds(net, *own, rounds, seed):
        quality, _ = best_cut(TRAINING_STEP)
        if quality >= best:
            best, kept = quality, {k: v.copy() for k, v in net.p.items()}
    net.p = kept
    _, net.threshold = best_cut(STEP)
    return net


def _start(texts: list[str], y: np.ndarray, seed: int) -> ToxicityNet:
    """The network before the first round; ``trainable`` holds what the rounds need, if there are windows."""
    distinct, grams, gram_first, at, first = _read_all(texts)
    own = [np.unique(at[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    own_grams = [np.unique(np.concatenate([grams[gram_first[w] : gram_first[w + 1]] for w in o])) if len(o) else grams[:0] for o in own]
    net = ToxicityNet(*_log_odds([distinct[o] for o in own], y, WORDS_KEPT), *_log_odds(own_grams, y, GRAMS_KEPT), seed=seed)
    x = Inputs(_number(net.words, distinct), _number(net.grams, grams), gram_first, at)
    net.trainable = (x, *windows_of(first, TRAINING_STEP)) if len(at) else None
    return net


def _rounds(net: ToxicityNet, texts: list[str], y: np.ndarray, rounds: int, seed: int) -> Iterator[None]:
    """Trains ``net`` in place; comes back after each round."""
    x, doc, begin, size = net.trainable
    net.trainable = None
    rng, step = np.random.default_rng(seed), 0
    at = np.concatenate([x.at, np.full(WINDOW, len(x.word), dtype=np.int32)])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    odds = np.concatenate([[0], net.p["word"][1:, 0]])[x.word] + np.maximum.reduceat(np.concatenate([[0], net.p["gram"][1:, 0]])[x.gram], x.gram_first[:-1])
    padded = np.concatenate([odds, [0]])[at]
    logit = np.lib.stride_tricks.sliding_window_view(padded, WINDOW).max(axis=1)[begin]
    for i in np.flatnonzero(size < WINDOW):
        logit[i] = padded[begin[i] : begin[i] + size[i]].max()
    for round_ in range(rounds):
        order = np.lexsort((-logit, doc))
        worst = order[np.concatenate([[True], np.diff(doc[order]) != 0])]
        clean = rng.choice(np.flatnonzero(y[doc] == 0), min(int((y[doc] == 0).sum()), 2 * len(worst)), replace=False)
        chosen = np.concatenate([worst, worst[y[doc[worst]] == 1], clean])
        rng.shuffle(chosen)
        batch = min(max(len(chosen) // BATCHES, BATCH_LEAST), BATCH_MOST)
        for i in range(0, len(chosen), batch):
            w = chosen[i : i + batch]
            used, index = np.unique(at[begin[w, None] + np.arange(WINDOW)], return_inverse=True)
            index = index.reshape(-1, WINDOW)
            grad = net.gradients(_chosen(x, used[used < len(x.word)]), index, size[w], y[doc[w]])
            step += 1
            rate = RATE * (0.5 if round_ >= rounds - 2 else 1)
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        logit = net.logits(x, begin, size)
        yield


def _best_cut(worst: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The largest F1 of a cut, and the middle of the widest gap among the cuts that reach it."""
    worst = np.maximum(worst, -1e6)
    order = np.argsort(worst, kind="stable")
    v, label = worst[order], y[order]
    caught = np.concatenate([[0], np.cumsum(label[::-1])])[::-1]
    f1 = 2 * caught / (np.arange(len(v), -1, -1) + label.sum())
    edges = np.concatenate([[v[0] - 2], v, [v[-1] + 2]])
    gaps = np.where(f1 >= f1.max() - 1e-9, edges[1:] - edges[:-1], -1)
    k = int(gaps.argmax())
    return float(f1.max()), float((edges[k] + edges[k + 1]) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityNet:
    """Train on at most ``rows`` labelled documents of each class, none of them held out.

    Ids are chosen from the narrow table first, so only the chosen texts travel, to one task, which trains
    within TRAINING_BYTES of text and returns the network; the driver sees no text.

    Defined cases: labels other than 0 and 1 and null ids are left out, of several labels of an id the
    larger counts, of several texts of an id the first in order; null texts count as empty; texts above
    TEXT_BYTES aren't trained on; without both classes the network tells nothing; other columns are not read.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (1, 0)]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for part in ids for r in part.collect()], known.schema)
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def learn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, size = [], 0
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["toxic"], strict=True):
                size += len(text.encode("utf-8", "surrogatepass"))
                if size <= TRAINING_BYTES:
                    got.append((text, label))
        yield pd.DataFrame({"net": [pickle.dumps(train([t for t, _ in got], [k for _, k in got]))]})

    in_order = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")
    found = in_order.mapInPandas(learn, "net binary").first()
    return train([], []) if found is None else pickle.loads(found[0])


def score(docs: DataFrame, net: ToxicityNet) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text), whole texts.

    Defined cases: null and empty texts, and texts without words, score 0; null doc_ids count as not
    held out; repeated ids are rows like others; without labels of both classes every text with
    words gets the same score; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = shared.value.scores(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    rows = docs.select("doc_id", text_or_empty().alias("text"), held_out().alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, net: ToxicityNet) -> DataFrame:
    """The rows of ``docs`` that the network doesn't reject, with all their columns.

    Defined cases: null and empty texts and texts without words score 0 and stay, as they are; null and
    repeated ids are rows like others; an empty table gives no rows; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()) < 0.5)

    return docs.where(F.pandas_udf(clean, "boolean")(text_or_empty()))
