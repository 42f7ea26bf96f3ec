"""Secret scanning: fixed patterns, and character Markov models that add what looks random.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are
trained from labelled strings. In every run of key characters outside the patterns' spans, the stretches
where the random model leads most are found; one that holds a letter counts as a secret if the random
model's log-likelihood there exceeds the ordinary one's by a margin, which alone sets its least length;
a pair counts once in it, however often it is repeated.
It is reported up to the next character that is no letter or digit. The patterns' own spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The kinds in their order, their patterns, and the least length of what must be long.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: The characters of what may be a secret without a pattern, which the models tell apart.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats per character, and in all, by which the random model must be ahead.
MARGIN_PER_CHAR, MARGIN = 0.5, 12.0
#: Most nats that one pair may speak for randomness in a stretch, so that no few rare pairs pass the margin.
PAIR_MOST = 2.0
#: Weight, in characters, of the single-character frequencies in those of pairs.
BACK_OFF = 20.0
#: Most rows whose texts are read to train the models.
TRAINING_ROWS = 2_000

#: The manners in which words make an identifier.
JOINED = ("_".join, lambda w: "_".join(w).upper(), lambda w: " ".join(w).upper(), "-".join, "/".join, lambda w: "".join(x.capitalize() for x in w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: f"{'_'.join(w)}_{len(w[0])}")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches in code points, by start, then kind."""
    low = text.lower()
    spans = []
    if "passw" in low or "secret" in low or "token" in low or "api_key" in low or "apikey" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class MarkovPair:
    """Log-likelihood ratios of character pairs, random against ordinary.

    Pairs are smoothed towards the frequencies of single characters, and these towards even ones, so
    a character that ordinary strings lack speaks for randomness.
    """

    def __init__(self, samples: Iterable[tuple[str, int]]):
        self.code = np.full(128, len(ALPHABET), dtype=np.int64)
        self.code[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
        k = len(ALPHABET) + 1
        pairs = np.zeros((2, k, k))
        for text, label in samples:
            c = self._codes(text)
            np.add.at(pairs[int(label)], (c[:-1], c[1:]), 1)
        single = pairs.sum(axis=1) + 1
        single /= single.sum(axis=1, keepdims=True)
        logs = np.log((pairs + BACK_OFF * single[:, None, :]) / (pairs.sum(axis=2, keepdims=True) + BACK_OFF))
        self.ratio = logs[1] - logs[0]

    def _codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
        return self.code[np.minimum(raw, 127)]

    def score(self, text: str) -> float:
        """Log-likelihood ratio of ``text``: above 0 where it looks random."""
        c = self._codes(text)
        return float(self.ratio[c[:-1], c[1:]].sum())

    def is_secret(self, text: str) -> bool:
        return self.score(text) > max(MARGIN, MARGIN_PER_CHAR * len(text))


def random_strings(n: int = 600, seed: int = 7) -> list[str]:
    """Random strings of 20 to 64 characters over the alphabets that keys are written in, every seventh in dashed groups."""
    rng = np.random.default_rng(seed)
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], "0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62]]
    found = ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(20, 65))) for i in range(n)]
    return ["-".join(re.findall(f".{{1,{4 + i % 5}}}", s)) if i % 7 == 6 else s for i, s in enumerate(found)]


def labelled_samples(docs: DataFrame, rows: int = TRAINING_ROWS) -> list[tuple[str, int]]:
    """(string, label) for training: 1 for random strings and values that the patterns find, 0 for words.

    Words come from the whole texts of at most ``rows`` rows (those whose ids hash lowest), each distinct
    word once, as it stands and, by threes, joined in the manners of identifiers.

    Defined cases: null and empty texts give no words, repeated rows no more than one; a null id is an id
    like others in the choice of rows, but its texts aren't read; an empty table leaves the random strings
    alone; other columns are not read.
    """
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi").select("text").toLocalIterator()
    secret, words = random_strings(), set()
    for (text,) in found:
        spans, at = base_spans(text), 0
        secret += [text[a:b] for a, k, b in spans if k > 0]
        for a, _, b in [*spans, (len(text), 0, len(text))]:
            words.update(re.findall(r"[A-Za-z]+", text[at:a]))
            at = max(at, b)
    plain = sorted(words)
    mixed = sorted(plain, key=lambda w: zlib.crc32(w.encode()))
    joined = [JOINED[i % len(JOINED)](mixed[i : i + 3]) for i in range(0, len(mixed) - 2, 3)]
    return [(s, 1) for s in secret] + [(s, 0) for s in plain + joined]


def stretches(gains: list[float]) -> list[tuple[int, int]]:
    """All maximal stretches [i, j) of positive sum of ``gains``, none of which a longer one betters (Ruzzo and Tompa).

    Each open stretch points at the nearest one before it that begins lower, so one that was passed over is
    never looked at again, and the time grows with the length alone.
    """
    found: list[tuple[int, int, float, float, int]] = []
    sum_ = 0.0
    for k, gain in enumerate(gains):
        before, sum_ = sum_, sum_ + gain
        if gain <= 0:
            continue
        i, left, right, at = k, before, sum_, len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= left:
                at = found[at][4]
            if at < 0 or found[at][3] >= right:
                break
            i, _, left, _, lower = found[at]
            del found[at:]
            at = lower
        found.append((i, k + 1, left, right, at))
    return [(i, j) for i, j, _, _, _ in found]


def added_spans(text: str, base: list[Span], models: MarkovPair) -> list[Span]:
    """Stretches outside the spans of ``base`` that the models take for secrets, in time that grows with the text alone."""
    codes = models._codes(text)
    for s, _, e in base:
        codes[s:e] = len(ALPHABET)
    inside = codes < len(ALPHABET)
    pairs = inside[:-1] & inside[1:]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], pairs, [False]]).astype(np.int8)))
    if not len(edges):
        return []
    ratio = np.where(pairs, np.minimum(models.ratio, PAIR_MOST)[codes[:-1], codes[1:]], 0.0)
    begins, ends = edges[::2], edges[1::2]
    most = np.maximum(ratio, 0.0)
    reach, upto = np.add.reduceat(most, begins), np.concatenate([[0.0], np.cumsum(most)])
    out: list[Span] = []
    for a, b in zip(begins[reach > MARGIN].tolist(), ends[reach > MARGIN].tolist(), strict=True):
        end = a  # of the run's last span
        for i, j in stretches((ratio[a:b] - MARGIN_PER_CHAR).tolist()):
            i, j = a + i, a + j
            if upto[j] - upto[i] < MARGIN - 1e-6:
                continue
            _, once = np.unique(codes[i:j] * len(models.ratio) + codes[i + 1 : j + 1], return_index=True)
            if ratio[i:j][once].sum() <= MARGIN or not any(c.isalpha() for c in text[i : j + 1]):
                continue
            j += 1
            while i > end and text[i - 1].isalnum():
                i -= 1
            while end < j < b + 1 and text[j].isalnum():
                j += 1
            i, end = out.pop()[0] if end > a and i <= end else i, max(end, j)
            out.append((i, 3, end))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, samples: list[tuple[str, int]]) -> DataFrame:
    """The secrets of each row of ``docs`` (doc_id, text), whole texts.

    ``samples`` are labelled strings, 1 for a random string and 0 for an ordinary identifier.
    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the patterns' spans), spans (with the
    models' own, all by start, then kind) and redacted (the text with every span masked).

    Defined cases: null and empty texts have no spans; without samples the models add nothing; null
    and repeated doc_ids are rows like others; an empty table gives no rows; other columns are not
    read.
    """

    shared = docs.sparkSession.sparkContext.broadcast(MarkovPair(samples))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for pdf in batches:
            base = [base_spans(t) for t in pdf["text"]]
            full = [sorted(b + added_spans(t, b, models)) for t, b in zip(pdf["text"], base, strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_assign": [sum(k == 0 for _, k, _ in b) for b in base],
                    "n_access": [sum(k == 1 for _, k, _ in b) for b in base],
                    "n_hex": [sum(k == 2 for _, k, _ in b) for b in base],
                    "base_sha256": [hashlib.sha256(render(b).encode()).hexdigest() for b in base],
                    "spans": [render(s) for s in full],
                    "redacted": [redact(t, s) for t, s in zip(pdf["text"], full, strict=True)],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, schema)


def redact_documents(docs: DataFrame, samples: list[tuple[str, int]]) -> DataFrame:
    """``docs`` with the secrets in text masked and n_chars, if there, brought up to date.

    Defined cases: rows, their number and all other columns stay as they are; a null text stays null, an
    empty one empty; repeated rows are masked alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(MarkovPair(samples))

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = shared.value
        for texts in batches:
            yield pd.Series([None if t is None else redact(t, sorted((b := base_spans(t)) + added_spans(t, b, models))) for t in texts], dtype=object)

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
