"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into phrases: each is the shortest string not yet in the
dictionary, which it then joins. The phrases, hashed, are the text's set; its fingerprint holds the
smallest hashes, and two fingerprints are alike by the share of common hashes among the smallest of
their union, which estimates the Jaccard likeness of the phrase sets and so how well one text helps
to compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Hashes in a fingerprint, and hex digits of each.
SIZE, DIGITS = 128, 8
#: Text bytes that one task fingerprints at least, where the cluster's partitions are fewer.
BYTES_PER_TASK = 8 << 20
#: Most ranges of ids, and how many bounds one step of the search for a row's range looks at.
MOST_RANGES, BOUNDS_AT_ONCE = 1 << 16, 1 << 8
#: What stands for a null id in the order of ids: below every other.
LOWEST = -(1 << 63)


def parse(text: str, phrases: set[str], begin: int, at: int) -> int:
    """Parse text[begin:], of which text[begin:at] is known to be no new phrase, into ``phrases``.

    Returns where the last, unfinished phrase begins.
    """
    add = phrases.add
    for end in range(at + 1, len(text) + 1):
        phrase = text[begin:end]
        if phrase not in phrases:
            add(phrase)
            begin = end
    return begin


def hashes(phrases: Iterable[str]) -> set[int]:
    return {xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) for p in phrases}


def smallest(values: set[int], size: int = SIZE) -> list[int]:
    return sorted(values)[:size]


def likeness(a: list[int], b: list[int], size: int = SIZE) -> float:
    """Share of common hashes among the smallest of the union; two empty texts are alike."""
    if not a or not b:
        return float(a == b)
    both, union = set(a) & set(b), smallest(set(a) | set(b), size)
    return sum(h in both for h in union) / len(union)


def render(values: list[int]) -> str:
    return "".join(f"{h:0{DIGITS}x}" for h in values)


def fingerprint(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row of ``docs`` (doc_id, text), without a shuffle.

    Defined cases as in ``fingerprint_edited``.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = []
            for text in pdf["text"]:
                parse(text, phrases := set(), 0, 0)
                prints.append(render(smallest(hashes(phrases), size)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": [len(t) for t in pdf["text"]], "fingerprint": prints})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, f"doc_id {kind}, n_chars long, fingerprint string")


class _Document:
    """A text parsed up to where its edited version departs, and to its end."""

    def __init__(self, doc_id: object, text: str, size: int):
        self.doc_id, self.text, self.size = doc_id, text, size
        self.kept = len(text) - len(text) // 3
        self.phrases: set[str] = set()
        self.begin = parse(text[: self.kept], self.phrases, 0, 0)
        self.hashes = hashes(self.phrases)
        whole = set(self.phrases)
        parse(text, whole, self.begin, self.kept)
        self.print = smallest(self.hashes | hashes(whole - self.phrases), size)

    def row(self, following: _Document) -> tuple:
        """The output row, given the document that follows in the order."""
        edited = self.text[: self.kept] + following.text[: len(self.text) - self.kept]
        more = set(self.phrases)
        parse(edited, more, self.begin, self.kept)
        changed = smallest(self.hashes | hashes(more - self.phrases), self.size)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, len(self.text), digest, render(self.print), render(changed), likeness(self.print, changed, self.size), likeness(self.print, following.print, self.size)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprint_edited(docs: DataFrame, size: int = SIZE, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """Fingerprints of each text and of its edited version, whose last third comes from the next one.

    The next document is the one with the next smaller doc_id (after the last: the first). The rows
    are dealt once, into ranges of ids whose bounds are ids of the table; the first row of a range
    also goes to the range before it, so that every row meets its next one in its own task, where
    rows stream in order and two are held at a time.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined cases: a null text counts as empty, and an empty text has an empty fingerprint, which is
    like an empty one only; rows with equal ids follow each other by text, in one task; null ids
    come last; ids that are no whole numbers fail; a
    table of one row has itself as next; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("place"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // bytes_per_task), MOST_RANGES))
    bounds = _bounds(rows, wanted)
    count = len(bounds)
    dealt = _dealt(rows, bounds)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Document] = {}
        for pdf in batches:
            out = []
            for doc_id, text, to, ahead in zip(pdf["doc_id"], pdf["text"], pdf["to"], pdf["ahead"], strict=True):
                before = held.get(to)
                if ahead and before is None:
                    continue
                now = _Document(doc_id, text, size)
                if before is not None:
                    out.append(before.row(now))
                held.clear()
                if not ahead:
                    held[to] = now
            yield pd.DataFrame(out, columns=list(COLUMNS)).astype({"doc_id": pdf["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return (
        dealt.repartitionById(count, F.col("to"))
        .sortWithinPartitions("to", "ahead", F.desc("place"), "text")
        .select("doc_id", "text", "to", "ahead")
        .mapInPandas(run, schema)
    )


def _bounds(rows: DataFrame, wanted: int) -> list[int]:
    """Ascending ids of the table that close ``wanted`` ranges of about equal rows, the last the largest id."""
    shares = [(i + 1) / wanted for i in range(wanted)]
    found = rows.agg(F.percentile_approx("place", shares, 100 * wanted).alias("p"), F.max("place").alias("top")).first()
    return sorted({*(found["p"] or ()), *([] if found["top"] is None else [found["top"]])}) or [LOWEST]


def _below(bounds: list[int], place: Column) -> Column:
    """How many of the ascending bounds are below ``place``: looked up among every BOUNDS_AT_ONCE-th, then among those that follow."""
    below = lambda some: F.size(F.filter(some, lambda b: b < place))
    coarse = bounds[BOUNDS_AT_ONCE - 1 :: BOUNDS_AT_ONCE]
    before = below(F.lit(coarse).cast("array<long>")) * BOUNDS_AT_ONCE if coarse else F.lit(0)
    return before + below(F.slice(F.lit(bounds).cast("array<long>"), before + 1, F.lit(BOUNDS_AT_ONCE)))


def _dealt(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Rows with the range they go to; a range's first rows once more, ahead of their own range."""
    count = len(bounds)
    own = rows.select("doc_id", "text", "place", _below(bounds, F.col("place")).alias("own"))
    there = own.withColumn("opens", F.coalesce(F.get(F.lit(bounds).cast("array<long>"), F.col("own")) == F.col("place"), F.lit(False)))
    home = F.struct(F.col("own").alias("to"), F.lit(False).alias("ahead"))
    also = F.struct(F.pmod(F.col("own") + 1, F.lit(count)).alias("to"), F.lit(True).alias("ahead"))
    return there.select("doc_id", "text", "place", F.explode(F.when(F.col("opens"), F.array(home, also)).otherwise(F.array(home))).alias("go")).select("doc_id", "text", "place", "go.to", "go.ahead")
