"""Near-duplicate classes by BagMinHash.

A document is the multiset of its word shingles. Each shingle owns independent Poisson processes over
the discretised weights 1, 2, 3, ..., gathered in a hierarchy of bands that double: the process of a
band has the band's width as its rate, each of its points falls on one weight of the band and on one
component of the signature, and counts if the document's weight reaches so far. The earliest point
of each component makes the signature; two documents agree on a component with a probability equal
to their weighted Jaccard likeness. Only points before the time that fills all components are
generated, so a signature costs little more than one hash per shingle.

Signatures are cut into bands of rows; documents that share a band are candidates, and the overlap of
their multisets is then counted in full. In a bucket of candidates pairs are not all formed: pivots,
the members with the most candidates, are compared with all others first, links make components, and
of what is left only pairs in different components are compared that the distances to the pivots
(1 - likeness is a metric), the shingles that each has alone and their profiles allow to be near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_or_empty
from .components import components
from .wordhash import Words, mix, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Bands and rows: two documents at the threshold share no band with a probability of 2e-5.
BANDS, ROWS = 28, 5
#: Pivots of a bucket, and most ids (8 bytes each) that are broadcast to find or keep their texts.
PIVOTS, MOST_BROADCAST = 1, 1_000_000
#: Candidates of a pivot, and open members of a bucket, from which on they are dealt over more tasks.
DEGREE_PER_PART, ROWS_PER_TILE = 1 << 14, 1 << 15
#: Hash classes by which the intersection of two multisets is bounded before they are compared.
PROFILE = 256
#: What bounds give way for rounding, so that pairs at the threshold itself are compared.
SLACK = 1e-6

_STEP = np.uint64(0xD1342543DE82EF95)
_LEVEL = np.uint64(0xA0761D6478BD642F)


def shingles_of(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every document: (document, hash, count), ordered by document and hash.

    A document of fewer than ``size`` words, but not none, has its words as one shingle.
    """
    n = np.diff(words.first)
    padded = np.concatenate([words.hashes, np.zeros(size, dtype=np.uint64)])
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    have = np.minimum(n[doc], size)
    h = np.zeros(len(doc), dtype=np.uint64)
    for k in range(size):
        h = mix(h * _STEP + np.where(k < have, padded[at + k], np.uint64(k + 1)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def occurrences(doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) with one hash per occurrence, so that sets overlap as the multisets do."""
    which = np.repeat(np.arange(len(h)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return doc[which], mix(h[which] + k.astype(np.uint64) * _LEVEL)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, components_: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures (documents, components) as the earliest times; inf without shingles."""
    m = components_
    levels = np.zeros(len(count), dtype=np.int64)
    levels[count > 1] = np.ceil(np.log2(count[count > 1])).astype(np.int64)
    which = np.repeat(np.arange(len(h)), levels + 1)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    below = np.where(level == 0, 0, width)
    owner, reach = doc[which], count[which] - below
    stream = mix(h[which] + (level.astype(np.uint64) + np.uint64(1)) * _LEVEL)
    weight = np.bincount(doc, weights=count, minlength=docs)
    out = np.full((docs, m), np.inf)
    flat, open_ = out.reshape(-1), np.flatnonzero(weight > 0)
    until = np.zeros(docs)
    until[open_] = m * (np.log(m) + 4) / weight[open_]
    while len(open_):
        wanted = np.zeros(docs, dtype=bool)
        wanted[open_] = True
        live = np.flatnonzero(wanted[owner])
        s, o, w, r, time = stream[live], owner[live], width[live], reach[live], np.zeros(len(live))
        limit, k = until[o], 0
        while len(s):
            k += 1
            x = mix(s + _STEP * np.full(1, k, dtype=np.uint64))
            time = time - np.log(_uniform(x)) / w
            stay = time <= limit
            if not stay.all():
                s, o, w, r, time, limit, x = s[stay], o[stay], w[stay], r[stay], time[stay], limit[stay], x[stay]
            y = mix(x ^ _LEVEL)
            counts = (y >> np.uint64(32)).astype(np.int64) % w < r
            np.minimum.at(flat, o[counts] * m + (y[counts] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m, time[counts])
        open_ = open_[~np.isfinite(out[open_]).all(axis=1)]
        until[open_] *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of each signature, which differs between bands."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _LEVEL
    for k in range(rows):
        h = mix(h * _STEP + bits[:, :, k])
    return h


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands): key is equal for texts with equal words, or, without words, equal texts."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            keys, bands = [], []
            for i, j in slices(texts, 1 << 20):
                words = words_of(texts[i:j])
                doc, h, count = shingles_of(words)
                hashed = band_hashes(signatures(doc, h, count, j - i)).view(np.int64)
                for d in range(j - i):
                    own = words.hashes[words.first[d] : words.first[d + 1]]
                    raw = b"w" + own.tobytes() if len(own) else b"t" + texts[i + d].encode("utf-8", "surrogatepass")
                    keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                    bands.append(hashed[d] if len(own) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": keys, "bands": bands})

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, key binary, bands array<long>")


def _multisets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, shingles) of the documents in ``wanted`` (doc): sorted 64-bit hashes, one per occurrence."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, held = pdf["text"].tolist(), []
            for i, j in slices(texts, 1 << 20):
                doc, h = occurrences(*shingles_of(words_of(texts[i:j])))
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                held += [np.sort(h[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pd.DataFrame({"doc": pdf["doc_id"], "shingles": held})

    ids = wanted.withColumnRenamed("doc", "doc_id")
    if wanted.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(ids, "doc_id", "left_semi")
    return cut(rows.mapInPandas(run, "doc long, shingles binary").dropDuplicates(["doc"]))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard likeness of two multisets given as sorted hashes of occurrences."""
    common = int(np.isin(a, b, assume_unique=True, kind="sort").sum()) if len(a) and len(b) else 0
    return common / max(len(a) + len(b) - common, 1)


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, likeness) of every pair (hub, doc, parts), its multisets compared in full.

    A hub is in many pairs: these are dealt over ``parts`` parts, to each of which its multiset goes.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            likes = [overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "likeness": likes})

    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    hubs = pairs.select("hub", "parts").distinct().join(sets.select(F.col("doc").alias("hub"), F.col("shingles").alias("x")), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "x")
    both = dealt.join(sets.select("doc", F.col("shingles").alias("y")), "doc").join(hubs, ["hub", "part"])
    return cut(both.select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"), "x", "y").mapInPandas(run, "a long, b long, likeness double"))


def near_links(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between near-duplicate nodes that leave no near pair in different components.

    ``nodes`` has (doc, bands), one row per distinct text; ``docs`` the texts by doc_id.
    """
    spark = docs.sparkSession
    members = nodes.select("doc", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(members.join(sizes, "bucket"))
    degrees = members.groupBy("doc").agg(F.sum("n").alias("degree"))
    sets = _multisets(docs, degrees.select("doc"))
    members = cut(members.join(degrees, "doc").select("bucket", "doc", "degree"))
    tested = spark.createDataFrame([], "a long, b long, likeness double")
    labelled = members.withColumn("component", F.col("doc"))
    pivots = None
    for round_ in range(PIVOTS):
        ahead = F.struct("degree", (-F.col("doc")).alias("minus"))
        spread = labelled.groupBy("bucket").agg(F.max(ahead).alias("top"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        chosen = cut(spread.select("bucket", (-F.col("top.minus")).alias("pivot"), F.ceil(F.col("top.degree") / DEGREE_PER_PART).alias("parts")))
        pairs = labelled.join(chosen, "bucket").where("doc <> pivot").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"), "pivot", "doc", "parts")
        pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("pivot", "doc", "parts")).alias("p")).join(tested, ["a", "b"], "left_anti")
        tested = cut(tested.union(_compare(pairs.select(F.col("p.pivot").alias("hub"), "p.doc", "p.parts"), sets)))
        own = chosen.select("bucket", F.col("pivot").alias(f"pivot{round_}"))
        pivots = own if pivots is None else pivots.join(own, "bucket")
        labelled = cut(_labelled(members, tested, threshold).join(pivots, "bucket"))
        taken = F.col("doc") != F.col(f"pivot{round_}")
        labelled = labelled.where(taken) if round_ < PIVOTS - 1 else labelled
    rest = _allowed_pairs(labelled, tested, sets, threshold)
    more = _compare(rest.join(tested, ["a", "b"], "left_anti").select(F.col("a").alias("hub"), F.col("b").alias("doc"), F.lit(1).cast("long").alias("parts")), sets)
    return tested.union(more).where(F.col("likeness") >= threshold).select("a", "b")


def _labelled(members: DataFrame, tested: DataFrame, threshold: float) -> DataFrame:
    """``members`` with their component under the links found so far."""
    found = components(tested.where(F.col("likeness") >= threshold).select("a", "b"))
    return members.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _profiles(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, n, own, profile) for each of ``docs`` (doc): its occurrences, how many of them no other one
    has, and how many fall in each of PROFILE hash classes."""

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.frombuffer(x, np.int64) for x in pdf["shingles"]]
            yield pd.DataFrame({"shingle": np.concatenate([*arrays, np.array([], np.int64)]), "doc": np.repeat(pdf["doc"].to_numpy(), [len(x) for x in arrays])})

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
            profiles = [np.bincount((a % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE).astype(np.int32) for a in arrays]
            yield pd.DataFrame({"doc": pdf["doc"], "n": [len(a) for a in arrays], "profile": profiles})

    chosen = sets.join(docs, "doc", "left_semi")
    single = chosen.mapInPandas(spread, "shingle long, doc long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).where("n = 1")
    own = single.groupBy("doc").agg(F.count("*").alias("own"))
    counted = chosen.mapInPandas(count, "doc long, n long, profile array<int>")
    return counted.join(own, "doc", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def _allowed_pairs(labelled: DataFrame, tested: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a bucket in different components that may still be near.

    Ruled out are pairs whose distances to a pivot differ too much; pairs that have too many shingles
    of their own, as what no other open document has is in no intersection, but in the union; and
    pairs whose profiles have too little in common, which bounds the intersection from above. A bucket of
    many open members is dealt over tiles: every member meets the members of each tile.
    """
    least = threshold - SLACK
    tiles = F.ceil(F.count("*") / ROWS_PER_TILE)
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), tiles.alias("tiles")).where("low <> high").select("bucket", "tiles")
    rows = cut(labelled.join(open_, "bucket"))
    both = tested.select("a", "b", "likeness").union(tested.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    for k in range(PIVOTS):
        far = both.select(F.col("a").alias("doc"), F.col("b").alias(f"pivot{k}"), (1 - F.col("likeness")).alias(f"far{k}"))
        rows = rows.join(far, ["doc", f"pivot{k}"], "left")
    rows = rows.join(_profiles(sets, rows.select("doc").distinct()), "doc").withColumn("shared", F.col("n") - F.col("own"))
    rows = cut(rows.where((F.col("shared") >= least * F.col("n"))).select("bucket", "tiles", "doc", "component", "n", "own", "shared", "profile", *(f"far{k}" for k in range(PIVOTS))))
    x = rows.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).alias("x")
    y = rows.withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles"))).alias("y")
    near = F.least("x.shared", "y.shared") >= least * (F.greatest("x.shared", "y.shared") + F.col("x.own") + F.col("y.own"))
    for k in range(PIVOTS):
        near = near & F.coalesce(F.abs(F.col(f"x.far{k}") - F.col(f"y.far{k}")) <= 1 - least, F.lit(True))
    common = F.aggregate(F.zip_with("x.profile", "y.profile", lambda a, b: F.least(a, b)), F.lit(0), lambda t, c: t + c)
    near = near & (common * (1 + least) >= least * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.component") != F.col("y.component")) & near)
    return pairs.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of each row of ``docs`` (doc_id, text).

    A class holds what a chain of near duplicates connects: texts with equal words, and texts whose
    multisets of five-word shingles have a weighted Jaccard likeness of ``threshold`` or more. Its
    id is its smallest doc_id.

    Defined cases: a null text counts as empty; texts without words are near equal texts only; a text
    of fewer than five words is one shingle; rows with equal ids are one document and share its
    class; a row without an id joins the class of the texts with equal words, and has no class if
    none of them has an id; an empty table gives no rows; other columns are not read.
    """
    sketches = cut(_sketches(docs))
    texts = cut(sketches.groupBy("key").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands")))
    found = components(near_links(docs, texts.where("doc is not null and bands is not null").select("doc", "bands"), threshold))
    same = _same_id(sketches, texts)
    if same is not None:
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same))
    named = texts.select("key", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", F.coalesce("component", "doc").alias("class_id"))
    return sketches.select("doc_id", "key").join(named, "key").select("doc_id", "class_id")


def _same_id(sketches: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between the texts of rows that share an id; None if every id is one text's."""
    ids = sketches.where("doc_id is not null").select("doc_id", "key").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if ids.isEmpty():
        return None
    return sketches.join(ids, "doc_id").join(texts.select("key", "doc"), "key").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that of the smallest id, and all columns.

    Of rows with equal ids one stays. Rows without an id stay if no document with an id has equal
    words, one per text.
    """
    classes = cut(near_duplicate_classes(docs, threshold))
    kept = classes.where("doc_id = class_id").select("doc_id").distinct()
    n = kept.count()
    out = docs.join(F.broadcast(kept) if n <= MOST_BROADCAST else kept, "doc_id", "left_semi")
    if classes.where("doc_id = class_id").count() > n:
        out = out.dropDuplicates(["doc_id"])
    if classes.where("class_id is null").isEmpty():
        return out
    known = docs.where("doc_id is not null").select(text_or_empty().alias("_words")).distinct()
    lone = docs.where("doc_id is null").withColumn("_words", text_or_empty()).join(known, "_words", "left_anti").dropDuplicates(["_words"])
    return out.unionByName(lone.select(*(F.col(f"`{c}`") for c in docs.columns)))
