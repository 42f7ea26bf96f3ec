"""Best-fit-decreasing sharding of indivisible groups.

Groups of rows that must stay together are sorted by size, and each enters the open shard with the
tightest remaining capacity that still holds it, found in a balanced tree of remainders. Groups of one
size are alike, so they are placed as one class: the tightest shard takes them until the next one
doesn't fit, then the next tightest does, which is what placing them one by one gives. The driver
holds one number and one count per distinct size, which are at most the root of twice the bytes of
all groups, and usually the number of lengths that texts have; rows and groups are only touched by Spark,
which numbers the groups of a class and looks up the shard of each number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for, text_or_empty

#: A group of more than one in so many rows is joined by a broadcast: of them there are fewer than this.
LARGE = 1 << 14


class Remainders:
    """A balanced tree of (remainder, shard): an AVL tree, of which an entry and the tightest fit cost log n steps."""

    def __init__(self):
        self.root: list | None = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = _added(self.root, key)

    def take(self, least: int) -> tuple[int, int] | None:
        """Takes out the smallest (remainder, shard) of at least ``least``; None if there is none."""
        node, found = self.root, None
        while node:
            if node[0][0] >= least:
                node, found = node[1], node[0]
            else:
                node = node[2]
        if found:
            self.root = _without(self.root, found)
        return found


def _height(node: list | None) -> int:
    return node[3] if node else 0


def _turned(node: list, side: int) -> list:
    """``node`` with its child on the other side lifted over it."""
    other = 3 - side
    top = node[other]
    node[other], top[side] = top[side], node
    for x in (node, top):
        x[3] = 1 + max(_height(x[1]), _height(x[2]))
    return top


def _balanced(node: list) -> list:
    node[3] = 1 + max(_height(node[1]), _height(node[2]))
    lean = _height(node[1]) - _height(node[2])
    if abs(lean) < 2:
        return node
    heavy = 1 if lean > 0 else 2
    if _height(node[heavy][heavy]) < _height(node[heavy][3 - heavy]):
        node[heavy] = _turned(node[heavy], heavy)
    return _turned(node, 3 - heavy)


def _added(node: list | None, key: tuple[int, int]) -> list:
    if not node:
        return [key, None, None, 1]
    side = 1 if key < node[0] else 2
    node[side] = _added(node[side], key)
    return _balanced(node)


def _without(node: list, key: tuple[int, int]) -> list | None:
    if key != node[0]:
        side = 1 if key < node[0] else 2
        node[side] = _without(node[side], key)
        return _balanced(node)
    if not (node[1] and node[2]):
        return node[1] or node[2]
    low = node[2]
    while low[1]:
        low = low[1]
    node[0], node[2] = low[0], _without(node[2], low[0])
    return _balanced(node)


Run = tuple[int, int, int]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> tuple[list[Run], int]:
    """Runs (size, shard, number) that place each class (size, number), and how many shards they take.

    Largest first, into the tightest shard that holds it, else a new one; of equal remainders the older
    shard. What is larger than ``capacity`` gets a shard of its own, which nothing else enters.
    """
    tree, runs, used = Remainders(), [], 0
    for size, number in sorted(classes, reverse=True):
        while number:
            left, shard = tree.take(size) or (max(capacity, size), used)
            used = max(used, shard + 1)
            fit = min(number, left // size)
            runs.append((size, shard, fit))
            number -= fit
            tree.add((left - fit * size, shard))
    return runs, used


def tightest_capacity(classes: list[tuple[int, int]], shards: int) -> list[Run]:
    """The runs at the least capacity found at which best-fit-decreasing needs at most ``shards`` shards.

    Bisection between the mean load and a capacity that always suffices: with a capacity of mean
    plus largest item, any shard beyond the last would mean that all others are above the mean.
    """
    total, largest = sum(s * n for s, n in classes), max((s for s, _ in classes), default=0)
    low = max(largest, -(-total // shards), 1)
    high = max(low, -(-total // shards) + largest)
    best = best_fit_decreasing(classes, high)[0]
    while low < high:
        middle = (low + high) // 2
        runs, used = best_fit_decreasing(classes, middle)
        if used <= shards:
            high, best = middle, runs
        else:
            low = middle + 1
    return best


def pack_fixed_capacity(docs: DataFrame, capacity: int, rows_per_task: int = 20_000) -> DataFrame:
    """Packing of the distinct texts of ``docs`` into as few shards of ``capacity`` bytes as best-fit-decreasing needs.

    Returns (key, bytes, shard) for each distinct text; key is the SHA-256 of the text. Defined cases as
    in ``shard_by_bytes``; a group above ``capacity`` has a shard of its own.
    """
    _, groups = _grouped(docs)
    return _placed(groups, best_fit_decreasing(_classes(groups), capacity)[0], rows_per_task).select("key", "bytes", "shard")


def shard_by_bytes(docs: DataFrame, shards: int = 40, rows_per_task: int = 20_000) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) in one of ``shards`` shards of nearly equal bytes.

    Rows with equal texts share a shard. A row's size is its UTF-8 bytes plus 16. Returns doc_id,
    size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null)
    and shard_bytes. ``rows_per_task`` is how many rows a task numbers.

    Defined cases: a null text counts as empty, and so equals an empty one; null and repeated
    doc_ids are rows like others (slots of ties go in an unspecified order); an empty table gives no
    rows; a text of any length is one row; other columns of ``docs`` are not read. A group above
    total / shards makes its shard larger than the rest, since it may not be divided.
    """
    rows, groups = _grouped(docs)
    runs = tightest_capacity(_classes(groups), shards)
    loads = [0] * shards
    for size, shard, n in runs:
        loads[shard] += size * n
    put = cut(_of_groups(rows, cut(_placed(groups, runs, rows_per_task))))
    pieces = parts_for(put.count(), rows_per_task * shards)
    numbered, starts = _numbered(put.withColumn("piece", F.pmod(F.xxhash64(F.col("doc_id"), F.col("size")), F.lit(pieces))), "shard", "doc_id")
    return numbered.join(starts.select("shard", "piece", "first"), ["shard", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.element_at(F.lit(loads).cast("array<long>"), F.col("shard").cast("int") + 1).alias("shard_bytes"),
    )


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, size, text_crc32, key) and their groups (key, bytes, n)."""
    text = text_or_empty()
    rows = cut(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        )
    )
    return rows, cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))


def _classes(groups: DataFrame) -> list[tuple[int, int]]:
    """(bytes, number) of each distinct size of a group."""
    return [(r[0], r[1]) for r in groups.groupBy("bytes").agg(F.count("*").alias("number")).toLocalIterator()]


def _numbered(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, piece, ...) with ``at``, their place in (key, piece), and (key, piece, n, first), where each begins in its key."""
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "piece").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(key, "piece").orderBy(order)) - 1), starts


def _placed(groups: DataFrame, runs: list[Run], rows_per_task: int) -> DataFrame:
    """``groups`` with their shard: the first groups of a class, in any fixed order, go as its first run says, and so on.

    A class may hold most groups, so its groups are numbered in pieces, and a piece has the runs that meet it.
    """
    spark, ends, taken = groups.sparkSession, [], {}
    for size, shard, n in runs:
        begin = taken.get(size, 0)
        taken[size] = begin + n
        ends.append((size, taken[size], begin, shard))
    told = spark.createDataFrame(ends, "bytes long, end long, begin long, shard int").groupBy("bytes").agg(F.sort_array(F.collect_list(F.struct("end", "begin", "shard"))).alias("runs"))
    pieces = parts_for(groups.count(), rows_per_task)
    numbered, starts = _numbered(groups.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(pieces))), "bytes", "key")
    own = F.filter("runs", lambda r: (r["end"] > F.col("first")) & (r["begin"] < F.col("first") + F.col("n")))
    met = starts.join(told, "bytes").select("bytes", "piece", "first", own.alias("runs"))
    nth = F.col("first") + F.col("at")
    shard = F.filter("runs", lambda r: r["end"] > nth)[0]["shard"]
    return numbered.join(met, ["bytes", "piece"]).select("key", "bytes", "n", shard.alias("shard"))


def _of_groups(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` with the shard of their group; the few large groups, whose rows would meet in a task, are broadcast."""
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.broadcast(placed.where(F.col("n") * LARGE > total).select("key", "shard"))
    rest = placed.where(F.col("n") * LARGE <= total).select("key", "shard")
    return rows.join(large, "key").unionByName(rows.join(large, "key", "left_anti").join(rest, "key"))
