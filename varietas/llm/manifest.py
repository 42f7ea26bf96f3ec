"""A Merkle manifest of a table: digests of rows, trees per group, one root, and a proof for each row.

Every row is a leaf. The leaves of a group, in order, are hashed in runs of ``FANOUT`` up to the group's
subroot, and the subroots in the groups' order up to the root. Executors reduce blocks of
``FANOUT ** depth`` leaves; the few heads of the blocks go to the driver, which builds what stands above
and broadcasts to each block the rest of its path. Executors then finish proofs and fold rows. Where there
are more heads than the driver may hold, they are leaves of the same reduction once more, and the paths
come back by a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

FANOUT = 8
#: Levels of a block, whose FANOUT ** DEPTH leaves meet in one row.
DEPTH = 4
#: Most heads of blocks that go to the driver; their broadcast paths take some 20 MB.
TOP = 8_192
#: Of each level of a path: what stands left and right of the own node in its run.
STEP = "struct<left:string,right:string>"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_digest(*values: Column) -> Column:
    """SHA-256 of a row's values, each ``-`` if null, else its UTF-8 bytes after their number and a colon."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on ``path``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def prove(leaves: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """``leaves`` (group_key, id, leaf, ...) with path, subroot and root.

    Group keys are strings, ordered by their bytes; a group's leaves go by id, nulls first, those of one id
    by leaf. Defined cases: no leaves give no rows; equal leaves of one id stand in an unspecified order,
    and each has its own path.
    """
    rows = cut(leaves).withColumn("row_", F.monotonically_increasing_id())
    placed = numbered(rows, "group_key", "id", "leaf", "row_").drop("row_")
    return _proved(_in_groups(placed, top), depth, top, single=False).drop("at", "size")


def _in_groups(placed: DataFrame, top: int) -> DataFrame:
    """``placed`` (group_key, ordinal, ...), in the order of groups, with ``at`` in the group and the group's ``size``."""
    groups = cut(placed.groupBy("group_key").agg(F.min("ordinal").alias("first"), F.count("*").alias("size")))
    told = F.broadcast(groups) if groups.count() <= top else groups
    return placed.join(told, "group_key").withColumn("at", F.col("ordinal") - F.col("first")).drop("ordinal", "first")


def _levels_of(size: Column, depth: int) -> Column:
    """How many of ``depth`` levels a group of ``size`` nodes has."""
    return sum(((size > FANOUT**k).cast("int") for k in range(depth)), F.lit(0))


def _proved(nodes: DataFrame, depth: int, top: int, single: bool) -> DataFrame:
    """``nodes`` (group_key, at, size, leaf, ...) with path, subroot and root; ``single``: one group, whose subroot is the root."""
    width = FANOUT**depth
    own = [c for c in nodes.columns if c not in ("group_key", "size", "at", "leaf")]
    blocks = nodes.withColumn("block", F.floor(F.col("at") / width)).groupBy("group_key", "block").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("at", "leaf", *own))).alias("rows")
    )
    blocks = blocks.withColumn("height", _levels_of(F.col("size"), depth)).withColumn("level0", F.transform("rows", lambda r: r["leaf"]))
    for k in range(depth):
        blocks = blocks.withColumn(f"level{k + 1}", _next_level(F.col(f"level{k}"), F.col("height") > k))
    blocks = cut(blocks.drop("level0"))
    heads = cut(blocks.select("group_key", F.col("block").alias("at"), F.ceil(F.col("size") / width).alias("size"), F.col(f"level{depth}")[0].alias("leaf")))
    above = _above(heads, depth, top, single)
    levels = [lambda i: F.get("rows", i)["leaf"], *(_member(F.col(f"level{k}")) for k in range(1, depth))]
    rows = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ("at", "leaf", *own)), _path(levels, r["at"] % width).alias("steps")))
    told = blocks.join(above, (blocks["group_key"] == above["head_key"]) & (blocks["block"] == above["head"]))
    opened = told.select("group_key", "size", "height", "rest", "subroot", "root", F.inline(rows))
    path = F.concat(F.slice("steps", 1, F.col("height")), F.col("rest"))
    return opened.select("group_key", "size", "at", "leaf", *own, path.alias("path"), "subroot", "root")


def _member(nodes: Column) -> Callable[[Column], Column]:
    """Node i of a level, null beyond its end. Spark's slice would copy the whole level for every run."""
    return lambda i: F.get(nodes, i)


def _next_level(nodes: Column, more: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    members = lambda i: (F.get(nodes, i * FANOUT + k) for k in range(FANOUT))
    return F.when(more, F.transform(runs, lambda i: F.sha2(F.concat_ws("", *members(i)), 256))).otherwise(nodes)


def _path(levels: list[Callable[[Column], Column]], at: Column) -> Column:
    """The steps of the node at place ``at`` of a block through all levels of the block."""
    steps = []
    for k, member in enumerate(levels):
        own = F.floor(at / FANOUT**k).cast("int")
        inside = own % FANOUT
        run = [member(own - inside + i) for i in range(FANOUT)]
        left, right = ([F.when(side, node) for side, node in zip(sides, run, strict=True)] for sides in ([inside > i for i in range(FANOUT)], [inside < i for i in range(FANOUT)]))
        steps.append(F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right")))
    return F.array(*steps)


def _above(heads: DataFrame, depth: int, top: int, single: bool) -> DataFrame:
    """(head_key, head, rest, subroot, root): the path that each head of a block still has to go."""
    spark, schema = heads.sparkSession, f"head_key string, head long, rest array<{STEP}>, subroot string, root string"
    if heads.count() <= top:
        found = _top_tree([(r["group_key"], r["at"], r["leaf"]) for r in heads.collect()], single)
        return F.broadcast(spark.createDataFrame(found, schema))
    if heads.where("size > 1").limit(1).count():
        return _proved(heads, depth, top, single).select(F.col("group_key").alias("head_key"), F.col("at").alias("head"), F.col("path").alias("rest"), "subroot", "root")
    ranked = numbered(heads.select(F.col("group_key").alias("id"), "leaf"), "id").select(
        F.lit("").alias("group_key"), F.col("ordinal").alias("at"), F.lit(heads.count()).cast("long").alias("size"), "leaf", "id"
    )
    over = _proved(ranked, depth, top, single=True)
    return over.select(F.col("id").alias("head_key"), F.lit(0).cast("long").alias("head"), F.col("path").alias("rest"), F.col("leaf").alias("subroot"), "root")


def _tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The head of ``nodes`` and the path of each."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    inside = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), FANOUT)
        for i, members in enumerate(inside):
            begin = i - i % FANOUT
            step = ("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + FANOUT]))
            for m in members:
                paths[m].append(step)
        inside = [[m for members in inside[b : b + FANOUT] for m in members] for b in runs]
        nodes = [sha256("".join(nodes[b : b + FANOUT]).encode()).hexdigest() for b in runs]
    return nodes[0], paths


def _top_tree(heads: list[tuple[str, int, str]], single: bool) -> list[tuple]:
    """Rows of ``_above`` for all heads (group, place, digest)."""
    groups = defaultdict(list)
    for key, at, head in sorted(heads, key=lambda h: (h[0].encode("utf-8", "surrogatepass"), h[1])):
        groups[key].append((at, head))
    if not groups:
        return []
    built = {key: _tree([h for _, h in members]) for key, members in groups.items()}
    subroots = [subroot for subroot, _ in built.values()]
    root, upper = (subroots[0], [[]]) if single else _tree(subroots)
    return [
        (key, at, path + onward, subroot, root)
        for (key, (subroot, paths)), onward in zip(built.items(), upper, strict=True)
        for (at, _), path in zip(groups[key], paths, strict=True)
    ]


def manifest(docs: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text), and what a change of its texts does to the root.

    Leaves are digests of the five columns, groups are languages (null first). In rows where 3 divides the
    crc32 of the decimal doc_id the text's A-Z are lower-cased, and the leaf of that is folded along the path
    of the original siblings. Returns doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified.

    Defined cases: nulls are told from every value; a row without id comes first in its language and isn't
    tampered with; rows of one id go by their leaves; an empty table gives no rows; a text of any length is
    one value; other columns are not read. Languages and ids are compared as the column's type orders them.
    """
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("group_key"),
        F.col("doc_id").alias("id"),
        row_digest(*(F.col(c) for c in columns)).alias("leaf"),
        F.when(touched, row_digest(*(F.col(c) for c in columns[:-1]), F.translate(F.col("text").cast("string"), UPPER, LOWER))).alias("altered"),
    )
    proved = prove(leaves, depth, top)
    back = folded(F.col("path"), F.coalesce("altered", "leaf"))
    told = proved.select(F.col("id").alias("doc_id"), F.expr("substring(nullif(group_key, ''), 2)").alias("lang"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
