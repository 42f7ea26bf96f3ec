"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

A source's target is its share of all tokens by weight, at most ``most`` times what the source has. Among
all rates w of documents, 0 <= w <= most, whose expected tokens meet the targets, entropy balancing takes
those nearest to "each document once" in relative entropy, which are w = min(most, exp(x * size)): the
source's multiplier x solves the convex dual. Rates are then rounded into whole copies.

Documents of one source and size have one rate, so they are counted into classes before anything else,
and the passes read classes. In a pass each source tries Newton's step on the logarithm of its tokens and
seven points that cut the bracket around its multiplier, all in one aggregate. Sums are taken in decimals,
which don't depend on their order, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, parts_for

#: Points of a bracket that a pass tries, beside Newton's.
POINTS = 7
#: Passes after which brackets are as small as doubles allow: each is an eighth of the one before.
PASSES = 60
#: Tokens of a source are near enough to its target at this fraction of it.
NEAR = 1e-9
#: Most sources that are broadcast to their classes (a few numbers each).
FEW = 100_000

WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,9)"


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, rows_per_task: int = 20_000) -> DataFrame:
    """How often each row of ``docs`` (doc_id, source, text) goes into the mix.

    A row's size is its number of words. Sources by code point, null last, weigh ``weights`` over and over.
    Returns doc_id, source, size, source_size, target (double, its source's), rate (double), copies (long),
    taken (copies * size). A source's taken words differ from its target by less than its smallest texts
    wherever their copies can make up the rest.

    Defined cases: a null text has no words and one copy, as an empty one; null ids, repeated ids and
    repeated rows are rows like others; all sizes 0 give targets 0; an empty table gives no rows; texts are
    taken whole; other columns are not read.
    """
    rows = cut(
        docs.select(
            F.col("doc_id"),
            # What sorts as the source by code point, null last.
            F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("origin"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    classes = cut(rows.groupBy("origin", "size").agg(F.count("*").alias("n")))
    sources = targets(classes, weights, most)
    small = sources.count() <= FEW
    planned = rounded(classes, balanced(classes, sources, most, small), most, small)
    dealt = _dealt(rows, planned, rows_per_task)
    return dealt.select(
        "doc_id", F.expr("if(origin = '1', null, substring(origin, 2))").alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixture(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs``, whose ids are unique, with every row as often as ``mixed`` says, and ``copy`` (from 0)."""
    often = mixed.where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    return docs.join(often, "doc_id")


def targets(classes: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """(origin, source_size, least, target) of each source in ``classes`` (origin, size, n).

    Targets are min(most * source_size, weight * level) at the level where they share all tokens: each round
    takes out the sources above their most and raises the level for the others, until none is above.
    """
    sizes = classes.groupBy("origin").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    each = F.lit([float(w) for w in weights])
    ranked = cut(numbered(sizes, "origin").withColumn("weight", F.element_at(each, (F.col("ordinal") % len(weights)).cast("int") + 1)).drop("ordinal"))
    capped, level, known = F.lit(False), 0.0, -1
    while True:
        r = ranked.select("source_size", "weight", capped.alias("capped")).agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))), F.lit(0)), F.sum(F.when(~F.col("capped"), F.col("weight"))), F.count_if("capped")
        ).first()
        if r[3] == known or not r[2]:
            return cut(ranked.withColumn("target", F.when(capped, F.col("source_size") * float(most)).otherwise(F.col("weight") * level)).drop("weight"))
        known, level = r[3], (r[0] - most * r[1]) / r[2]
        capped = F.col("weight") * level > F.col("source_size") * most


def _rate(x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(x))


def _told(sources: DataFrame, small: bool) -> DataFrame:
    """``sources``, one row each, for a join: broadcast if they are at most FEW."""
    return F.broadcast(sources) if small else sources


def balanced(classes: DataFrame, sources: DataFrame, most: int, small: bool) -> DataFrame:
    """``sources`` with the multiplier ``x`` (per token) at which the rates min(most, exp(x * size)) meet the targets; null: all rates are ``most``. ``small``: at most FEW sources."""
    goal, size = F.col("target"), F.col("source_size")
    x0, short = F.lit(0.0), goal < size
    # Below: every text, the smallest too, at the ratio of target and size. Above: all at ``most``.
    state = sources.where((size > 0) & (goal < size * float(most))).select(
        "origin", "target", F.when(short, F.log(goal / size) / F.col("least")).otherwise(x0).alias("low"), F.when(short, x0).otherwise(F.log(F.lit(float(most))) / F.col("least")).alias("high"), x0.alias("newton"), x0.alias("x"), F.lit(False).alias("done")
    )
    state = cut(state)
    used = classes.where("size > 0").select("origin", "size", "n")
    for _ in range(PASSES):
        open_ = state.where("not done")
        if not open_.limit(1).count():
            break
        tries = [F.col("newton"), *(F.col("low") + (F.col("high") - F.col("low")) * (i / (POINTS + 1)) for i in range(1, POINTS + 1))]
        tried = _told(open_.select("origin", *(t.alias(f"t{i}") for i, t in enumerate(tries))), small)
        rates = [_rate(F.col(f"t{i}") * F.col("size"), most) for i in range(len(tries))]
        tokens = F.col("n") * F.col("size").cast("double")
        sums = used.join(tried, "origin").groupBy("origin").agg(
            *(F.sum((tokens * w).cast(EXACT)).cast("double").alias(f"s{i}") for i, w in enumerate(rates)),
            *(F.sum(F.when(w < most, tokens * F.col("size") * w).otherwise(0.0).cast(EXACT)).cast("double").alias(f"d{i}") for i, w in enumerate(rates)),
        )
        state = cut(_next(state, open_, _told(sums, small), tries))
    return sources.join(_told(state.select("origin", "x", F.lit(True).alias("free")), small), "origin", "left").withColumn("x", F.when(F.col("free"), F.col("x"))).drop("free")


def _next(state: DataFrame, open_: DataFrame, sums: DataFrame, tries: list[Column]) -> DataFrame:
    """The state after a pass: narrower brackets, the best point so far, and Newton's step from it."""
    points = F.array(*(F.struct(F.abs(F.col(f"s{i}") - F.col("target")).alias("off"), t.alias("x"), F.col(f"s{i}").alias("s"), F.col(f"d{i}").alias("d")) for i, t in enumerate(tries)))
    under = F.array_max(F.transform(F.filter("points", lambda p: p["s"] <= F.col("target")), lambda p: p["x"]))
    over = F.array_min(F.transform(F.filter("points", lambda p: p["s"] >= F.col("target")), lambda p: p["x"]))
    low, high = F.greatest("low", F.coalesce(under, F.col("low"))), F.least("high", F.coalesce(over, F.col("high")))
    best = F.array_min("points")
    step = best["x"] + (F.log(F.col("target")) - F.log(best["s"])) * best["s"] / best["d"]
    moved = (
        open_.join(sums, "origin")
        .withColumn("points", points)
        .select("origin", "target", low.alias("low"), high.alias("high"), F.when((best["d"] > 0) & (step > low) & (step < high), step).otherwise((low + high) / 2).alias("newton"), best["x"].alias("x"), best["off"].alias("off"))
    )
    narrow = F.col("high") - F.col("low") <= F.abs(F.col("x")) * 4e-16
    return state.where("done").unionByName(moved.withColumn("done", (F.col("off") <= F.col("target") * NEAR) | narrow).drop("off"))


def rounded(classes: DataFrame, sources: DataFrame, most: int, small: bool) -> DataFrame:
    """``classes`` with source_size, target, rate and the whole number of ``copies`` that the class gets.

    In a source, classes by falling size take the whole numbers that their summed rates pass. Sums are first
    taken by octave of sizes, so that no task sorts a source. What then is missing from the target, or too
    much, is less than the largest text, and goes to classes with copies to spare, one an octave, larger
    sizes first, until no class can take more.
    """
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(_rate(F.col("x") * F.col("size"), most), F.lit(float(most))))
    rated = cut(classes.join(_told(sources.drop("least"), small), "origin").withColumn("rate", rate).withColumn("octave", F.length(F.bin("size"))).withColumn("real", (F.col("n") * F.col("rate")).cast(EXACT)))
    before = Window.partitionBy("origin").orderBy(F.desc("octave")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rated.groupBy("origin", "octave").agg(F.sum("real").alias("real")).withColumn("start", F.coalesce(F.sum("real").over(before), F.lit(0))).select("origin", "octave", "start")
    upto = F.sum("real").over(Window.partitionBy("origin", "octave").orderBy(F.desc("size")))
    end = F.col("start") + F.col("upto") + F.lit(0.5).cast("decimal(2,1)")
    placed = rated.withColumn("upto", upto).join(starts, ["origin", "octave"])
    copies = (F.floor(end) - F.floor(end - F.col("real"))).cast("long")
    planned = cut(placed.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * most, copies))).drop("real", "upto", "start", "x"))
    while True:
        moves = cut(_moves(planned, most, small))
        if not moves.limit(1).count():
            return planned.drop("octave")
        planned = cut(planned.join(moves, ["origin", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"))


def _moves(planned: DataFrame, most: int, small: bool) -> DataFrame:
    """(origin, size, move): copies to add or take away, from the class with most to spare of each octave that a source can use."""
    missing = planned.groupBy("origin").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("size") * F.col("copies"))).alias("missing")).where("missing <> 0")
    spare = F.when(F.col("missing") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
    usable = planned.join(_told(missing, small), "origin").withColumn("spare", spare).where((F.col("spare") > 0) & F.col("size").between(1, F.abs("missing")))
    best = usable.groupBy("origin", "octave").agg(F.max(F.struct("spare", "size")).alias("best"), F.first("missing").alias("missing"))
    lists = best.groupBy("origin").agg(F.first("missing").alias("missing"), F.sort_array(F.collect_list(F.struct(F.col("best.size").alias("size"), F.col("best.spare").alias("spare"))), asc=False).alias("best"))
    # Larger sizes first, each as often as it fits into what is left.
    start = F.struct(F.abs("missing").alias("left"), F.expr("cast(array() as array<struct<size:long,move:long>>)").alias("moves"))

    def take(state, c):
        m = F.least(c["spare"], F.floor(state["left"] / c["size"]))
        return F.struct((state["left"] - m * c["size"]).alias("left"), F.concat(state["moves"], F.array(F.struct(c["size"].alias("size"), m.alias("move")))).alias("moves"))

    taken = lists.select("origin", F.signum("missing").cast("long").alias("sign"), F.inline(F.aggregate("best", start, take)["moves"]))
    return taken.where("move > 0").select("origin", "size", (F.col("move") * F.col("sign")).alias("move"))


def _dealt(rows: DataFrame, planned: DataFrame, rows_per_task: int) -> DataFrame:
    """``rows`` with their copies: those of a class as even as whole numbers go, the odd ones by a hash of the ids.

    A class may hold most rows, so it is numbered in pieces; rows of one id are counted first, and told apart at the end.
    """
    told = cut(rows.groupBy("origin", "size", "doc_id").agg(F.count("*").alias("alike")))
    pieces = parts_for(told.count(), rows_per_task)
    told = told.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))
    before = Window.partitionBy("origin", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = told.groupBy("origin", "size", "piece").agg(F.sum("alike").alias("rows")).withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    starts = starts.drop("rows").join(planned, ["origin", "size"])
    upto = F.sum("alike").over(Window.partitionBy("origin", "size", "piece").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = told.withColumn("upto", upto).join(starts, ["origin", "size", "piece"]).withColumn("begin", F.col("first") + F.col("upto") - F.col("alike"))
    # Rows of one id in parts of a thousand, so that no array is long.
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / 1000))))
    last = F.least(F.col("alike"), (F.col("part") + 1) * 1000) - 1
    each = parts.withColumn("place", F.explode(F.sequence(F.col("begin") + F.col("part") * 1000, F.col("begin") + last)))
    return each.withColumn("copies", F.floor(F.col("copies") / F.col("n")) + (F.col("place") < F.col("copies") % F.col("n")).cast("long"))
