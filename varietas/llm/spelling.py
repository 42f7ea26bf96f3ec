"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, which its anagrams share. Of two words that differ by
one letter, the keys differ by that letter's value (one letter more or less) or by the difference of two
values (one letter for another): taking a letter's value out of the longer word's key, or one out of each,
makes them equal. So every word goes out once for each letter with that letter's value taken out, and once
as it is, and equal keys meet in a join. As one letter differs, one half of the two words is the same to the
letter, so a hash of that half is part of what is joined, and of the anagrams only those meet that share a
half. The order of letters is verified last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What makes up a word: letters of ASCII and of Latin-1.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are sums modulo 2 ** 62, so that a word of any length has one.
MASK = (1 << 62) - 1
#: Spark's levenshtein looks at every pair of letters; words with more letters are compared letter by letter.
LONG = 64


def occurrences(docs: DataFrame, shortest: int = 7, misspelt_every: int = 31) -> DataFrame:
    """(word), a row for each run of letters in ``docs`` (doc_id, text) that has ``shortest`` letters at least.

    A-Z are lower-cased. Where ``misspelt_every`` divides the crc32 h of ``<doc_id>:<run>``, the run's letter
    h % length goes: the same slip for the same run in one document. A null doc_id counts as an empty text.
    """
    runs = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0)))
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run")).where(F.char_length("run") >= shortest)
    low = own.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h, at = F.crc32(F.concat_ws(":", "id", "run")), F.col("h") % F.char_length("run")
    slipped = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.char_length("run")))
    return low.withColumn("h", h).select(F.when(F.col("h") % misspelt_every == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= shortest)


def near_words(words: DataFrame) -> DataFrame:
    """Every ordered pair (word, near, near_n) of ``words`` (word, n), all distinct, that are one letter apart.

    Defined cases: words of one letter or none and words that no other is near to have no row; a word may be of
    any length, and goes out at most twice for each different letter in it.
    """
    longer, shorter = _keyed(words)
    a, b = longer.alias("a"), longer.alias("b")
    exchanged = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.word") != F.col("b.word")))
    exchanged = _verified(exchanged, F.char_length("a.word")).select("a.word", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    b = shorter.alias("b")
    fewer = _verified(a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.half") == F.col("b.half"))), F.char_length("a.word"))
    both = F.array(F.struct(F.col("a.word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")), F.struct(F.col("b.word"), F.col("a.word").alias("near"), F.col("a.n").alias("near_n")))
    return exchanged.union(fewer.select(F.inline(both)))


def _keyed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words with a letter taken out of their key, and words with their whole key, both with the half that is the same.

    With m letters in the shorter of two words (or one less than both have), the first m // 2 letters are the same
    if the letter in question stands behind them, else all that follow it from there are.
    """
    powers = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: _power(F.ascii(c).cast("long")))
    lettered = words.select("word", "n", F.char_length("word").alias("length"), powers.alias("powers")).withColumn("sum", F.aggregate("powers", F.lit(0).cast("long"), lambda s, p: (s + p).bitwiseAND(F.lit(MASK))))
    at = F.floor((F.col("length") - 1) / 2).cast("int")
    half = F.floor(F.col("length") / 2).cast("int")

    def side(name: str, same: Column, length: Column) -> Column:
        return F.xxhash64(F.lit(name), length, same)

    def without(powers: Column, half: Column, last: bool) -> Column:
        return F.transform(F.array_distinct(powers), lambda p: F.struct((F.col("sum") - p).bitwiseAND(F.lit(MASK)).alias("key"), half.alias("half"), F.lit(last).alias("last")))

    rest = F.col("length") - 1
    behind = without(F.slice("powers", at + 1, F.col("length")), side("first", F.substring("word", F.lit(1), at), rest), False)
    before = without(F.slice("powers", F.lit(1), at), side("last", F.substring("word", at + 2, F.col("length")), rest), True)
    longer = lettered.select("word", "n", F.inline(F.concat(behind, before)))
    whole = F.array(
        F.struct(F.col("sum").alias("key"), side("first", F.substring("word", F.lit(1), half), F.col("length")).alias("half")),
        F.struct(F.col("sum").alias("key"), side("last", F.substring("word", half + 1, F.col("length")), F.col("length")).alias("half")),
    )
    return longer, lettered.select("word", "n", F.inline(whole))


def _power(code: Column) -> Column:
    return code * code * code * code * code


def _verified(met: DataFrame, length: Column) -> DataFrame:
    """Of words a and b that met: those one letter apart. A pair whose first halves are equal too counts where these met."""
    at = F.floor((length - 1) / 2).cast("int")
    once = ~F.col("a.last") | (F.substring("a.word", F.lit(1), at) != F.substring("b.word", F.lit(1), at))
    return met.where(once & F.when(length <= LONG, F.levenshtein("a.word", "b.word", 1) == 1).otherwise(_one_apart(F.col("a.word"), F.col("b.word"))))


def _one_apart(a: Column, b: Column) -> Column:
    """For words of any length, ``a`` as long as ``b`` or one letter longer: the letters after the first difference are the same."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, True).cast("int")
    same = F.char_length(a) == F.char_length(b)
    return F.substring(a, first + 1, F.char_length(a)) == F.substring(b, F.when(same, first + 1).otherwise(first), F.char_length(b))


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, misspelt_every: int = 31) -> DataFrame:
    """The words of ``docs`` (doc_id, text) and the form that each is a variant of.

    Words are ``occurrences`` that are there ``least`` times (n) at least. A word's form is the most frequent of
    the words one letter away (ties: the first in code-point order), if that is ``times`` times as frequent or
    more; its root is where forms lead to. Returns word, form, root, n, n_near, form_n.

    Defined cases: null and empty texts have no words; rows are counted as often as they are there, whatever their
    ids; a null id counts as an empty text; an empty table gives no rows; texts and words are taken at any
    length; other columns are not read. Forms are more frequent than their words, so they never lead in a circle.
    """
    words = cut(occurrences(docs, shortest, misspelt_every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.less") >= F.col("n") * times
    formed = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")
        )
    )
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    # A chain of d forms ends at a word that is times ** d as frequent as its start; each round doubles the steps taken.
    most, depth = words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], 0
    while least * times ** (depth + 1) <= most:
        depth += 1
    steps = 1
    while steps < depth:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = cut(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
        steps *= 2
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
