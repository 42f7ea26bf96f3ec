import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from varietas.llm.spelling import near_words, spelling_variants

SCHEMA = "doc_id long, text string"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_words(rows, shortest, least, every):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= shortest
    return {w: n for w, n in counts.items() if n >= least}


def one_apart(a, b):
    """By definition: exactly one letter more, less or different."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, times):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= times * words[w] else None
    found = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.add((w, forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None))
    return found


def told(found):
    rows = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters,shortest", [("ab", 1), ("aé", 3), ("abcÿ", 4)])
def test_near_words_against_their_definition(spark, letters, shortest):
    """Few letters: words full of anagrams and repeated letters."""
    rng = random.Random(shortest)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, shortest + 5))): rng.randint(1, 9) for _ in range(150)}
    found = Counter((r[0], r[1], r[2]) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect())
    assert found == Counter((a, b, words[b]) for a in words for b in words if one_apart(a, b))


@pytest.mark.parametrize("times,every", [(10, 31), (2, 3), (3, 1)])
def test_variants_against_plain_ones(spark, times, every):
    rng = random.Random(times)
    stems = ["".join(rng.choice("aeinrstéÖ") for _ in range(rng.randint(6, 12))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice((str, str.upper, str.title))(stems[min(11, int(rng.expovariate(0.5)))]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, rows[3][1]), rows[5], rows[5]]
    expected = plain_variants(plain_words(rows, 7, 2, every), times)
    found = told(spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(4), times=times, misspelt_every=every))
    assert found == expected and any(f[1] for f in found)


def test_chains_of_forms(spark):
    """Forms lead over several words to one root."""
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    rows = [(i, f"{w} " * 2 ** (i + 1)) for i, w in enumerate(words)]
    found = told(spelling_variants(spark.createDataFrame(rows, SCHEMA), times=2, misspelt_every=10**9))
    assert found == plain_variants(plain_words(rows, 7, 2, 10**9), 2) and {f[2] for f in found} == {words[-1]}


def test_very_long_words(spark):
    """Words of 200,000 letters, of one letter and of many."""
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(200_000))
    words = [long, long[:70_000] + "x" + long[70_000:], long[:150_000] + long[150_001:], "a" * 200_000, "a" * 199_999]
    rows = [(i, f"{w} {w}") for i, w in enumerate(words)]
    found = {(len(r[0]), r[0][0], r[4]) for r in told(spelling_variants(spark.createDataFrame(rows, SCHEMA), misspelt_every=10**9))}
    assert found == {(200_000, long[0], 2), (200_001, long[0], 1), (199_999, long[0], 1), (200_000, "a", 1), (199_999, "a", 1)}


def test_odd_tables(spark, odd, empty):
    rows = [tuple(r) for r in odd.collect()]
    assert told(spelling_variants(odd)) == plain_variants(plain_words(rows, 7, 2, 31), 10)
    clashing = odd.withColumns({c: F.lit("x") for c in ("word", "n", "id", "run", "h", "key", "half", "form", "root", "near")})
    assert told(spelling_variants(clashing)) == told(spelling_variants(odd))
    assert spelling_variants(empty).count() == 0
