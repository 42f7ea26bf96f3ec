import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random texts, exact and near copies, a shared passage, and odd cases."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randint(3, 180))) for _ in range(50)]
    passage = " ".join(words(rng, 45))
    for i in range(0, 24, 3):
        texts[i] += f". {passage} " + " ".join(words(rng, 10))
    for i in range(12):
        near = texts[i].split(" ")
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
        texts.append(texts[i])
    long = " ".join(words(rng, 6000))
    texts += [None, "", "", "...", "one two", "One, two!", "é" * 150, "a" * 400, "ab" * 160, "日本語 テスト " * 30, long, long + " tail", " lead", "trail \n\n ", "tab\tand\r\nline"]
    return list(enumerate(texts, start=3))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, "k", 0.5) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, shard int, uid string, score double").repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, nulls everywhere."""
    rows = [(None, None), (None, "same words in two rows of this table"), (7, "same words in two rows of this table"), (7, "same words in two rows of this table"), (7, "another text under the same id, and long enough to matter"), (8, None), (9, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
