import base64
import hashlib
import random
import re
import time

import pytest

from varietas.llm.secretscan import MarkovPair, added_spans, base_spans, labelled_samples, random_strings, redact, redact_documents, render, scan_secrets, stretches

from .conftest import words

KEY = "c1f6c02f845bf3028d7602ad27cf5550"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


TEXTS = [
    f"é password={KEY} and ToKeN : 'abcdefgh' secret=short api_key=\"12345678\" APIKEY=abcd.efg=",
    "token=secret=abcdefghij passwd:=x password= \n abcdefghi",
    f"AKIA{'A' * 12} AKIA{'B' * 11} xAKIA{'C' * 13}x {KEY} {KEY[:31]} g{KEY}{KEY}",
    "ſecret=abcdefgh toKen=abcdefgh password",
    "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns(text):
    assert base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(2)
    plain = words(rng, 6000)
    return [(s, 1) for s in random_strings()] + [(w, 0) for w in plain] + [("_".join(plain[i : i + 3]), 0) for i in range(0, 1500, 3)]


def test_models_tell_held_out_strings_apart(samples):
    models, rng = MarkovPair(samples), random.Random(8)
    names = ["_".join(words(rng, 6)) for _ in range(300)] + ["".join(words(rng, 8)) for _ in range(300)]
    names = [n for n in names if len(n) >= 20]
    secrets = random_strings(300, seed=99)
    assert sum(models.is_secret(n) for n in names) <= 0.01 * len(names)
    assert sum(models.is_secret(s) for s in secrets) >= 0.9 * len(secrets)


def test_base_spans_stay(spark, documents, corpus, samples):
    added = random_strings(1, seed=5)[0]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate([*TEXTS, f"see {added} here"])] + [(99, None, None)], "doc_id long, text string, spans string")
    for r in scan_secrets(rows, samples).collect():
        text = ([*TEXTS, f"see {added} here", None][r["doc_id"]] if r["doc_id"] < 99 else None) or ""
        base = brute(text)
        assert r["base_sha256"] == hashlib.sha256(render(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert set(filter(None, render(base).split(","))) <= set(r["spans"].split(","))
        if added in text:
            assert r["spans"] == f"markov:4:{4 + len(added)}" and r["redacted"] == "see [SECRET] here"
    assert not any("markov" in r["spans"] for r in scan_secrets(documents, samples).collect())


def test_candidates_beside_patterns_add_nothing(samples):
    text = f"token={random_strings(1, seed=4)[0]}"
    assert added_spans(text, base_spans(text), MarkovPair(samples)) == []
    assert redact("ab cd", []) == "ab cd" and redact("abcdef", [(1, 0, 3), (2, 2, 5)]) == "a[SECRET]f"


def plain_stretches(gains):
    """The stretch of largest sum, and those of what is left on either side of it."""
    best = max(((sum(gains[i:j]), -j + i, -i, i, j) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3:]
    return plain_stretches(gains[:i]) + [(i, j)] + [(j + a, j + b) for a, b in plain_stretches(gains[j:])]


def test_stretches_equal_the_plain_form():
    rng = random.Random(5)
    for _ in range(300):
        gains = [rng.choice([-1, 1]) * rng.randint(1, 10**6) / 1024 for _ in range(rng.randrange(24))]
        assert stretches(gains) == plain_stretches(gains)


@pytest.mark.parametrize("kind", ["one key", "words", "keys among words", "one character"])
def test_a_million_key_characters_take_seconds(samples, kind):
    models, rng = MarkovPair(samples), random.Random(4)
    own = words(rng, 1000)
    key = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    text = {"one key": lambda: key(10**6), "words": lambda: "_".join(rng.choices(own, k=170_000)), "keys among words": lambda: "-".join(rng.choice(own) + "/" + key(16) for _ in range(43_000)), "one character": lambda: "a" * 10**6}[kind]()
    begun = time.monotonic()
    spans = added_spans(text, [], models)
    assert time.monotonic() - begun < 10 and len(text) > 9e5
    assert all(a < b <= len(text) for a, _, b in spans) and all(x[2] < y[0] for x, y in zip(spans, spans[1:]))
    if kind == "one key":
        assert spans == [(0, 3, len(text))]
    begun = time.monotonic()
    stretches([(1 - i / 1e6) * (1 if i % 2 == 0 else -1.0001) for i in range(500_000)])
    assert time.monotonic() - begun < 5


@pytest.mark.parametrize("place", ["{}", "https/example/some/path/to/files/{}", "SOME_LONG_NAME_OF_THIS={}", "words-joined-by-lines-here_{}", "{}/" + KEY])
def test_keys_among_words_are_found(samples, place):
    models, rng = MarkovPair(samples), random.Random(3)
    found = 0
    for n in range(16, 26):
        for _ in range(10):
            key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
            text = place.format(key)
            at = text.index(key)
            found += any(a <= at and at + n <= b for a, _, b in added_spans(text, base_spans(text), models))
    assert found >= 85
    ordinary = ["/".join(words(rng, 8)) for _ in range(200)] + ["-".join(words(rng, 8)) for _ in range(200)]
    assert sum(bool(added_spans(t, [], models)) for t in ordinary) <= 4


def test_redaction_keeps_rows_and_columns(spark, odd, empty, samples):
    df = spark.createDataFrame([(1, TEXTS[0], 9, "z"), (2, None, None, None)], "doc_id long, text string, n_chars long, lang string")
    out = redact_documents(df, samples)
    assert out.schema == df.schema or out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert KEY not in rows[1]["text"] and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[1]["lang"] == "z" and rows[2]["text"] is None
    assert scan_secrets(odd, samples).count() == odd.count() and scan_secrets(empty, []).count() == 0
    assert {r["spans"] for r in scan_secrets(odd, []).collect()} == {""}


def test_training_sample_is_labelled(documents):
    labels = [k for _, k in labelled_samples(documents, rows=20)]
    assert labels.count(0) > 100 and labels.count(1) >= 600


def test_planted_keys_in_the_driver_table(spark):
    """Keys without a pattern, of kinds the models aren't trained on: base64 of random bytes, and dashed groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    models, rng = MarkovPair(labelled_samples(docs, rows=300)), random.Random(6)
    found, planted, false = 0, 0, 0
    for i, (text,) in enumerate(docs.select("text").collect()):
        text = text or ""
        false += bool(added_spans(text, base_spans(text), models))
        if i % 5 == 0:
            raw = base64.b64encode(rng.randbytes(rng.choice([16, 20, 24, 32]))).decode()
            key = raw if i % 2 else "-".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8)) for _ in range(3))
            at = text.find(" ") + 1
            text = f"{text[:at]}{key} {text[at:]}"
            spans = [(a, b) for a, k, b in added_spans(text, base_spans(text), models) if a < at + len(key) and b > at]
            planted, found = planted + 1, found + (sum(min(b, at + len(key)) - max(a, at) for a, b in spans) >= 0.5 * len(key))
    assert found >= 0.88 * planted and false <= 10
