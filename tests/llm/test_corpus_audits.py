"""Divergence audit, repeated bytes and resampling against brute force."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import DOCS, ITEMS, ROWS

from riskloom.llm import divergence, parsing, resample


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def text_of(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    words = [f"{a}{b}" for a in ["ka", "Lo", "mi", "ö", "sé"] for b in ["ra", "tu", "-ne", "3x", "po", "di", "b c"]]
    return [(r.choice(["en", "de", "", None]), r.choice([f"s{i}" for i in range(7)] + [None, ""]), text_of(r, words[: r.randint(5, 35)], r.randint(0, 30))) for _ in range(150)] + [("xx", "a", "one"), ("xx", "b", None), ("yy", "solo", "x " * 20)]


@pytest.mark.parametrize(("groups", "terms"), [(32, 4096), (2, 5), (3, 1)])
def test_divergence(spark, corpus, monkeypatch, groups, terms):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    df = spark.createDataFrame([(*r, "x", 1) for r in corpus], "lang string, source string, text string, value string, rank int").repartition(5)
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute.divergence(corpus)
    assert sorted(tuple(r) for r in got.collect()) == want and sum(x[2] == "term" for x in want) > 20
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_of_odd_rows(docs):
    assert sorted(tuple(r) for r in divergence.audit(docs, least=1).collect()) == brute.divergence([(r[2], r[3], r[1]) for r in ROWS], 1)


def test_counts_are_flushed_whole(spark, corpus, monkeypatch):
    one = {tuple(r) for r in divergence.term_counts(spark.createDataFrame(corpus, "lang string, source string, text string").fillna("")).collect()}
    parts = [divergence._count]
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    many = {tuple(r) for r in divergence.term_counts(spark.createDataFrame(corpus, "lang string, source string, text string").fillna("")).collect()}
    assert parts and one == many and len(one) > 100


def test_shares_are_exact_for_large_counts(spark):
    n, total, kept = 10**17 + 7, 3 * 10**18 + 1, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def repeats():
    """Passages shared in part, with edits, copies, runs, periods and repeats within a text."""
    r = random.Random(4)
    letters = "abcdefghij klmnop éü"

    def noise(n):
        return "".join(r.choice(letters) for _ in range(n))

    passage, long = noise(900), noise(3000)
    texts = [None, "", "x" * 399, "x" * 400, "x" * 2000, "ab" * 700, "abc" * 500 + noise(50) + "abc" * 200, passage, passage]
    for _ in range(12):
        a = r.randint(0, 480)
        texts.append(noise(r.randint(0, 300)) + passage[a : a + r.randint(380, 420)] + noise(r.randint(0, 300)))
    for _ in range(12):
        t = list(long)
        for _ in range(r.randint(1, 6)):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t)[r.randint(0, 500) : r.randint(2000, 3000)])
    texts += [noise(500), noise(1200) + passage[:450] + noise(40) + passage[30:700], long[:1000] + long[:1000], long[100:499], long[100:500], noise(5000)]
    return texts


@pytest.mark.parametrize("limit", [256, 3, 1])
def test_repeated_bytes(spark, monkeypatch, limit):
    monkeypatch.setattr(parsing, "LIMIT", limit)
    texts = repeats()
    want = Counter((i, *x) for i, x in enumerate(brute.repeated_bytes(texts)))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, row long, removed string").repartition(4)
    got = parsing.without_repeats(df)
    assert Counter(tuple(r) for r in got.drop("kept").collect()) == want
    assert sum(x[2] > 0 for x in want) > 20 and any(0 < x[2] < x[1] for x in want)


def test_repeated_bytes_of_odd_rows(docs):
    want = Counter((r[0], *x) for r, x in zip(ROWS, brute.repeated_bytes([r[1] for r in ROWS]), strict=True))
    assert Counter(tuple(r) for r in parsing.without_repeats(docs).drop("kept").collect()) == want
    assert parsing.without_repeats(docs.limit(0)).count() == 0


def test_phrases_are_prefix_free():
    r = np.random.default_rng(3)
    a = r.integers(97, 101, 20_000).astype(np.uint8)
    t = parsing.triggers(a)
    assert 200 < len(t) < 800
    text = a.tobytes()
    phrases = {text[i : j + parsing.TRIGGER] for i, j in zip(t[:-1].tolist(), t[1:].tolist(), strict=True)}
    suffixes = {p[i:] for p in phrases for i in range(len(p) - parsing.TRIGGER)}
    ordered = sorted(suffixes)
    assert not any(y.startswith(x) for x, y in zip(ordered[:-1], ordered[1:], strict=True))


def test_position_table_is_crc32():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    start = np.concatenate((r.integers(0, 2000, 300), [0, 3, 0]))
    length = np.concatenate((r.integers(1, 200, 300), [64, 128, 5000]))
    assert resample.span_crcs(data, start, length).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start.tolist(), length.tolist(), strict=True)]


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (3, 50, 1)])
def test_resampling(spark, docs, longest, percent, least):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(x[0], x[1]) for x in ROWS] + [(100 + i, text_of(r, words, r.randint(0, 60))) for i in range(200)] + [(500, text_of(random.Random(1), words, 30))] * 3
    targets = [x[1] for x in ITEMS]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score long").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = resample.resampled(df, items, percent=percent, least_words=least, longest=longest)
    want = Counter((x[0], *y) for x, y in zip(rows, brute.resampled(rows, targets, longest, percent, least), strict=True))
    assert Counter(tuple(x) for x in got.collect()) == want and sum(x[-1] is not None for x in want) > 10
    assert resample.resampled(df.limit(0), items).count() == 0
    assert resample.resampled(df, items.limit(0)).count() == len(rows)
