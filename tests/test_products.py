"""Containment, range bins, patterns and skew against comparisons of all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import products


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_contained(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcé:-") for _ in range(r.randint(0, 14))) for _ in range(150)]
    names = {"".join(r.choice("abcé:-") for _ in range(r.randint(1, 5))) for _ in range(80)} | {"zzz", "abczzz"}
    texts = sorted(set(texts))
    got = products.contained(table(spark, [(n,) for n in [*names, ""]], "name string"), table(spark, [(t,) for t in texts], "text string"))
    want = {(n, t) for n in names for t in texts if n in t}
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want) > 200
    none = table(spark, [("",)], "name string")
    assert products.contained(none, table(spark, [("a",)], "text string")).count() == 0


def test_range_bins_cover_once(spark):
    r = random.Random(5)
    pairs = [(0, 0), (0, 2**20 - 1), (5, 4), (1, 2), (3, 3), (0, 10**9), (2**20 - 1, 10**9)] + [tuple(sorted((r.randrange(300), r.randrange(300)))) for _ in range(40)]
    rows = table(spark, pairs, "lo long, hi long").select("lo", "hi", products.range_bins(F.col("lo"), F.col("hi")).alias("b")).collect()
    for x in rows:
        assert len(x.b) <= 2 * products.LEVELS + 1
        top = min(x.hi, 2**20 - 1)
        for m in {*range(301), x.lo, top}:
            assert sum((b.level, b.bin) == (b.level, m >> b.level) for b in x.b) == (x.lo <= m <= top)


def test_versions_in_ranges(spark):
    r = random.Random(6)
    v = [f"{r.randrange(6)}.{r.randrange(3)}.{r.randrange(3)}" for _ in range(40)] + ["x", "3", "70000000.1.1"]
    ranges = [(i % 2, i, None if r.random() < 0.2 else f"{r.randrange(6)}.{r.randrange(3)}", None if r.random() < 0.2 else f"v{r.randrange(7)}.1.{r.randrange(3)}") for i in range(60)] + [(0, 99, "zz", "70000000.1.1")]
    read = lambda x: (tuple(map(int, x.lstrip("v").split("."))) + (0, 0))[:3] if x and re.fullmatch(r"v?\d+(\.\d+)*", x) else None
    keyed = [(k, x) for k in (0, 1) for x in dict.fromkeys(v)]
    want = {(k, x, i) for k, x in keyed for q, i, a, b in ranges if k == q and read(x) and (not read(a) or read(x) >= read(a)) and (not read(b) or read(x) <= read(b))}
    got = products.in_ranges(table(spark, keyed, "k int, version string"), table(spark, ranges, "k int, advisory_id int, min_version string, max_version string"), ["k"])
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want) > 300


def test_product_advisories(spark):
    deps = table(spark, [("Left-Pad", "1.2.0"), ("pad", "9.0.0"), ("", "1.0.0"), ("none", "bad")], "name string, version string")
    feed = table(spark, [(1, 0.5, False, "2024-01-30"), (2, 0.9, True, "2024-01-30"), (3, 0.7, False, "2023-01-01"), (4, 0.1, False, "2024-01-30"), (5, None, False, "2024-01-30")], "advisory_id int, epss_percentile double, kev boolean, ingested_at string").withColumn("ingested_at", F.to_timestamp("ingested_at"))
    cpes = table(spark, [(1, "cpe:2.3:a:x:LEFT-pad:*"), (2, "cpe:2.3:a:y:pad:1"), (3, "cpe:pad")], "advisory_id int, cpe string")
    ranges = table(spark, [(1, "1.0.0", "1.9.9"), (1, "1.1.0", "2.0.0"), (4, "8.0.0", None)], "advisory_id int, min_version string, max_version string")
    got = products.product_advisories(deps, feed, cpes, ranges, F.lit("2024-02-01").cast("timestamp"), 30)
    # 5 names no product and has no range: it counts for all; 3 is stale
    assert {tuple(x) for x in got.collect()} == {("Left-Pad", "1.2.0", 2, 0.5, False), ("pad", "9.0.0", 3, 0.9, True), ("", "1.0.0", 3, 0.9, True), ("none", "bad", 1, 0.0, False)}


@pytest.mark.parametrize("block", [500, 1])
def test_confusion_hits(spark, monkeypatch, block):
    monkeypatch.setattr(products, "PATTERNS", block)
    patterns = ["^acme-", "^(foo|bar)x", "^ab?c", "core$", "^@acme/.*", "(", "^a|b", "^(x|y)?z", "", None, "a.c"]
    names = ["acme-pay", "foox", "barx1", "ac", "abc", "a-core", "@acme/pay", "b", "zz", "xz"]
    p = table(spark, [(i, i, x, ["@acme", "acme.test"]) for i, x in enumerate(patterns)], "org_id int, watchlist_id int, internal_package_pattern string, trusted_domains array<string>")
    sources = [None, "https://evil.test/acme.test", "https://npm.ACME.test/x", "@acme", "@acme/x", "@acmex", "npm.acme.test", ""]
    trusted = [False, False, True, True, True, False, True, False]
    rows = [(k, n, s) for k, (n, s) in enumerate(itertools.product(names, sources))]
    good = [i for i, x in enumerate(patterns) if x and x != "("]
    want = {(i, k) for i in good for k, n, s in rows if re.search(patterns[i], n) and not trusted[sources.index(s)]}
    got = products.confusion_hits(table(spark, rows, "package_id int, name string, resolved_from string"), p)
    assert {(x.watchlist_id, x.package_id) for x in got.collect()} == want and got.count() == len(want)


def test_confusion_hits_in_blocks(spark, monkeypatch):
    """Hits and watchlists of a rule meet in small blocks, each once; a watchlist may have several rules."""
    monkeypatch.setattr(products, "HITS", 3)
    monkeypatch.setattr(products, "MEMBERS", 4)
    lists = [(i % 3, i, ["^a-", "^b", "[05]$"][i % 3], ["x.test"] if i % 2 else None) for i in range(60)] + [(0, 0, "^b", None), (0, 0, "^c", None)]
    names = [f"{'abc'[i % 3]}-{i}" for i in range(40)]
    rows = [(i, n, "https://x.test/q" if i % 4 == 0 else None) for i, n in enumerate(names)]
    want = sorted((o, w, k, n) for o, w, p, d in lists for k, n, s in rows if re.search(p, n) and not (d and s))
    got = products.confusion_hits(table(spark, rows, "package_id int, name string, resolved_from string"), table(spark, lists, "org_id int, watchlist_id int, internal_package_pattern string, trusted_domains array<string>"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 600


def test_timestamp_skew(spark):
    r = random.Random(1)
    rows = [(k, r.choice([None, *range(0, 400_000, 1000), 172_800, 172_801])) for k in range(12) for _ in range(k)]
    df = table(spark, rows, "k int, t int").withColumn("at", F.timestamp_seconds("t"))
    want = set()
    for k in range(1, 12):
        every = [t for q, t in rows if q == k]
        some = [t for t in every if t is not None]
        pairs = sum(abs(a - b) > 172_800 for a, b in itertools.combinations(some, 2))
        want.add((k, len(every), *((max(some) - min(some), pairs, pairs == 0) if len(some) > 1 else (None,) * 3)))
    assert {tuple(x) for x in products.timestamp_skew(df, ["k"], "at").collect()} == want
