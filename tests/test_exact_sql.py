"""Borders at which a query and its SQL differed on larger tables."""

import os

import compare
import pytest

from riskloom.operators import products, scoring, tables
from riskloom.plans import queries


def test_correlation_means_on_a_step(spark):
    """Tenths whose mean is 0.2, 0.5 or 0.8 exactly; added up as doubles many of them fall short."""
    groups = [v for t in (2, 5, 8) for a in range(11) for b in range(11) if 0 <= 3 * t - a - b <= 10 for v in [(t, (a, b, 3 * t - a - b))]]
    assert any(sum(x / 10 for x in v) / 3 < t / 10 for t, v in groups)
    cves = spark.createDataFrame([(i, 0.0, 0.0, False) for i in range(len(groups))], "id int, cvss_score double, epss_percentile double, is_kev boolean")
    det = spark.createDataFrame([(i, "d", x / 10, True) for i, (_, v) in enumerate(groups) for x in v], "id int, detector string, confidence double, detected boolean")
    got = dict(scoring.correlation_score(cves, det, "id").select("id", "score").collect())
    assert got == {i: {2: 5, 5: 10, 8: 15}[t] for i, (t, _) in enumerate(groups)}


@pytest.fixture
def folder(spark, sf, tmp_path):
    """Makes a folder of tables in which the given ones stand for those of sf."""

    def make(**tables):
        for t in compare.TABLES:
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
        for t, df in tables.items():
            os.unlink(tmp_path / f"{t}.parquet")
            df.write.parquet(str(tmp_path / f"{t}.parquet"))
            os.rename(tmp_path / f"{t}.parquet", tmp_path / f"{t}.parts")
            os.symlink(next((tmp_path / f"{t}.parts").glob("part-*.parquet")), tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def test_lockfile_risk_on_a_half(spark, sf, folder):
    """Seven scores whose 0.65 of the greatest and 0.35 of the mean are a half but for the last bit of a double."""
    line, order = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1), spark.read.parquet(f"{sf}/orders.parquet").limit(1)
    wanted = [[36, 22, 16, 12, 12, 12, 12], [36, 30, 20, 14, 14, 14, 14], [52, 50, 48, 44, 40, 40, 40], [62, 40, 36, 30, 28, 24, 24]]
    rows = spark.createDataFrame([(i, 12 * (7 * i + k) + 3, x / 2) for i, v in enumerate(wanted) for k, x in enumerate(v)], "o long, p long, q double").coalesce(1)
    items = line.drop("l_orderkey", "l_partkey", "l_quantity").crossJoin(rows).selectExpr("o as l_orderkey", "p as l_partkey", "q as l_quantity", "*").select(line.columns)
    orders = order.drop("o_orderkey", "o_custkey").crossJoin(rows.select("o").distinct().coalesce(1)).selectExpr("o as o_orderkey", "o as o_custkey", "*").select(order.columns)
    at = folder(lineitem=items.coalesce(1), orders=orders.coalesce(1))
    assert compare.differences(queries.QUERIES["j12_a14_lockfile_risk"](spark, at), compare.connect(at), queries.ORACLES["j12_a14_lockfile_risk"]) == []


def test_top_vulnerability_of_large_ids(spark, sf, folder):
    """Of ids in the millions the greater percentile still counts first."""
    line, order = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1), spark.read.parquet(f"{sf}/orders.parquet").limit(1)
    ids = spark.range(1, 9_000_000, 50_021).coalesce(1)
    at = folder(lineitem=line.drop("l_orderkey").crossJoin(ids).withColumnRenamed("id", "l_orderkey").select(line.columns).coalesce(1), orders=order.drop("o_orderkey").crossJoin(ids).withColumnRenamed("id", "o_orderkey").select(order.columns).coalesce(1))
    assert compare.differences(queries.QUERIES["j26_top_vulnerability"](spark, at), compare.connect(at), queries.ORACLES["j26_top_vulnerability"]) == []


def test_newer_versions_are_not_paired(spark):
    """Equal versions of different spelling aren't newer than each other, unreadable ones are left out, no join is made."""
    rows = [(1, v) for v in ("1.0.0", "01.0.0", "1.0", "2.0.0", "10.0.0", "x")] + [(2, "1.0.0")]
    got = tables.newer_versions(spark.createDataFrame(rows, "package_id int, version string"))
    old = ["10.0.0", "2.0.0"]
    assert {(p, v): c for p, v, c in got.collect()} == {(1, "1.0.0"): old, (1, "01.0.0"): old, (1, "1.0"): old, (1, "2.0.0"): ["10.0.0"]}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_dependency_advisories_meet_an_advisory_once(spark):
    """Several ranges of an advisory count once, with the percentile and mark of those that hold the version."""
    dep = spark.createDataFrame([(1, "1.5.0"), (1, "3.0.0"), (1, "9.0.0"), (2, "1.0.0")], "package_id int, version string")
    adv = [(1, 7, 0.5, None, "1.0.0", "2.0.0"), (1, 7, 0.9, "2020-01-01", "3.0.0", "4.0.0"), (1, 7, 0.5, None, "1.0.0", "1.9.0"), (1, 8, 0.2, None, None, "4.0.0"), (1, 9, None, None, "1.0.0", "2.0.0")]
    got = tables.dependency_advisories(dep, spark.createDataFrame(adv, "package_id int, advisory_id int, epss_percentile double, kev_date string, min_version string, max_version string"))
    assert sorted(map(tuple, got.collect())) == [(1, "1.5.0", 3, 0.5, False), (1, "3.0.0", 2, 0.9, True)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "advisory_id" not in plan.split("Join")[0]


def test_confusion_rules_are_hit_once(spark):
    """A thousand watchlists of one rule cost a hit a package, and lose no watchlist."""
    lists = spark.createDataFrame([(i, i, "^a-", ["x.test"] if i % 2 else None) for i in range(1000)] + [(1, 5000, None, None)], "org_id int, watchlist_id int, internal_package_pattern string, trusted_domains array<string>")
    packages = spark.createDataFrame([(1, "a-b", None), (2, "a-c", "https://x.test/q"), (3, "b", None)], "package_id int, name string, resolved_from string")
    hits, members = products.confusion_rules(packages, lists)
    assert sorted(map(tuple, hits.collect())) == [(0, 1, "a-b"), (0, 2, "a-c"), (1, 1, "a-b")]
    assert {tuple(x) for x in members.collect()} == {(i % 2, i, i) for i in range(1000)}
    assert products.confusion_hits(packages, lists).count() == 1500


def test_confusion_query_has_every_watchlist(spark, sf, folder):
    """The query's rows are packages by watchlist, also where many watchlists have a rule in common."""
    one = spark.read.parquet(f"{sf}/supplier.parquet").limit(1)
    at = folder(supplier=one.drop("s_suppkey").crossJoin(spark.range(120).withColumnRenamed("id", "s_suppkey")).select(one.columns).coalesce(1))
    got = queries.QUERIES["j3_confusion_hits"](spark, at)
    assert sorted(got.columns) == ["name", "org_id", "package_id", "watchlist_id"]
    assert compare.differences(got, compare.connect(at), queries.ORACLES["j3_confusion_hits"]) == []
    assert got.groupBy("package_id").count().filter("count >= 8").count() > 0
