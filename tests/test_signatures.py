"""Signatures, enrichment and wheel operators on small inputs, with nulls, empty texts and ties."""

import datetime

from pyspark.sql import functions as F

from riskloom.functions import texts
from riskloom.operators import scoring, signatures, similarity, tables


def calls(spark, *rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return {r["i"]: r["n"] for r in df.select("i", signatures.call_nodes(F.col("t")).alias("n")).collect()}


def test_call_nodes_stand_in_order_once_a_place(spark):
    got = calls(
        spark,
        "if (fork()) { call execve@plt ; SYS_mmap (syscall)\n SYS_write mov eax, 0x29 } for_each(x)",
        "call 0x40 <recv> call rax",
        "",
        None,
        "x" * 70 + "(a) do(b) mov rax, 7",
    )
    # a name that begins with a keyword ("for") isn't taken for a direct call
    assert got[0] == ["execve", "mmap", "sys_mmap", "write", "socket"]
    assert got[1] == ["recv>", "rax"]
    assert got[2] == [] and got[3] is None and got[4] == []


def test_texts_without_signatures_give_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain words"), (3, "plain words")], "k int, t string")
    for found in (
        signatures.string_hits(df, "t", ["k"]),
        signatures.call_sequences(df, "t", ["k"]),
        signatures.call_chains(df, "t", ["k"]),
        signatures.flow_anomalies(df, "t", ["k"]),
        signatures.coordinated(df, "t", ["k"]),
    ):
        assert found.count() == 0
    assert signatures.call_chains(df.limit(0), "t", ["k"]).count() == 0


def test_sequences_need_order_and_a_sensitive_path(spark):
    df = spark.createDataFrame([(1, "SYS_read SYS_open"), (2, "SYS_open SYS_read"), (3, "SYS_open SYS_read /etc/shadow"), (4, "mov eax, 0x3b; mov eax, 59")], "k int, t string")
    got = {r["k"]: (r["matched"], r["confidence"]) for r in signatures.call_sequences(df, "t", ["k"]).collect()}
    assert got == {3: ("cred_theft_shadow_read", 0.8)}


def test_every_chain_is_found_in_its_own_calls(spark):
    rows = [(c.id, " ".join(f"{s[-1]}(a);" for s in signatures.slots(c.slots)) + " " + "".join(c.context[-1:])) for c in signatures.CHAINS]
    got = {r["k"]: r["signatures"].split(",") for r in signatures.call_chains(spark.createDataFrame(rows, "k string, t string"), "t", ["k"]).collect()}
    assert all(k in got[k] for k, _ in rows)


def test_jumps_are_counted_in_whole_windows(spark):
    df = spark.createDataFrame([("a" * 511 + " " + "jmp " * 12,), ("jmp " * 12,), ("jmp " * 250,)], "t string")
    got = sorted(df.select(signatures.control_flow(F.col("t"))["max_jumps"]).toPandas().iloc[:, 0])
    assert got == [0, 12, 128]


def test_repackaging_by_the_surest_kind(spark):
    rows = [
        (1, "npm", "a", "1", "h", "i", "s"), (2, "npm", "b", "1", "h", "j", None), (3, "npm", "a", "1", "h", "i", "s"),
        (4, "npm", "c", "1", "g", "i", None), (5, "npm", "d", "1", "f", None, "s"), (6, "pypi", "e", "1", "h", "i", "s"), (7, "npm", "f", "1", None, None, None),
        (8, "npm", "g", "1", "x", "q", None), (9, "npm", "g", "2", "x", "q", None),
    ]
    df = spark.createDataFrame(rows, "artifact_id int, ecosystem string, package_name string, version string, binary_hash string, import_sig string, syscall_sig string")
    got = {r["artifact_id"]: (r["kind"], r["severity"]) for r in similarity.repackaging(df).collect()}
    assert got == {1: ("exact", "critical"), 2: ("exact", "critical"), 3: ("exact", "critical"), 4: ("import", "medium"), 5: ("syscall", "medium"), 8: ("exact", "high"), 9: ("exact", "high")}


def test_override_takes_the_greatest_fresh_percentile(spark):
    now, old = datetime.datetime(2024, 3, 1), datetime.datetime(2023, 1, 1)
    base = spark.createDataFrame([("a", 50), ("b", 50), ("c", 50)], "p string, risk_score int")
    cves = spark.createDataFrame([("a", "CVE-2", 0.95, True, None), ("a", "CVE-1", 0.95, False, now), ("a", "CVE-0", 0.99, True, old), ("b", "CVE-3", 0.1, False, now)], "p string, cve_id string, epss_percentile double, kev boolean, fetched_at timestamp")
    got = {r["p"]: r for r in scoring.epss_override(base, cves, "p", F.lit("2024-03-01 00:00:00").cast("timestamp")).collect()}
    assert (got["a"]["primary_cve"], got["a"]["risk_score"], got["a"]["finding_severity"]) == ("CVE-1", 75, "critical")
    assert got["b"]["boost_reason"].endswith("below boost threshold") and got["b"]["finding_severity"] is None
    assert got["c"]["primary_cve"] is None and got["c"]["risk_score"] == 50


def test_kev_enrichment_tells_what_changed(spark):
    day = datetime.date(2024, 1, 2)
    a = spark.createDataFrame([(1, "CVE-1", day, "active-exploitation"), (2, "CVE-2", None, None), (3, "GHSA-1", None, None)], "advisory_id int, source_id string, kev_date date, maturity string")
    k = spark.createDataFrame([("cve-1", day, "Unknown"), ("CVE-2", day, "Known"), ("CVE-9", day, None)], "cve_id string, date_added date, ransomware string")
    got = {r["advisory_id"]: (r["maturity"], r["updated"]) for r in tables.kev_enrichment(a, k).collect()}
    assert got == {1: ("active-exploitation", False), 2: ("widespread", True)}


def test_correlated_needs_both_sides(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], []), (None, ["a"])], "x array<string>, y array<string>")
    assert [tuple(r[0]) for r in df.select(similarity.correlated(F.col("x"), F.col("y"))).collect()] == [(100, True), (0, False), (None, None)]


def test_summary_counts_in_the_singular(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (2, 80, 0, 3)], "n int, r int, c int, o int")
    got = [r[0] for r in df.select(texts.audit_summary(*map(F.col, "nrco"))).collect()]
    assert got == ["1 package in graph; no risk scores recorded; 1 circular dep detected; no orphaned deps.", "2 packages in graph; CRITICAL max-transitive risk score 80/100; no circular deps; 3 orphaned deps."]


def test_chains_by_numbers_or_parts_of_names_are_found_without_a_plain_mention(spark):
    rows = [
        ("numbers", "MOV EAX, 39 ; mov rax, 0x3b ; mov eax, 29"),
        ("parts", "my_UNSHAREd(x); do_Pivot_Root2(y)"),
        ("order", "pivot_root(y) unshare(x)"),
        ("no call", "unshare and pivot_root"),
        ("none", None),
    ]
    got = {r["k"]: r["signatures"] for r in signatures.call_chains(spark.createDataFrame(rows, "k string, t string"), "t", ["k"]).collect()}
    assert got == {"numbers": "fork_exec_socket_c2", "parts": "unshare_pivot_root_escape"}
