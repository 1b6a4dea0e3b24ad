"""Sources from files that the tests write, and streaming jobs in bounded runs."""

import base64
import datetime
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import sbom, similarity
from riskloom.plans.queries import QUERIES
from riskloom.sources import feeds, files, lockfiles
from riskloom.streaming import jobs


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        if isinstance(content, bytes):
            p.write_bytes(content)
        else:
            p.write_text(content if isinstance(content, str) else json.dumps(content))
        return str(p)

    put.root = tmp_path
    return put


def test_nvd(spark, write):
    item = {"cve": {"CVE_data_meta": {"ID": "CVE-1"}, "description": {"description_data": [{"lang": "de", "value": "Hallo"}, {"lang": "en", "value": "Hello"}]}}, "impact": {"baseMetricV3": {"cvssV3": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}}, "configurations": {"nodes": [{"cpe_match": [{"cpe23Uri": "cpe:x:lodash", "versionStartIncluding": "1.0", "versionEndExcluding": "2.0"}]}]}, "lastModifiedDate": "d"}
    r = feeds.nvd11_advisories(feeds.read(spark, write("a.json", {"CVE_Items": [item]}), feeds.NVD11)).first()
    assert (r.cve_id, r.description, r.cvss_score, r.products, r.ranges[0].max) == ("CVE-1", "Hello", 9.8, ["cpe:x:lodash"], "2.0")
    vuln = {"cve": {"id": "CVE-2", "descriptions": [{"lang": "en", "value": "x" * 300}], "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 7.5}}]}, "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-Other"}]}], "references": [{"url": "u", "tags": ["Patch", "x"]}]}}
    r = feeds.nvd20_advisories(feeds.read(spark, write("b.json", {"vulnerabilities": [vuln]}), feeds.NVD20)).first()
    assert (len(r.title), r.severity, r.weaknesses, r.refs[0].tag) == (240, "high", ["CWE-79"], "Patch")


def test_osv_kev_registry_sbom(spark, write):
    osv = {"id": "MAL-1", "summary": "s", "affected": [{"package": {"name": "bad", "ecosystem": "npm"}, "versions": ["1.0", "1.0"], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}, {"package": {"name": "other", "ecosystem": "PyPI"}}]}
    d = feeds.read(spark, write("o.json", osv), feeds.OSV)
    assert [(r.package_name, r.affected_versions) for r in feeds.osv_malware(d, "npm").collect()] == [("bad", ["1.0", ">=0", "<2.0"])]
    assert {(r.package_name, r.affected_range, r.patched_version) for r in feeds.osv_affected(d).collect()} == {("bad", ">=0, <2.0", "2.0"), ("other", "", None)}
    none = feeds.read(spark, write("n.json", {"id": "MAL-2"}), feeds.OSV)
    assert feeds.osv_malware(none, "npm").first().package_name == ""
    kev = feeds.read(spark, write("k.json", {"vulnerabilities": [{"cveID": "cve-9", "dateAdded": "2024-01-02", "knownRansomwareCampaignUse": "Known"}]}), feeds.KEV)
    assert tuple(feeds.kev_catalogue(kev).first()) == ("CVE-9", datetime.date(2024, 1, 2), "widespread")
    pack = feeds.read(spark, write("p.json", {"name": "n", "time": {"created": "x", "1.0.0": "2024-01-01T00:00:00Z"}, "versions": {"1.0.0": {"dependencies": {"d": "^1"}}}}), feeds.PACKUMENT)
    assert [(r.package, r.version) for r in feeds.registry_versions(pack).collect()] == [("n", "1.0.0")]
    assert [tuple(r) for r in feeds.registry_dependencies(pack).collect()] == [("n", "1.0.0", "d", "^1")]
    bom = feeds.read(spark, write("s.json", {"components": [{"name": "x", "version": "1", "purl": "pkg:npm/%40a/x@1", "hashes": [{"alg": "MD5", "content": "0"}, {"alg": "SHA-256", "content": "AB"}]}, {"name": "y", "version": "2"}]}), feeds.CYCLONEDX)
    assert {tuple(r) for r in feeds.sbom_components(bom).collect()} == {("npm", "%40a/x", "1", "ab"), (None, "y", "2", None)}


def test_lockfiles(spark, write):
    write("a/package-lock.json", {"lockfileVersion": 3, "packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0", "dev": True}}})
    write("b/package-lock.json", {"lockfileVersion": 1, "dependencies": {"c": {"version": "3.0.0", "dependencies": {"d": {"version": "4.0.0"}}}}})
    write("c/yarn.lock", '# yarn lockfile v1\n\n"@t/e@^1.0":\n  version "1.2.3"\n\nsharp@^2:\n  version "2.1.0"\n')
    write("d/pnpm-lock.yaml", "lockfileVersion: '6.0'\npackages:\n\n  /f@1.1.1:\n    resolution: {}\n  /@u/g@2.2.2:\n    dev: true\n")
    write("e/requirements.txt", "# c\n-r x\nFlask_X==1.0\nplain\n")
    got = {(r.format, r.name, r.version, r.is_native) for r in files.lockfile_deps(files.read_texts(spark, str(write.root))).collect()}
    assert got == {("npm", "a", "1.0.0", False), ("npm", "@s/b", "2.0.0", False), ("npm", "c", "3.0.0", False), ("npm", "d", "4.0.0", False), ("yarn", "@t/e", "1.2.3", False), ("yarn", "sharp", "2.1.0", True), ("pnpm", "f", "1.1.1", False), ("pnpm", "@u/g", "2.2.2", False), ("requirements", "flask-x", "1.0", False), ("requirements", "plain", "unknown", False)}
    assert {r.name for r in files.ci_targets(files.read_texts(spark, str(write.root))).collect()} == {"a", "c", "d"}


def test_wheels_and_binaries(spark, write):
    code = b"\x7fELF\x00http://x.example.com\x00abc\x00/bin/sh"
    digest = base64.urlsafe_b64encode(hashlib.sha256(code).digest()).rstrip(b"=").decode()
    write("w/pkg-1.0.dist-info/WHEEL", "Wheel-Version: 1.0\nGenerator: g\nRoot-Is-Purelib: true\nTag: py3-none-any\nTag: cp311-abi3-win32\n")
    write("w/pkg-1.0.dist-info/METADATA", "Name: pkg\nVersion: 1.0\nRequires-Dist: Some_Dep (>=1)\n\nBody: no\n")
    write("w/pkg-1.0.dist-info/RECORD", f"pkg/a.so,sha256={digest},9\npkg/b.so,sha256={digest},9\npkg-1.0.dist-info/RECORD,,\n")
    texts = files.read_texts(spark, str(write.root / "w"))
    r = files.wheel_metadata(texts).first()
    assert (r.wheel, r.name, r.version, r.tags, r.pure, r.requires) == ("pkg-1.0", "pkg", "1.0", ["py3-none-any", "cp311-abi3-win32"], True, ["some-dep"])
    have = spark.createDataFrame([("pkg-1.0", "pkg/a.so", code)], "wheel string, file string, content binary")
    assert {(r.file, r.verified) for r in files.verify_records(files.record_entries(texts), have).collect()} == {("pkg/a.so", True), ("pkg/b.so", False), ("pkg-1.0.dist-info/RECORD", None)}
    write("bin/x.node", code)
    f = files.fingerprint(files.read_binaries(spark, str(write.root / "bin"))).first()
    assert (f.size, f.format, f.sha256, f.interesting) == (len(code), "elf", hashlib.sha256(code).hexdigest(), ["http://x.example.com", "/bin/sh"])


@pytest.mark.parametrize("part", [1000, 2])
def test_sbom_export(spark, monkeypatch, part):
    monkeypatch.setattr(sbom, "PART", part)
    p = spark.createDataFrame([(1, "npm", 'a"b', "1.0", 5, "low"), (2, "pypi", "é", "2", None, None)], "k int, ecosystem string, name string, version string, risk_score int, risk_level string")
    b = spark.createDataFrame([(1, f"b{i}", f"f{i}.so", None if i == 3 else "00", i, "low", "elf", "arm64") for i in range(5)] + [(9, "z", "z", None, 1, "low", "pe", "x86")], "k int, binary_id string, filename string, sha256 string, risk_score int, risk_level string, format string, architecture string")
    shown = spark.createDataFrame([("b1", "network", "x; y"), ("b1", "crypto", "z")], "binary_id string, behaviour string, details string")
    f = spark.createDataFrame([(1, "b1", "t", "d2", "r", "high"), (1, "b1", "t", "d1", "r", "low"), (1, "b4", "u", "d", None, "info")], "k int, binary_id string, title string, description string, recommendation string, severity string")
    parts = sbom.document_parts(p, b, shown, f, "k", "2024-01-01").orderBy("k", "part").collect()
    docs = {k: json.loads("".join(x.text for x in parts if x.k == k)) for k in (1, 2)}
    assert [x.part for x in parts if x.k == 1] == list(range(5 if part > 2 else 8)) and len({x.k for x in parts}) == 2
    assert docs[1]["metadata"]["component"]["purl"] == 'pkg:npm/a"b@1.0' and docs[2]["components"] == docs[2]["vulnerabilities"] == []
    assert [c["bom-ref"] for c in docs[1]["components"]] == [f"b{i}" for i in range(5)]
    assert [c["hashes"] for c in docs[1]["components"]][2:4] == [[{"alg": "SHA-256", "content": "00"}], []]
    assert [x["value"] for x in docs[1]["components"][1]["properties"]] == ["z", "x; y", "1", "low", "elf", "arm64"]
    assert [(v["bom-ref"], v["description"], v["ratings"][0]["severity"], v["affects"]) for v in docs[1]["vulnerabilities"]] == [("vuln-b1-0", "d1", "low", [{"ref": "b1"}]), ("vuln-b1-1", "d2", "high", [{"ref": "b1"}]), ("vuln-b4-0", "d", "info", [{"ref": "b4"}])]


def test_sbom_entries_are_dealt_by_package_once(spark):
    p = spark.createDataFrame([(1, "npm", "a", "1", 5, "low"), (None, "npm", "b", "1", 5, "low")], "k int, ecosystem string, name string, version string, risk_score int, risk_level string")
    b = spark.createDataFrame([(k, f"b{k}", "f", None, 1, "low", "elf", "arm64") for k in (None, 1, 7)], "k int, binary_id string, filename string, sha256 string, risk_score int, risk_level string, format string, architecture string")
    shown = spark.createDataFrame([("b1", "network", "x")], "binary_id string, behaviour string, details string")
    f = spark.createDataFrame([(k, f"b{k}", "t", "d", "r", "low") for k in (None, 1, 7)], "k int, binary_id string, title string, description string, recommendation string, severity string")
    parts = sbom.document_parts(p, b, shown, f, "k", "2024-01-01")
    docs = {k: json.loads("".join(x.text for x in sorted(parts.collect(), key=lambda x: x.part) if x.k == k)) for k in (None, 1)}
    assert {x.k for x in parts.collect()} == {None, 1}
    assert docs[None]["components"] == docs[None]["vulnerabilities"] == [] and len(docs[1]["components"]) == len(docs[1]["vulnerabilities"]) == 1
    # binaries, behaviours and findings by binary, and all entries by package
    plan = parts.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4, plan


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_sbom_texts_across_batches(spark, monkeypatch, rows):
    """Packages that are cut by batches, unknown ones, binaries of two packages, and digests that aren't lower-case hex."""
    monkeypatch.setattr(sbom, "PART", 2)
    r = random.Random(5)
    p = spark.createDataFrame([(f"k{k}", "npm", f"n{k}", "1", k, "low") for k in range(0, 12, 2)], "k string, ecosystem string, name string, version string, risk_score int, risk_level string")
    held = sorted({(f"k{r.randrange(12)}", f"b{r.randrange(25)}") for _ in range(60)})
    digests = ["00ff", "00FF", "0", "", None, "zz"]
    b = spark.createDataFrame([(k, x, "f", digests[int(x[1:]) % 6], 1, "low", "elf", "arm64") for k, x in held], "k string, binary_id string, filename string, sha256 string, risk_score int, risk_level string, format string, architecture string")
    shown = spark.createDataFrame([(f"b{i}", "network", f"{i}") for i in range(0, 40, 3)] + [(None, "x", "y")], "binary_id string, behaviour string, details string")
    said = [(*r.choice(held), f"t{r.randrange(3)}", f"d{r.randrange(99)}", "r", "low") for _ in range(50)]
    f = spark.createDataFrame(said, "k string, binary_id string, title string, description string, recommendation string, severity string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        parts = sbom.document_parts(p, b, shown, f, "k", "2024-01-01").collect()
        whole = dict(sbom.documents(p, b, shown, f, "k", "2024-01-01").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(whole) == {f"k{k}" for k in range(0, 12, 2)} == {x.k for x in parts} and len(whole) == 6
    for k, text in whole.items():
        mine = sorted((x.part, x.text) for x in parts if x.k == k)
        assert [n for n, _ in mine] == list(range(len(mine))) and "".join(t for _, t in mine) == text
        doc = json.loads(text)
        ids = [x for q, x in held if q == k]
        assert [c["bom-ref"] for c in doc["components"]] == sorted(ids)
        for c in doc["components"]:
            n = int(c["bom-ref"][1:])
            assert [h["content"] for h in c["hashes"]] == [d for d in [digests[n % 6]] if d is not None]
            assert [x["value"] for x in c["properties"]][:-4] == ([str(n)] if n % 3 == 0 else [])
        want = sorted((x, t, d) for q, x, t, d, *_ in said if q == k)
        assert [(v["affects"][0]["ref"], v["detail"], v["description"]) for v in doc["vulnerabilities"]] == want
        assert [v["id"] for v in doc["vulnerabilities"]] == [f"RLM-{x}-{sum(y[0] == x for y in want[:i])}" for i, (x, *_) in enumerate(want)]


def test_sbom_binaries_are_dealt_and_sorted_once(spark, sf):
    """Only the entries by package are dealt and sorted whole, and no text is."""
    plan = QUERIES["k5_sbom_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("collect_list") <= 2, plan
    assert "text#" not in plan.split("Window", 1)[1]
    assert len(re.findall(r"\bSort \[", plan)) <= 3, plan


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def events(spark, sf, tmp_path):
    from riskloom.plans.bindings import Inputs

    Inputs(spark, sf)["analytics_events"].coalesce(1).write.parquet(str(tmp_path / "events"))
    batch = spark.read.parquet(str(tmp_path / "events"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))


def test_kpi_stream_equals_batch(spark, sf, tmp_path):
    batch, stream = events(spark, sf, tmp_path)
    got = {r.start: (r.scans, r.failed) for r in run(jobs.kpi_windows(stream), "kpi", "complete")}
    done = F.col("type") == "scan_completed"
    want = batch.filter("not demo").groupBy(F.date_trunc("day", "timestamp").alias("d")).agg(F.count_if(done).alias("s"), F.count_if(F.col("type") == "scan_failed").alias("f"))
    assert got == {r.d: (r.s, r.f) for r in want.collect()}
    assert len(run(jobs.kpi_windows(stream, "7 days", "1 day"), "kpi7", "complete")) >= 30


def test_event_sink(spark, sf, tmp_path):
    batch, stream = events(spark, sf, tmp_path)
    for _ in range(2):
        jobs.event_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_table_function_equals_the_reader(spark, write):
    write("a/package-lock.json", {"lockfileVersion": 3, "packages": {"": {}, "node_modules/a": {"version": "10.0.0"}, "x/node_modules/a": {"version": "9.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0", "dev": True}, "node_modules/n": {}}})
    write("b/package-lock.json", {"lockfileVersion": 1, "dependencies": {"c": {"version": "3.0.0", "dependencies": {"d": {"version": "4.0.0", "dependencies": {"c": {"version": "1.0.0"}}}}}, "d": {"version": "5.0.0", "dev": True}}})
    write("c/yarn.lock", '# yarn lockfile v1\n\n"@t/e@^1.0":\n  version "10.2.3"\n\n"@t/e@^0.9":\n  version "9.2.3"\n\nsharp@^2:\n  version "2.1.0"\n')
    write("c/b/yarn.lock", '__metadata:\n  version: 6\n\n"x@npm:^1, x@npm:^2":\n  version: 1.5.0\n')
    write("d/pnpm-lock.yaml", "lockfileVersion: '6.0'\npackages:\n\n  /f@1.1.1:\n    resolution: {}\n  /@u/g@2.2.2:\n    dev: true\n  '@u/g@1.0.0(z@1)':\n    dev: true\n")
    write("e/requirements-dev.txt", "Flask_X==1.0 # why\n# no\n-r other.txt\nplain\nflask.x>=2\nreq[extra]~=3.1 ; python_version > '3'\n")
    write("f/unknown.json", '{"lockfileVersion": 2, "packages": {"node_modules/q": {"version": "1.0.0"}}}')
    write("g/other.txt", "nothing")
    write("h/package-lock.json", "{broken")
    texts = files.read_texts(spark, str(write.root))
    lockfiles.register(spark)
    want = {tuple(r) for r in files.lockfile_deps(texts).drop("is_native").select("path", "format", "name", "version", "dev").collect()}
    got = spark.sql("SELECT f.path, p.* FROM {files} f, LATERAL parse_lockfile(f.path, f.content) p", files=texts)
    assert {tuple(r) for r in got.collect()} == want and {r[1] for r in want} == {"npm", "yarn", "yarn-berry", "pnpm", "requirements"}
    assert {r[2:4] for r in want} >= {("a", "10.0.0"), ("d", "4.0.0"), ("@t/e", "10.2.3"), ("n", "0.0.0")} and len(want) == len({r[:3] for r in want})


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_change_feed(spark, tmp_path, rocks):
    run_ = {"install": "x"}
    rows = [(1, "sharp", "1.0", False, 10, None), (2, "gone", None, True, 10, None), (3, "node_gyp", "1.0", None, 10, run_), (4, "plain", "1.0", None, 10, {}), (5, "sharp", "0.9", None, 10, None), (6, "n0de-gyp", "1.0", None, 10, run_), (7, "ndgyp", "1.0", None, 10, run_)]
    rows += [(8, "Evil", "1.0", None, 10, run_), (9, "tools", "1.0", None, 10, run_), (10, "node-gyp-x", "1.0", None, 10, run_), (11, "node-gyp", "1.0", None, 10, run_), (12, "rare", "1.0", None, 1, run_), (3, "node_gyp", "1.0", None, 10, run_), (13, "node_gyp", "2.0", None, 10, run_)]
    schema = "seq int, name string, version string, deleted boolean, downloads int, scripts map<string,string>"
    df = spark.createDataFrame(rows, schema)
    analysed = spark.createDataFrame([("sharp", "0.9")], "name string, version string")
    one = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    index = jobs.name_index(one("node-gyp", "nodegyp", "sharp"), one("evil"), one("TOOLS"))
    want = {(1, "sharp", "1.0", "new_version", None, None), (9, "tools", "1.0", "typosquat_risk", "high", 80), (8, "Evil", "1.0", "typosquat_risk", "critical", 100), (7, "ndgyp", "1.0", "typosquat_risk", "medium", 50), (6, "n0de-gyp", "1.0", "typosquat_risk", "critical", 100)}
    want |= {(s, "node_gyp", v, "typosquat_risk", "high", 80) for s, v in ((3, "1.0"), (13, "2.0"))} | {(11, "node-gyp", "1.0", "typosquat_risk", "high", 80)}
    want |= {(s, n, v, "new_version", None, None) for s, n, v in ((3, "node_gyp", "1.0"), (6, "n0de-gyp", "1.0"), (7, "ndgyp", "1.0"), (8, "Evil", "1.0"), (9, "tools", "1.0"), (10, "node-gyp-x", "1.0"), (11, "node-gyp", "1.0"), (13, "node_gyp", "2.0"))}
    batch = jobs.change_events(df, analysed, index, 5).collect()
    assert len(batch) == len(want) and {tuple(r) for r in batch} == want
    # the same packages again, in a second batch of the stream
    for i, part in enumerate((df, df.filter("seq < 7"))):
        part.coalesce(1).write.json(str(tmp_path / "c" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "c" / "*"))
    got = run(jobs.change_feed(stream, analysed, index, 5), "feed")
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def at(minute, second=0):
    return datetime.datetime(2024, 1, 1, 0, minute, second)


def test_retry_state_stream_equals_batch(spark, tmp_path, rocks):
    rows = [(1, at(0), False), (1, at(1), False), (1, at(2), True), (2, at(0), False)] + [(3, at(i), False) for i in range(5)]
    df = spark.createDataFrame(rows, "scan_id long, at timestamp, ok boolean")
    batch = {r.scan_id: (r.failures, r.state, r.next_retry) for r in jobs.retry_state(df).collect()}
    assert batch == {1: (2, "resolved", None), 2: (1, "retrying", at(0, 1)), 3: (5, "abandoned", at(4) + datetime.timedelta(days=30))}
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    got = run(jobs.retry_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))), "retry")
    last = {}
    for r in sorted(got, key=lambda r: (r["at"], r.failures)):
        last[r.scan_id] = (r.failures, r.state, r.next_retry)
    assert last == batch and len(got) == len(rows)
    assert {r.audit for r in got} == {"retry_scheduled", "retry_succeeded", "retry_abandoned"}


def test_retry_state_expires(spark, tmp_path, rocks):
    """The clock is moved on by events of other scans."""
    day = datetime.timedelta(days=1)
    steps = [[(3, at(i), False) for i in range(5)], [(9, at(0) + 20 * day, True)], [(9, at(0) + 31 * day, True)], [(9, at(0) + 32 * day, True)], [(3, at(0) + 33 * day, False)]]
    schema = "scan_id long, at timestamp, ok boolean"
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "r" / f"s{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r" / "*"))
    got = [(r.state, r.failures) for r in sorted(run(jobs.retry_stream(stream), "expiry"), key=lambda r: r["at"]) if r.scan_id == 3]
    assert got == [("retrying", i) for i in (1, 2, 3, 4)] + [("abandoned", 5), ("expired", 5), ("retrying", 1)]


def test_alert_batches_send_once(spark, tmp_path):
    watch = spark.createDataFrame([(1, 5, "email", "me")], "watchlist_id int, org_id int, channel string, destination string")
    entries = spark.createDataFrame([(1, 7, None)], "watchlist_id int, package_id int, version string")
    deps = spark.createDataFrame([(6, 1, 7)], "org_id int, lockfile_scan_id int, package_id int")
    channels = spark.createDataFrame([(6, "slack", "us", True, "high"), (6, "email", "no", True, "critical")], "org_id int, channel string, destination string, enabled boolean, min_risk_level string")
    step = jobs.alert_batches(watch, entries, deps, channels, str(tmp_path / "ledger"))
    batch = spark.createDataFrame([(7, "1.0", 70), (8, "1.0", 10)], "package_id int, version string, risk_score int")
    for n in (0, 0, 1):
        step(batch, n)
    got = [(r.org_id, r.destination) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()]
    assert sorted(got) == [(5, "me"), (6, "us")]


def test_snapshot_batches(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, w int"
    step = jobs.snapshot_batches(path, ["k"], compact_every=3)
    assert jobs.snapshot(spark, path, ["k"]) is None
    state, batches = {}, [[(k, "a", 0) for k in range(50)], [(1, "b", 1), (99, "c", None)], [(1, "b", 1), (2, None, 2)], [(3, "d", 1)], [(3, "e", 2), (3, "e", 1)]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # each batch is run twice, as after a crash
            step(spark.createDataFrame(rows, schema), n)
        for k, v, w in rows:
            state[k] = (v, w) if n < 4 else ("e", 2)
        assert {r.k: (r.v, r.w) for r in jobs.snapshot(spark, path, ["k"]).collect()} == state
    log = lambda n: {tuple(r) for r in spark.read.parquet(f"{path}/log/{n}").collect()}
    assert log(1) == {(1, "b", 1, "updated"), (99, "c", None, "inserted")} and log(2) == {(2, None, 2, "updated")}
    # a batch without its marker isn't read
    spark.createDataFrame([(7, "x", 1, "updated")], schema + ", change string").write.parquet(f"{path}/log/5")
    assert {r.k: (r.v, r.w) for r in jobs.snapshot(spark, path, ["k"]).collect()} == state
    assert {r.k: r.v for r in jobs.snapshot(spark, path, ["k"], 0).collect()} == dict.fromkeys(range(50), "a")


def test_stuck_jobs(spark, tmp_path):
    spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(0)), (4, at(59))], "job_id int, submitted_at timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(1, at(0, 5), "done"), (3, at(0, 9), "failed"), (9, at(59), "done")], "job_id int, completed_at timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema("job_id int, submitted_at timestamp").parquet(str(tmp_path / "s"))
    c = spark.readStream.schema("job_id int, completed_at timestamp, status string").parquet(str(tmp_path / "c"))
    got = {(r.job_id, r.reason) for r in run(jobs.stuck_jobs(s, c), "stuck")}
    assert (3, "failed") in got and (2, "stuck") in got and (1, "stuck") not in got
