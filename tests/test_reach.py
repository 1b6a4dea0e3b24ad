"""Script reachability against a queue in plain Python."""

import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import reach


def search(files, seeds, kinds, taken, budget):
    """files: {path: (content, size)}; the files read, in order."""
    queue, seen, out = list(seeds), set(), []
    while queue and len(out) + taken < budget:
        ref = re.sub(r"^['\"]|['\"]$", "", queue.pop(0)).strip()
        if not ref:
            continue
        tried = [ref] if posixpath.splitext(ref.rstrip("/"))[1] else [x for e in kinds for x in (ref + e, f"{ref}/index{e}")]
        hit = None
        for c in map(posixpath.normpath, tried):
            if not c.startswith("..") and posixpath.splitext(c)[1].lower() in kinds and c in files:
                hit = c
                break
        if hit is None or hit in seen:
            continue
        seen.add(hit)
        content, size = files[hit]
        if size > reach.MAX_BYTES:
            continue
        out.append(hit)
        found = [x for p in reach.IMPORTS for x in re.findall(p, content)]
        queue += [posixpath.dirname(hit) + "/" * bool(posixpath.dirname(hit)) + x for x in dict.fromkeys(found)]
    return out


@pytest.mark.parametrize("budget", [64, 9])
def test_reached_files(spark, budget):
    r, files, hooks, entries, want = random.Random(7), [], [], [], {}
    for p in range(4):
        names = [f"{r.choice(['', 'a/', 'a/b/', 'c/'])}{r.choice(['m', 'index', 'x.y'])}{i if i % 3 else ''}{r.choice(['.js', '.mjs', '.TS', '.txt', ''])}" for i in range(40)]
        names = list(dict.fromkeys(["z.js", *names, "lib/postinstall.js"]))
        own = {}
        for n in names:
            rel = [posixpath.relpath(x, posixpath.dirname(n) or ".") for x in r.sample(names, 3)]
            rel = [x if x.startswith(".") else f"./{x}" for x in rel]
            refs = [r.choice([x, x, posixpath.splitext(x)[0], f"./a/.././{x}", "..", f"{posixpath.dirname(x)}/"]) for x in rel]
            own[n] = (f"require ( '{refs[0]}' ); import q from \"{refs[1]}\"\nexport * from '{refs[2]}'; require('{refs[0]}')", reach.MAX_BYTES + r.choice([0, 0, 0, 0, 1]))
        files += [(p, n, *c, "x") for n, c in own.items()]
        body = "node ./z.js && node a\\\\m1.js; sh gone.sh".replace("\\\\", "\\")
        hooks += [(p, "postinstall", body), (p, "test", "node a/m2.js"), (p, "prepare", "  ")]
        entries += [(p, "main", 0, "./a"), (p, "bin", 0, names[3]), (p, "bin", 1, "'c'")]
        seeds = ["./z.js", "a/m1.js", "gone.sh", "./a", names[3], "'c'", "lib/postinstall.js"]
        want[p] = search(own, seeds, reach.EXTENSIONS["npm"], 1, budget)
    df = spark.createDataFrame(files, "package_id int, path string, content string, size long, level string").repartition(3)
    h = spark.createDataFrame(hooks, "package_id int, hook string, body string")
    e = spark.createDataFrame(entries, "package_id int, field string, pos int, value string")
    got = reach.reached_files(df, h, e, budget=budget).orderBy("package_id", "place").collect()
    assert {p: [x.path for x in got if x.package_id == p] for p in want} == want and len(got) >= 24
    assert [x.place for x in got if x.package_id == 0] == list(range(1, 1 + len(want[0])))
    assert reach.reached_files(df.limit(0), h, e).count() == 0


def test_reached_python_files(spark):
    files = [(1, "setup.py", "exec(open('tools/gen.py').read())"), (1, "tools/gen.py", "x"), (1, "src/build_ext.py", "y"), (1, "other.py", ""), (1, "tests/test_setup.py", "")]
    df = spark.createDataFrame([(*f, 10) for f in files], "package_id int, path string, content string, size long")
    got = reach.reached_files(df, None, None, "pypi").orderBy("place").collect()
    assert [(x.path, x.place) for x in got] == [("tools/gen.py", 1), ("setup.py", 2), ("src/build_ext.py", 3)]


def test_paths(spark):
    rows = [("./a/../b//c.js", "b/c.js"), ("../x", "../x"), ("a/../../x", "../x"), ("", "")]
    assert [x[0] for x in spark.createDataFrame(rows, "p string, w string").coalesce(1).select(reach.normalised(F.col("p"))).collect()] == [w for _, w in rows]
