"""Which files of a package its install scripts reach: references read out of texts, resolved to paths, followed in order.

Files are a table (package_id, path, content, size), hooks (package_id, hook, body), entries (package_id, field, pos,
value).  A search goes level by level for all packages at once.  Within a package files count in the order in which a
queue would meet them, which is: level, place of the file that refers to them, place of the reference in it.  So a level
is ranked by a window of one package's candidates, and the first of them fill what is left of its budget.  Files in the
budget are at most BUDGET a package, and only their references are followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Hooks in order, extensions in the order in which they are tried, build files, patterns, and limits.
HOOKS = ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly", "preuninstall", "postuninstall")
EXTENSIONS = {"npm": (".js", ".cjs", ".mjs", ".ts", ".jsx", ".tsx"), "pypi": (".py",)}
BUILD_FILES = ("setup.py", "setup.cfg", "pyproject.toml", "conftest.py")
FILE_REFERENCE = r"(?i)[\w.@/\\-]+\.(?:c?js|mjs|jsx?|tsx?|py|sh)\b"
IMPORTS = (r"""require\s*\(\s*['"](\.[^'"]+)['"]\s*\)""", r"""import\s[^'"]*['"](\.[^'"]+)['"]""", r"""from\s+['"](\.[^'"]+)['"]""")
INSTALL_NAME = {"npm": r"(?i)(?:(?:^|[/\\])(?:pre|post)?install[^/\\]*$|setup\.[cm]?js$|gyp[-_]?build)", "pypi": r"(?i)(?:^|[/\\])(?:install|setup|_build|build)[^/\\]*\.py$"}
BUDGET, MAX_BYTES, MAX_DEPTH, SKIPPED = 64, 512 * 1024, 5, ("node_modules", ".git", ".bin")


def normalised(path: Column) -> Column:
    """A path without empty, . and .. parts; .. that leads out stays in front."""
    last = lambda a: F.get(a, F.size(a) - 1)
    up = lambda a: F.when((F.size(a) > 0) & (last(a) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(F.lit(".."))))
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def candidates(reference: Column, extensions: tuple[str, ...]) -> Column:
    """The paths that a reference may mean, in the order in which they are tried."""
    clean = F.trim(F.regexp_replace(reference, r"""^['"]|['"]$""", ""))
    base = F.regexp_extract(clean, r"([^/]*)/*$", 1)
    named = base.rlike(r"^.+\.[^.]*$") & (base != "..")
    tried = F.flatten(F.array(*[F.array(F.concat(clean, F.lit(e)), F.concat(clean, F.lit(f"/index{e}"))) for e in extensions]))
    some = F.when(clean == "", F.array().cast("array<string>")).when(named, F.array(clean)).otherwise(tried)
    ends = "|".join(e[1:] for e in extensions)
    return F.filter(F.transform(some, normalised), lambda p: p.rlike(rf"(?i)(?:^|/)[^/]+\.(?:{ends})$") & ~p.rlike(r"^\.\."))


def relative_imports(content: Column) -> Column:
    """Relative specifiers of a source, by pattern and place, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in IMPORTS]))


def file_references(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FILE_REFERENCE), F.lit(0)), lambda r: F.replace(r, F.lit("\\"), F.lit("/"))))


def resolved(references: DataFrame, files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """references (package_id, *, reference) with the path of the first candidate that is a file; others go."""
    keys = [c for c in references.columns if c != "reference"]
    each = checkpointed(references.select(*keys, F.posexplode(candidates(F.col("reference"), extensions)).alias("try", "path")))
    met = each.join(files.select("package_id", "path").hint("merge"), ["package_id", "path"])
    return met.groupBy(*keys).agg(F.min_by("path", "try").alias("path"))


def seeds(files: DataFrame, hooks: DataFrame, entries: DataFrame, ecosystem: str) -> DataFrame:
    """package_id, at (an order: array<long>) and reference of where a search begins."""
    walk = Window.partitionBy("package_id").orderBy("path")
    parts = F.split("path", "/")
    ends = "|".join(e[1:] for e in EXTENSIONS[ecosystem])
    seen = files.filter(F.col("path").rlike(rf"(?i)(?:^|/)[^/]+\.(?:{ends})$") & (F.size(parts) <= MAX_DEPTH + 1) & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED))))
    seen = seen.select("package_id", "path").withColumn("i", F.row_number().over(walk)).filter(F.col("i") <= BUDGET).filter(F.col("path").rlike(INSTALL_NAME[ecosystem]))
    at = lambda *x: F.array(*[y.cast("long") for y in x]).alias("at")
    named = seen.select("package_id", at(F.lit(200), F.col("i"), F.lit(0)), F.col("path").alias("reference"))
    if ecosystem == "npm":
        order = F.array_position(F.array(*map(F.lit, HOOKS)), F.col("hook"))
        told = hooks.filter(F.col("hook").isin(*HOOKS) & (F.trim("body") != "")).select("package_id", order.alias("h"), F.posexplode(file_references(F.col("body"))).alias("i", "reference"))
        given = entries.select("package_id", at(F.when(F.col("field") == "main", 100).otherwise(101), F.col("pos"), F.lit(0)), F.col("value").alias("reference"))
        return told.select("package_id", at(F.col("h"), F.col("i"), F.lit(0)), "reference").unionByName(given).unionByName(named)
    order = F.array_position(F.array(*map(F.lit, BUILD_FILES)), F.col("path"))
    built = files.filter(F.col("path").isin(*BUILD_FILES) & (F.col("size") <= MAX_BYTES)).select("package_id", order.alias("h"), F.posexplode(file_references(F.col("content"))).alias("i", "reference"))
    return built.filter(F.col("reference").rlike(r"(?i)\.py$")).select("package_id", at(F.col("h"), F.col("i"), F.lit(0)), "reference").unionByName(named)


def reached_files(files: DataFrame, hooks: DataFrame, entries: DataFrame, ecosystem: str = "npm", budget: int = BUDGET) -> DataFrame:
    """package_id, path, level and place (from 0, in the order of the search) of the files that a package's install reaches.

    Hook bodies (of pypi: build files) take places of the budget before any file.  Files above MAX_BYTES can be meant
    but aren't read.
    """
    kinds = EXTENSIONS[ecosystem]
    text = files.filter(F.col("size") <= MAX_BYTES)
    if ecosystem == "npm":
        taken = hooks.filter(F.col("hook").isin(*HOOKS) & (F.trim("body") != ""))
    else:
        taken = text.filter(F.col("path").isin(*BUILD_FILES))
    taken = taken.groupBy("package_id").agg(F.count("*").alias("taken"))
    imports = text.select("package_id", F.col("path").alias("file"), F.posexplode(relative_imports(F.col("content"))).alias("pos", "r"))
    imports = imports.select("package_id", "file", "pos", F.concat(folder(F.col("file")), F.col("r")).alias("reference"))
    edges = checkpointed(resolved(imports, files, kinds).join(text.select("package_id", "path").hint("merge"), ["package_id", "path"], "left_semi"))
    start = resolved(seeds(files, hooks, entries, ecosystem), files, kinds).join(text.select("package_id", "path").hint("merge"), ["package_id", "path"], "left_semi")
    first = start.groupBy("package_id", "path").agg(F.min("at").alias("at"))
    rank = Window.partitionBy("package_id").orderBy("at", "path")
    found, left, level = None, checkpointed(first.select("package_id").distinct().join(taken, "package_id", "left").select("package_id", F.coalesce("taken", F.lit(0)).alias("taken"))), 0
    while True:
        ranked = first.join(left.hint("merge"), "package_id").withColumn("place", F.row_number().over(rank) - 1 + F.col("taken")).filter(F.col("place") < budget)
        front = checkpointed(ranked.select("package_id", "path", F.lit(level).alias("level"), F.col("place").cast("long").alias("place")))
        if front.isEmpty():
            return found if found is not None else front
        found = front if found is None else found.unionByName(front)
        left = front.groupBy("package_id").agg((F.max("place") + 1).alias("taken"))
        step = edges.join(front.select("package_id", F.col("path").alias("file"), "place").hint("merge"), ["package_id", "file"])
        step = step.groupBy("package_id", "path").agg(F.min(F.array("place", F.col("pos").cast("long"))).alias("at"))
        first, level = step.join(found.select("package_id", "path"), ["package_id", "path"], "left_anti"), level + 1
