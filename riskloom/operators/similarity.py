"""Artifacts: near-copies by byte bigrams, version differences, provenance checks, SARIF and SBOM tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..functions import scalars as S


@F.pandas_udf(BinaryType())
def bigram_set(data: pd.Series) -> pd.Series:
    """The distinct pairs of neighbouring bytes of each value in order, two bytes a pair; empty for less than two bytes."""
    met = np.zeros(1 << 16, bool)

    def pairs(d: bytes | None) -> bytes:
        if d is None or len(d) < 2:
            return b""
        b = np.frombuffer(d, np.uint8).astype(np.uint16)
        met[b[:-1] << 8 | b[1:]] = True
        found = np.flatnonzero(met)
        met[found] = False
        return found.astype(">u2").tobytes()

    return data.map(pairs, na_action=None).astype(object)


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of pairs in both of two sets of bigram_set(); null where a set is."""

    def count(x: bytes | None, y: bytes | None) -> int | None:
        if x is None or y is None:
            return None
        return len(np.intersect1d(np.frombuffer(x, ">u2"), np.frombuffer(y, ">u2"), assume_unique=True))

    return pd.Series([count(x, y) for x, y in zip(a, b)], dtype="Int64")


def with_bigrams(df: DataFrame, data: str, name: str = "grams") -> DataFrame:
    """With the distinct pairs of neighbouring bytes of a binary column, as sorted hexadecimal digits."""
    out = df.withColumn(name, bigram_set(F.col(data)))
    n = F.length(name)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(2)), lambda i: F.hex(F.substring(F.col(name), i, F.lit(2))))
    return out.withColumn(name, F.when(n > 0, pairs).otherwise(F.array().cast("array<string>")))


def version_diff(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Risk delta and number of behaviours added between two versions of a package (package_id, v, behaviour, risk_score)."""
    at = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    seen = lambda v: F.collect_set(F.when(F.col("v") == v, F.col("behaviour")))
    out = rows.filter(F.col("v").isin(before, after)).groupBy("package_id").agg(at(after, "risk_score").alias("t"), at(before, "risk_score").alias("f"), F.size(F.array_except(seen(after), seen(before))).alias("n_added"))
    return out.filter("t is not null and f is not null and n_added > 0").select("package_id", (F.col("t") - F.col("f")).alias("risk_delta"), "n_added")


def provenance(components: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """status and severity by the first rule that fails: host, presence, yanked, digest."""
    x = components.join(registry.withColumn("__there", F.lit(True)), key, "left")
    missing = F.col("__there").isNull()
    status = F.when(~F.col("canonical") | missing, "unresolved").when(F.col("yanked"), "yanked").when(F.col("declared") != F.col("actual"), "mismatch").otherwise("ok")
    return x.withColumn("status", status).withColumn("severity", F.when(F.col("status") == "unresolved", "medium").when(F.col("status") == "ok", "none").otherwise("high")).drop("__there")


def commit_gap(uploaded: Column, committed: Column) -> Column:
    """before: uploaded over five minutes ahead of the commit; late: over seven days after it."""
    return F.when(uploaded < committed - F.expr("INTERVAL 300 SECONDS"), "before").when(uploaded > committed + F.expr("INTERVAL 7 DAYS"), "late").otherwise("ok")


def publisher_identity(releases: DataFrame, maintainers: DataFrame, key: str) -> DataFrame:
    """verdict: whether the uploader is a maintainer; null without an uploader or maintainers."""
    m = maintainers.select(key, F.lower(F.trim("maintainer")).alias("__m")).distinct()
    some = m.select(key).distinct().withColumn("__some", F.lit(True))
    x = releases.withColumn("__u", F.lower(F.trim("uploader"))).join(some, key, "left")
    x = x.join(m.withColumnRenamed("__m", "__u").withColumn("__hit", F.lit(True)), [key, "__u"], "left")
    return x.withColumn("verdict", F.when(F.col("uploader").isNull() | F.col("__some").isNull(), None).otherwise(F.coalesce("__hit", F.lit(False)))).drop("__u", "__some", "__hit")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id (the title's slug), title, level and number of results of each rule and level."""
    slug = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    per = findings.select(slug.alias("rule_id"), "title", level.alias("level")).groupBy("rule_id", "title", "level").agg(F.count("*").alias("n"))
    total = per.groupBy("rule_id").agg(F.sum("n").alias("results"))
    return per.drop("n").join(total, "rule_id")


# --- wheels and source archives ---------------------------------------------------


def extra_binaries(files: DataFrame, modules: DataFrame, key: str) -> DataFrame:
    """Native files of wheels (key, path) whose stem no declared module (key, name) has as its name or its last part."""
    stem = F.get(F.split(F.regexp_extract("path", r"([^/]*)$", 1), r"\."), F.lit(0))
    last = F.get(F.reverse(F.split("name", r"\.")), F.lit(0))
    known = modules.select(key, F.col("name").alias("__s")).unionByName(modules.select(key, last.alias("__s"))).distinct()
    return files.filter(is_native_file(F.col("path"))).withColumn("__s", stem).join(known.hint("merge"), [key, "__s"], "left_anti").drop("__s")


def is_native_file(path: Column) -> Column:
    """Whether a wheel's file ends in, or has before a further dot, one of .so, .pyd and .dylib."""
    return F.lower(path).rlike(r"\.(?:so|pyd|dylib)(?:\.|$)")


def pure_python_claims(wheels: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Wheels (key, filename) with claimed_pure by their tags, the number of native files and whether the claim is false."""
    pure = F.col("filename").rlike(r"(?i)^.+-(?:py2\.py3|py[23]\d*)-none-any\.whl$")
    native = files.filter(is_native_file(F.col("path"))).groupBy(key).agg(F.count("*").alias("n_native"))
    out = wheels.withColumn("claimed_pure", pure).join(native, key, "left").withColumn("n_native", F.coalesce("n_native", F.lit(0).cast("long")))
    return out.withColumn("suspected", F.col("claimed_pure") & (F.col("n_native") > 0))


#: Directories of build artefacts in source archives.
ARTEFACT_DIRS = "build dist _build _dist .libs .eggs lib libs _vendor vendor prebuilt prebuilt_binaries wheels bin".split()


def archive_binaries(files: DataFrame) -> DataFrame:
    """Native files of source archives: in_artefacts, abi_tagged, and severity medium where only the first holds."""
    name = F.lower("path")
    native = files.filter(name.rlike(r"\.(?:so|pyd|dll|dylib)$"))
    inside = F.arrays_overlap(F.split(name, "/"), F.array(*[F.lit(d) for d in ARTEFACT_DIRS]))
    tagged = F.col("path").rlike(r"(?i)\.cpython-\d+[^.]*\.so$|\.pypy\d+-[^.]+\.so$") | F.col("path").endswith(".pyd")
    out = native.withColumn("in_artefacts", inside).withColumn("abi_tagged", tagged)
    return out.withColumn("severity", F.when(F.col("in_artefacts") & ~F.col("abi_tagged"), "medium"))


def repackaging(registry: DataFrame) -> DataFrame:
    """Per artifact the surest kind of copy in other packages' artifacts of its ecosystem, and its severity.

    exact: the same binary_hash in another package or version; import and syscall: the same signature in another package.
    An exact copy is critical if it stands with a different import signature, else high; the others are medium.  Groups
    are only counted, so one that holds any share of the rows costs its rows.
    """
    pv = F.struct("package_name", "version")
    own = registry.withColumn("__pv", F.xxhash64("package_name", "version"))

    def others(value: str, what: Column, name: str) -> DataFrame:
        return registry.filter(F.col(value).isNotNull()).groupBy("ecosystem", value).agg(F.count_distinct(what).alias(name))

    signed = registry.filter("binary_hash is not null and import_sig is not null").select("ecosystem", "binary_hash", "import_sig", "package_name", "version").distinct()
    h = ["ecosystem", "binary_hash"]
    total = signed.groupBy(*h).agg(F.count("*").alias("__t"))
    alike = signed.groupBy(*h, "import_sig").agg(F.count("*").alias("__s"))
    mine = signed.groupBy(*h, "package_name", "version").agg(F.count("*").alias("__o"))
    x = own.join(others("binary_hash", pv, "__e"), h, "left").join(others("import_sig", F.col("package_name"), "__i"), ["ecosystem", "import_sig"], "left")
    x = x.join(others("syscall_sig", F.col("package_name"), "__y"), ["ecosystem", "syscall_sig"], "left")
    x = x.join(total, h, "left").join(alike, [*h, "import_sig"], "left").join(mine, [*h, "package_name", "version"], "left")
    differs = F.coalesce(F.col("__t") - F.col("__s") - F.col("__o") + 1 > 0, F.lit(False))
    kind = F.when(F.col("__e") > 1, "exact").when(F.col("__i") > 1, "import").when(F.col("__y") > 1, "syscall")
    severity = F.when(kind.isNull(), None).when(kind != "exact", "medium").when(differs, "critical").otherwise("high")
    return x.select("artifact_id", kind.alias("kind"), severity.alias("severity")).filter("kind is not null")


def _score(current: Column, published: Column, common: Column, size, least: int) -> Column:
    union = size(current) + size(published) - common
    score = F.when(current.isNull() | published.isNull(), None).when((size(current) == 0) | (size(published) == 0), F.lit(0)).otherwise(S.js_round(common * 100.0 / union).cast("int"))
    return F.struct(score.alias("similarity"), (score >= least).alias("correlated"))


def correlated(current: Column, published: Column, least: int = 70) -> Column:
    """struct<similarity, correlated> of two arrays of distinct bigrams; nulls where a side is missing."""
    return _score(current, published, F.size(F.array_intersect(current, published)), F.size, least)


def correlated_sets(pairs: DataFrame, current: str, published: str, least: int = 70) -> DataFrame:
    """With similarity and correlated of two columns of bigram_set(); nulls where a side is missing."""
    size = lambda c: (F.length(c) / 2).cast("long")
    counted = pairs.withColumn("__common", _common(F.col(current), F.col(published)))
    out = counted.withColumn("__c", _score(F.col(current), F.col(published), F.col("__common"), size, least))
    return out.select(*pairs.columns, "__c.*")


def wheel_fresh(built: Column, uploaded: Column) -> Column:
    """False if built over five minutes after, or over thirty days before, the upload; null without either time."""
    gap = F.unix_timestamp(uploaded) - F.unix_timestamp(built)
    return (gap >= -300) & (gap <= 30 * 86400)
