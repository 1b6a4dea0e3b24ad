"""Findings and scores of package manifests: rule hits, install hooks, shadowed commands, look-alike names, native wheels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import names, rules, scoring

#: Commands that a package's executables shouldn't replace, and what findings are called and where they stand.
SHADOWABLE = """npm npx node yarn pnpm git sh bash zsh sudo python python3 pip pip3 curl wget ssh scp docker kubectl make cc gcc clang
env ls cat cp mv rm go cargo ruby perl java""".split()
HOOK, SHADOW, EXTENSION, SQUAT = "Package runs install-time scripts", "Package binary shadows a system command", "Wheel contains compiled Python native extensions", "Possible typosquat of `"
DETAILS = 8


def finding(category: str, severity: str, title: Column | str, file: Column | str) -> list[Column]:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.lit(category).alias("category"), F.lit(severity).alias("severity"), as_column(title).alias("title"), as_column(file).alias("file")]


def manifest_findings(hits: DataFrame, packages: DataFrame, hooks: DataFrame, commands: DataFrame, extensions: DataFrame, setups: DataFrame, popular: DataFrame, trusted: DataFrame) -> DataFrame:
    """package_id, category, severity, title and file of every finding of a package, each once.

    hits: rule hits (package_id, category, severity, title, file); packages: package_id, ecosystem, name; hooks:
    package_id, hook, body; commands: package_id, command (of npm's bin); extensions: package_id, path; setups:
    package_id of packages with a setup.py; popular: name, ord; trusted: package_id, whose install hooks count as info.
    """
    npm, pypi = (packages.filter(F.col("ecosystem") == e) for e in ("npm", "pypi"))
    runs = hooks.filter(F.col("hook").isin(S.AUTO_RUN) & (F.col("body") != "")).select("package_id").distinct()
    found = [hits.select("package_id", "category", "severity", "title", "file")]
    found += [npm.join(runs, "package_id", "left_semi").select("package_id", *finding("installHook", "low", HOOK, "package.json#scripts"))]
    found += [pypi.join(setups.select("package_id").distinct(), "package_id", "left_semi").select("package_id", *finding("installHook", "low", HOOK, "setup.py"))]
    native = extensions.filter(S.is_python_extension(F.col("path"))).groupBy("package_id").agg(F.min("path").alias("path"))
    found += [pypi.join(native, "package_id").select("package_id", *finding("pythonBinaryExtension", "medium", EXTENSION, F.col("path")))]
    shadow = commands.filter(F.lower("command").isin(SHADOWABLE)).select("package_id").distinct()
    found += [npm.join(shadow, "package_id", "left_semi").select("package_id", *finding("dependencyConfusion", "high", SHADOW, "package.json#bin"))]
    squats = names.typosquats(npm.select("name"), popular).select(F.col("candidate").alias("name"), "target")
    title = F.concat(F.lit(SQUAT), F.col("target"), F.lit("`"))
    found += [npm.join(squats.hint("merge"), "name").select("package_id", *finding("dependencyConfusion", "high", title, "package.json#name"))]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    # of equal keys the graver one stays
    one = every.groupBy("package_id", "category", "file", "title").agg(F.max(S.rank_of(F.col("severity"), S.SEVERITIES)).alias("rank"))
    return rules.demote_trusted(one.select("package_id", "category", S.level_of(F.col("rank"), S.SEVERITIES).alias("severity"), "title", "file"), trusted, "package_id")


def manifest_scores(packages: DataFrame, findings: DataFrame, context: DataFrame, malware: DataFrame) -> DataFrame:
    """package_id, n_findings, score and risk_level of every package; 100 where it is known malware (package_id).

    context: package_id, percentile, kev, maturity, patch_confidence, days, adoption, one row a package at most.  A
    category's threat has its own points and one for each of up to three of its details, which are its findings, DETAILS
    at most.
    """
    own = scoring.finding_scores(findings, "package_id").withColumnRenamed("score", "points")
    each = findings.groupBy("package_id", "category").agg(F.least(F.count("*"), F.lit(DETAILS)).alias("n"))
    threat = F.when(F.col("category").isin(*scoring.THREAT_POINTS), scoring.signal_points(F.col("category"), F.lit(True), F.col("n"), scoring.THREAT_POINTS)).otherwise(0)
    threats = each.groupBy("package_id").agg(F.sum(threat).alias("threats"))
    x = packages.select("package_id").distinct().join(own, "package_id", "left").join(threats, "package_id", "left").join(context, "package_id", "left")
    x = x.join(malware.select("package_id", F.lit(True).alias("bad")).distinct(), "package_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero(F.col("points")) + zero(F.col("threats")) + zero(S.epss_boost(F.col("percentile"), "a")) + zero(S.kev_boost(F.col("kev"), F.col("maturity"))) + S.patch_penalty(F.col("patch_confidence")) + zero(S.deployment_modifier(F.col("days"), F.col("adoption")))
    score = F.when(F.coalesce("bad", F.lit(False)), 100).otherwise(S.normalize_risk(total.cast("double")))
    return x.select("package_id", zero(F.col("n_findings")).alias("n_findings"), score.alias("score")).withColumn("risk_level", S.risk_level(F.col("score")))
