"""Risk scores: weights of findings and threats, roll-ups, vulnerability adjustments, compliance, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import first_by

#: Points of severities, behaviours and script threats.
SEVERITY_POINTS = {"info": 2, "low": 8, "medium": 18, "high": 30, "critical": 45}
BEHAVIOUR_POINTS = {"network": 14, "filesystem": 4, "process": 12, "crypto": 3, "obfuscation": 24, "dataExfiltration": 28}
THREAT_POINTS = {"installHook": 6, "scriptInjection": 24, "environmentTheft": 34, "dependencyConfusion": 20, "wiper": 40, "reverseShell": 40, "remoteCodeExecution": 38}


def points(key: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(key == name, n).otherwise(out)
    return out


def signal_points(key: Column, detected: Column, n_details: Column, table: dict[str, int]) -> Column:
    """Points of a detected signal: its own, and one for each of up to three details."""
    return F.when(detected, points(key, table) + F.least(n_details, F.lit(3))).otherwise(0)


def finding_scores(findings: DataFrame, key: str) -> DataFrame:
    """key, score and n_findings: the sum of the findings' severity points."""
    return findings.groupBy(key).agg(F.sum(points(F.col("severity"), SEVERITY_POINTS)).alias("score"), F.count("*").alias("n_findings"))


def binary_scores(artifacts: DataFrame) -> DataFrame:
    """risk_score and risk_level from finding_score, behaviour_score, n_imports, n_functions, percentile, kev, maturity, correlated and patch_confidence."""
    total = (
        F.col("finding_score")
        + F.col("behaviour_score")
        + F.least(F.col("n_imports") / 4, F.lit(6))
        + F.least(F.col("n_functions") / 20, F.lit(5))
        + S.epss_boost(F.col("percentile"), "a")
        + S.kev_boost(F.col("kev"), F.col("maturity"))
        + F.when(F.col("correlated"), 10).otherwise(0)
        + S.patch_penalty(F.col("patch_confidence"))
    )
    out = artifacts.withColumn("risk_score", S.normalize_risk(total))
    return out.withColumn("risk_level", S.risk_level(F.col("risk_score")))


def package_rollup(analyses: DataFrame, key: str, manifest: str | None = None, malware: str | None = None) -> DataFrame:
    """0.65 of the greatest and 0.35 of the mean score of a package; a manifest's score if greater; 100 for malware."""
    base = S.js_round(F.max("risk_score") * 0.65 + F.avg("risk_score") * 0.35)
    if manifest:
        base = F.greatest(base, F.coalesce(F.max(manifest), F.lit(0)))
    if malware:
        base = F.when(F.coalesce(F.bool_or(malware), F.lit(False)), 100).otherwise(base)
    out = analyses.groupBy(key).agg(F.coalesce(base, F.lit(0)).cast("int").alias("risk_score"), F.count("*").alias("n"))
    return out.withColumn("risk_level", S.risk_level(F.col("risk_score")))


def vulnerability_adjustment(vulns: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Per key over fresh vulnerabilities: adjustment, force_critical, n_exploited, unfixed and highest percentile."""
    fresh = vulns.filter(S.is_fresh(F.col("feed_updated_at"), as_of))
    force = F.col("is_kev") & F.col("maturity").isin("active-exploitation", "widespread")
    unfixed = F.col("patched_version").isNull() | F.col("unmerged")
    boost = S.epss_boost(F.col("epss_percentile"), "b") + S.kev_boost(F.col("is_kev"), F.col("maturity")) + S.fix_boost(F.col("patched_version"), F.col("unmerged"))
    return fresh.groupBy(key).agg(
        F.sum(boost).alias("adjustment"),
        F.bool_or(force).alias("force_critical"),
        F.count_if(force).alias("n_exploited"),
        F.count_if(unfixed).alias("unfixed"),
        F.max("epss_percentile").alias("highest_percentile"),
    )


def epss_override(packages: DataFrame, cves: DataFrame, key: str, as_of: Column, deployment: DataFrame | None = None) -> DataFrame:
    """Package scores raised by the fresh CVE of greatest percentile, its KEV mark and how far its patch is adopted.

    packages: key, risk_score; cves: key, cve_id, epss_percentile, kev, fetched_at (null: fresh); deployment: key, days,
    adoption.  Adds primary_cve, epss_points, kev_points, boost_reason, finding_severity (null without a boost); of equal
    percentiles the least cve_id counts.
    """
    fresh = cves.filter(F.col("fetched_at").isNull() | S.is_fresh(F.col("fetched_at"), as_of))
    best = first_by(fresh, [key], F.desc("epss_percentile"), "cve_id", F.desc("kev")).select(key, F.col("cve_id").alias("primary_cve"), F.col("epss_percentile").alias("__p"), F.col("kev").alias("__k"))
    x = packages.join(best, key, "left")
    x = x.join(deployment.select(key, "days", "adoption"), key, "left") if deployment is not None else x.withColumns({"days": F.lit(None).cast("int"), "adoption": F.lit(None).cast("double")})
    epss, kev = S.epss_boost(F.col("__p"), "b"), F.when(F.col("__k"), 20).otherwise(0)
    x = x.withColumns({"epss_points": epss, "kev_points": kev})
    boost = F.col("epss_points") + F.col("kev_points")
    score = S.normalize_risk(F.col("risk_score") + boost + S.deployment_modifier(F.col("days"), F.col("adoption")))
    label = F.concat(F.lit("EPSS "), S.js_round(F.col("__p") * 100).cast("int").cast("string"), F.lit("th percentile ("), "primary_cve", F.lit(")"))
    parts = F.array_compact(F.array(F.when(F.col("epss_points") > 0, label), F.when(F.col("kev_points") > 0, "CISA KEV active-exploitation")))
    reason = F.when(F.size(parts) > 0, F.array_join(parts, " + ")).otherwise(F.concat(label, F.lit(" \u2014 below boost threshold")))
    out = x.withColumns({"risk_score": score, "boost_reason": reason, "finding_severity": F.when(boost >= 20, "critical").when(boost >= 10, "high").when(boost > 0, "medium")})
    return out.withColumn("risk_level", S.risk_level(F.col("risk_score"))).drop("__p", "__k", "days", "adoption")


def correlation_score(cves: DataFrame, detectors: DataFrame, key: str) -> DataFrame:
    """CVE score with exploit probability, KEV and mean confidence of the detectors that fired.

    Confidences are read to nine places and added up as decimals, so a mean that is a step exactly reaches it in any order.
    """
    total = F.sum(F.col("confidence").cast("decimal(20,9)"))
    means = detectors.filter("detected").groupBy(key).agg(total.alias("total"), F.count("confidence").alias("said"), F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("analyzers"))
    joined = cves.join(means, key, "left")
    tenths = F.col("total") * 10
    boost = F.when(tenths >= F.col("said") * 8, 15).when(tenths >= F.col("said") * 5, 10).when(tenths >= F.col("said") * 2, 5).otherwise(0)
    score = S.normalize_risk(S.cvss_floor(F.col("cvss_score")) + S.epss_boost(F.col("epss_percentile"), "c") + S.kev_flat(F.col("is_kev"), 15) + boost)
    return joined.withColumn("score", score).withColumn("severity", S.risk_level(F.col("score"))).drop("total", "said")


def composite_exploit_risk(vulns: DataFrame, key: str) -> DataFrame:
    """Sum of a key's three greatest risks (CVSS tenths times percentile, or the CVSS score where that is unknown), 100 at most."""
    risk = F.when(F.col("epss_percentile").isNull(), F.col("cvss_score")).otherwise(F.col("cvss_score") / 10 * F.col("epss_percentile") * 100)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("risk"), "advisory_id"))
    top = vulns.withColumn("risk", risk).withColumn("i", rank)
    none = F.count("epss_percentile") == 0
    summed = S.js_round(F.round(F.sum(F.when(F.col("i") <= 3, F.col("risk"))), 6))
    return top.groupBy(key).agg(F.least(F.lit(100), F.when(none, S.js_round(F.max("cvss_score") * 10)).otherwise(summed)).cast("int").alias("composite"), F.count("*").alias("n"))


def enrichment_rollup(findings: DataFrame, key: str) -> DataFrame:
    """Greatest percentile and score, KEV matches, maturity counts and the boosts of each key."""
    kind = lambda m: F.count_if(F.col("maturity") == m)
    out = findings.groupBy(key).agg(
        F.coalesce(F.max("epss_percentile"), F.lit(0.0)).alias("max_percentile"),
        F.coalesce(F.max("cvss_score"), F.lit(0.0)).alias("max_cvss"),
        F.count_distinct(F.when(F.col("kev_date").isNotNull(), F.col("source_id"))).alias("kev_matches"),
        kind("proof-of-concept").alias("proof_of_concept"),
        kind("active-exploitation").alias("active_exploitation"),
        kind("widespread").alias("widespread"),
    )
    base, epss = S.js_round(F.col("max_cvss") / 10 * 100), S.epss_boost(F.col("max_percentile"), "e")
    kev = F.when(F.col("kev_matches") > 0, 30).otherwise(0)
    return out.withColumn("final_score", F.least(F.lit(100), base + epss + kev).cast("int"))


def compliance(analyses: DataFrame, findings: DataFrame, scope: str) -> DataFrame:
    """Per scope: packages, levels, findings by severity, mean and greatest risk, and the compliance score."""
    level = S.risk_level(F.col("risk_score"))
    per = analyses.withColumn("risk_level", level).groupBy(scope).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("risk_level") == n).alias(f"n_{n}") for n in S.LEVELS], S.js_round(F.avg("risk_score")).cast("int").alias("average_risk"), F.max("risk_score").alias("max_risk")
    )
    sev = findings.join(analyses.select("analysis_id", scope), "analysis_id").groupBy(scope).agg(*[F.count_if(F.col("severity") == n).alias(f"{n}_findings") for n in S.SEVERITIES])
    out = per.join(sev, scope, "left").na.fill(0, [f"{n}_findings" for n in S.SEVERITIES])
    lost = S.js_round((F.col("critical_findings") * 20 + F.col("high_findings") * 10 + F.col("medium_findings") * 3 + F.col("low_findings")) / F.greatest(F.lit(1), F.col("total")))
    return out.withColumn("compliance_score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("int"))


def detector_summary(detections: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Per key over detectors that fired with enough confidence: any, greatest confidence, their signals."""
    hit = F.col("detected") & (F.col("confidence") >= threshold)
    return detections.groupBy(key).agg(F.bool_or(hit).alias("any_detected"), F.coalesce(F.max(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("max_confidence"), F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("detector")))), ",").alias("signals"))


#: Confidence of each threat, and the attack profiles as their signals.
SIGNAL_CONFIDENCE = {"reverseShell": 0.95, "wiper": 0.95, "remoteCodeExecution": 0.90, "environmentTheft": 0.85, "scriptInjection": 0.80, "dependencyConfusion": 0.80, "installHook": 0.50, "obfuscation": 0.70, "knownMalware": 0.99}
PROFILES = {
    "env-exfil": ("environmentTheft", "remoteCodeExecution"),
    "reverse-shell-with-wiper": ("reverseShell", "wiper"),
    "dependency-confusion-cascade": ("dependencyConfusion", "scriptInjection"),
    "c2-beacon-setup": ("installHook", "remoteCodeExecution"),
    "persistence-chain": ("scriptInjection", "reverseShell"),
    "wiper-only-attack": ("wiper", "remoteCodeExecution"),
    "full-exfil-chain": ("environmentTheft", "scriptInjection", "remoteCodeExecution"),
    "env-exfil-with-persistence": ("environmentTheft", "scriptInjection"),
    "reverse-shell-env-harvest": ("reverseShell", "environmentTheft"),
    "rce-dependency-confusion": ("dependencyConfusion", "remoteCodeExecution"),
    "hook-exfil-wiper": ("installHook", "environmentTheft", "wiper"),
    "rce-reverse-shell-chain": ("remoteCodeExecution", "reverseShell"),
}


def profile_table(spark, profiles: dict[str, tuple[str, ...]] = PROFILES, confidence: dict[str, float] = SIGNAL_CONFIDENCE) -> DataFrame:
    rows = [(p, s, confidence[s], len(ss)) for p, ss in profiles.items() for s in ss]
    return spark.createDataFrame(rows, "profile string, signal string, confidence double, n_signals int")


def attack_profiles(signals: DataFrame, profiles: DataFrame, key: str, floor: float = 0.75) -> DataFrame:
    """Profiles of which a key shows two signals at least, with mean confidence times coverage not below the floor."""
    hit = signals.select(key, "signal").distinct().join(F.broadcast(profiles), "signal")
    out = hit.groupBy(key, "profile").agg(F.count("*").alias("matched"), F.round(F.avg("confidence") * F.count("*") / F.max("n_signals"), 4).alias("confidence"))
    return out.filter((F.col("matched") >= 2) & (F.col("confidence") >= floor)).withColumn("severity", F.when(F.col("confidence") >= 0.85, "critical").otherwise("high"))


def weighted_confidence(tools: DataFrame, key: str) -> DataFrame:
    """Mean confidence of the tools that said something, weighted; to two places."""
    said = F.col("confidence") > 0
    return tools.groupBy(key).agg(F.round(F.coalesce(F.sum(F.when(said, F.col("confidence") * F.col("weight"))) / F.sum(F.when(said, F.col("weight"))), F.lit(0.0)), 2).alias("confidence"))


def ci_gate(findings: DataFrame, key: str, threshold: str) -> DataFrame:
    """Highest level of a run, counts, and whether it fails at the threshold; never fails at `never`."""
    rank = S.rank_of(F.col("risk_level"))
    least = S.LEVELS.index(threshold) if threshold in S.LEVELS else 99
    out = findings.groupBy(key).agg(F.max(rank).alias("rank"), F.count("*").alias("total"), F.count_if(rank >= least).alias("over"))
    return out.select(key, S.level_of(F.col("rank")).alias("highest"), "total", "over", (F.col("rank") >= least).alias("failed"))


#: Weights and thresholds of the health signals (least severe last); whether less is worse.
HEALTH = {
    "commit_velocity_90d": (20, (0, 2, 10, 20), True),
    "release_cadence_days": (15, (730, 365, 180, 90), False),
    "contributor_turnover": (15, (1.0, 0.8, 0.5, 0.3), False),
    "dependency_age_percentile": (15, (95, 85, 70, 60), False),
    "circular_dep_count": (10, (5, 3, 1, 0), False),
    "orphaned_dep_count": (10, (10, 5, 2, 1), False),
    "license_deprecated": (15, None, False),
}
HEALTH_SHARE = (1.0, 0.75, 0.5, 0.25)


def health_score(signals: DataFrame) -> DataFrame:
    """health_score and health_level of wide signal rows; a null signal is skipped."""
    total = F.lit(0.0)
    for name, (weight, steps, less) in HEALTH.items():
        c = F.col(name)
        if steps is None:
            total = total + F.when(c, weight * 0.75).otherwise(0.0)
            continue
        out = F.when(c.isNull(), 0.0)
        if name.endswith("_count"):
            out = out.when(c <= 0, 0.0)
        for step, share in zip(steps, HEALTH_SHARE, strict=True):
            out = out.when(c <= step if less else c >= step, weight * share)
        total = total + out.otherwise(weight * 0.25 if name == "orphaned_dep_count" else 0.0)
    score = F.least(F.lit(100), S.js_round(total / sum(w for w, _, _ in HEALTH.values()) * 100)).cast("int")
    return signals.withColumn("health_score", score).withColumn("health_level", S.health_level(F.col("health_score")))
