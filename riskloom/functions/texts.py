"""Sentences for reports: recommendations and audit summaries.  The wording is a fixed value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recommendation(cve: Column, severity: Column, percentile: Column, kev_date: Column) -> Column:
    """What to do about a CVE, by the first of: known exploited, likely exploited, rated high, any."""
    dash = F.lit(" \u2014 ")
    return (
        F.when(kev_date.isNotNull() & (kev_date != ""), F.concat(cve, F.lit(" is in the CISA KEV catalogue (added "), kev_date, F.lit(")"), dash, F.lit("patch immediately.")))
        .when(percentile >= 0.5, F.concat(cve, F.format_string(" has high exploit probability (EPSS %.1fth percentile)", percentile * 100), dash, F.lit("prioritise patching.")))
        .when(F.upper(severity).isin("CRITICAL", "HIGH"), F.concat(cve, F.lit(" is rated "), severity, dash, F.lit("schedule prompt remediation.")))
        .otherwise(F.concat(F.lit("Review "), cve, F.lit(" and apply the latest patched version.")))
    )


def audit_summary(n_packages: Column, max_risk: Column, n_circular: Column, n_orphaned: Column) -> Column:
    """One sentence on a dependency graph."""
    some = lambda n, one, rest: F.concat(n.cast("string"), F.lit(one), F.when(n != 1, "s").otherwise(""), F.lit(rest))
    level = F.when(max_risk >= 75, "CRITICAL").when(max_risk >= 50, "HIGH").when(max_risk >= 25, "MEDIUM").otherwise("LOW")
    risk = F.when(max_risk == 0, "no risk scores recorded").otherwise(F.concat(level, F.lit(" max-transitive risk score "), max_risk.cast("string"), F.lit("/100")))
    circular = F.when(n_circular > 0, some(n_circular, " circular dep", " detected")).otherwise("no circular deps")
    orphaned = F.when(n_orphaned > 0, some(n_orphaned, " orphaned dep", "")).otherwise("no orphaned deps")
    return F.concat(F.concat_ws("; ", some(n_packages, " package", " in graph"), risk, circular, orphaned), F.lit("."))
