"""Product KPIs, metering, model logs, release cadence and maintenance signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def in_window(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    return events.filter(~F.col("demo") & (F.col("timestamp") >= as_of - F.expr(f"INTERVAL {days} DAYS")))


def dashboard(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Scans, error rate, 95th percentile (nearest rank) of latency, active organisations and conversion, in one pass."""
    done, failed = F.col("type") == "scan_completed", F.col("type") == "scan_failed"
    share = lambda a, b: S.js_round(a * 10000.0 / F.greatest(F.lit(1), b)) / 100
    orgs = F.count_distinct("org_id")
    return in_window(events, as_of, days).agg(
        F.count_if(done).alias("total_scans"),
        share(F.count_if(failed), F.count_if(done | failed)).alias("error_rate_pct"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN type = 'scan_completed' THEN duration_ms END)").cast("long").alias("p95_latency_ms"),
        orgs.alias("active_orgs"),
        share(F.count_distinct(F.when(done & (F.col("risk_score") > 0), F.col("org_id"))), orgs).alias("conversion_rate"),
    )


def top_packages(events: DataFrame, as_of: Column, days: int = 7, n: int = 10) -> DataFrame:
    counts = in_window(events, as_of, days).filter("type = 'scan_completed'").groupBy("ecosystem", "package_name").agg(F.count("*").alias("scan_count"))
    return counts.orderBy(F.desc("scan_count"), "ecosystem", "package_name").limit(n)


def validated(events: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """The events with reject_reason: the first check that holds, or ok."""
    out = None
    for name, bad in checks:
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return events.withColumn("reject_reason", out.otherwise("ok"))


def usage(events: DataFrame, quota: int) -> DataFrame:
    """Scans and packages per organisation and calendar month, and whether the quota is used up."""
    done = events.filter("org_id is not null and type = 'scan_completed'")
    out = done.groupBy("org_id", F.date_format(F.date_trunc("month", "timestamp"), "yyyy-MM-dd").alias("period_start")).agg(F.count("*").alias("scans"), F.count_distinct("package_name").alias("repos"))
    return out.withColumn("over_quota", F.col("scans") >= quota)


def model_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.avg(F.col("success").cast("double")), 4).alias("success_rate"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.count_if(~F.col("success")).alias("fallbacks"))


def sla_breaches(log: DataFrame, limit: int, calls: int = 3) -> DataFrame:
    """Calls that are the last of three in a row over the limit, per model and conversation."""
    w = Window.partitionBy("model", "conv_id").orderBy("turn", "latency_ms", "success").rowsBetween(1 - calls, 0)
    return log.withColumn("low", F.min("latency_ms").over(w)).withColumn("n", F.count("*").over(w)).filter((F.col("n") == calls) & (F.col("low") > limit)).drop("low", "n")


def release_cadence(releases: DataFrame) -> DataFrame:
    """Mean gap between releases in whole days and the median gap; packages of one release are left out."""
    w = Window.partitionBy("package_id").orderBy("published_at", "release_id")
    gap = (F.unix_timestamp("published_at") - F.unix_timestamp(F.lag("published_at").over(w))) / 86400.0
    return releases.withColumn("gap", gap).filter("gap is not null").groupBy("package_id").agg(S.js_round(F.avg("gap")).alias("mean_gap"), F.round(F.median("gap"), 4).alias("median_gap"))


def turnover(activity: DataFrame) -> DataFrame:
    """Share of the earlier contributors that are gone; null repositories without earlier ones are left out."""
    per = activity.groupBy("repo", "login").agg(F.bool_or("is_current").alias("now"), F.bool_or(~F.col("is_current")).alias("was"))
    out = per.groupBy("repo").agg(F.count_if(F.col("was") & ~F.col("now")).alias("gone"), F.count_if("was").alias("n"))
    return out.filter("n > 0").select("repo", F.round(F.col("gone") / F.col("n"), 4).alias("turnover"))


def dependency_age(releases: DataFrame, as_of: Column) -> DataFrame:
    """Mean age of a package's releases against the median of all, 50 at the median, 100 at most."""
    aged = releases.withColumn("d", F.datediff(as_of, F.to_date("published_at")))
    middle = aged.agg(F.median("d").alias("m"))
    per = aged.groupBy("package_id").agg(F.avg("d").alias("age"))
    # the right side is one row
    return per.crossJoin(F.broadcast(middle)).select("package_id", F.least(F.lit(100), F.when(F.col("m") <= 0, 50).otherwise(S.js_round(F.col("age") / F.col("m") * 50))).cast("int").alias("age_percentile"))
