"""Advisory feeds, registry documents and SBOMs as tables: JSON read with a fixed schema and flattened by explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

NVD11 = """CVE_Items array<struct<cve: struct<CVE_data_meta: struct<ID: string>, description: struct<description_data: array<struct<lang: string, value: string>>>>,
  impact: struct<baseMetricV3: struct<cvssV3: struct<baseScore: double, baseSeverity: string>>>,
  configurations: struct<nodes: array<struct<cpe_match: array<struct<cpe23Uri: string, versionStartIncluding: string, versionEndIncluding: string, versionEndExcluding: string>>>>>, lastModifiedDate: string>>"""
_METRIC = "array<struct<cvssData: struct<baseScore: double, baseSeverity: string, vectorString: string>, baseSeverity: string>>"
NVD20 = f"""vulnerabilities array<struct<cve: struct<id: string, published: string, lastModified: string, descriptions: array<struct<lang: string, value: string>>,
  metrics: struct<cvssMetricV31: {_METRIC}, cvssMetricV2: {_METRIC}>, weaknesses: array<struct<description: array<struct<lang: string, value: string>>>>, references: array<struct<url: string, tags: array<string>>>>>>"""
_EVENTS = "array<struct<events: array<struct<introduced: string, fixed: string>>>>"
OSV = f"id string, summary string, modified string, affected array<struct<package: struct<name: string, ecosystem: string>, versions: array<string>, ranges: {_EVENTS}>>"
KEV = "vulnerabilities array<struct<cveID: string, vendorProject: string, product: string, vulnerabilityName: string, dateAdded: string, dueDate: string, knownRansomwareCampaignUse: string>>"
PACKUMENT = "name string, time map<string, string>, versions map<string, struct<dependencies: map<string, string>>>"
CYCLONEDX = "components array<struct<name: string, version: string, purl: string, hashes: array<struct<alg: string, content: string>>>>"

#: Weaknesses that say nothing, and ecosystems as advisories name them.
NO_WEAKNESS = ("NVD-CWE-Other", "NVD-CWE-noinfo")
ECOSYSTEMS = {"npm": "npm", "pypi": "PyPI"}


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of one JSON value each, with a fixed schema: nothing is inferred."""
    return spark.read.schema(schema).json(path, multiLine=True)


def english(texts: Column) -> Column:
    """The English text, else the first."""
    return F.coalesce(F.get(F.filter(texts, lambda d: d["lang"] == "en"), F.lit(0))["value"], F.get(texts, F.lit(0))["value"])


def nvd11_advisories(feed: DataFrame) -> DataFrame:
    """One row per CVE: description, score, severity, products and inclusive ranges."""
    i = feed.select(F.explode("CVE_Items").alias("i"))
    matches = F.flatten(F.transform(F.coalesce("i.configurations.nodes", F.array()), lambda n: F.coalesce(n["cpe_match"], F.array().cast("array<struct<cpe23Uri:string,versionStartIncluding:string,versionEndIncluding:string,versionEndExcluding:string>>"))))
    rows = i.withColumn("m", matches)
    bounded = F.filter(F.transform("m", lambda m: F.struct(m["versionStartIncluding"].alias("min"), F.coalesce(m["versionEndIncluding"], m["versionEndExcluding"]).alias("max"))), lambda r: r["min"].isNotNull() | r["max"].isNotNull())
    v3 = F.col("i.impact.baseMetricV3.cvssV3")
    return rows.select(F.col("i.cve.CVE_data_meta.ID").alias("cve_id"), english(F.col("i.cve.description.description_data")).alias("description"), v3["baseScore"].alias("cvss_score"), v3["baseSeverity"].alias("severity"), F.array_distinct(F.filter(F.transform("m", lambda m: m["cpe23Uri"]), lambda c: c.isNotNull())).alias("products"), bounded.alias("ranges"), F.col("i.lastModifiedDate").alias("last_modified"))


def nvd20_advisories(feed: DataFrame) -> DataFrame:
    """One row per CVE: v3.1 metrics, else v2; the severity from the score where it isn't named."""
    c = feed.select(F.explode("vulnerabilities.cve").alias("c"))
    v31, v2 = F.get(F.col("c.metrics.cvssMetricV31"), F.lit(0)), F.get(F.col("c.metrics.cvssMetricV2"), F.lit(0))
    score = F.coalesce(v31["cvssData"]["baseScore"], v2["cvssData"]["baseScore"])
    named = F.lower(F.coalesce(v31["cvssData"]["baseSeverity"], v2["baseSeverity"]))
    weak = F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce("c.weaknesses", F.array().cast("array<struct<description:array<struct<lang:string,value:string>>>>")), lambda w: F.transform(w["description"], lambda d: d["value"]))), lambda x: ~x.isin(*NO_WEAKNESS)))
    text = english(F.col("c.descriptions"))
    return c.select(F.col("c.id").alias("cve_id"), F.substring(text, 1, 240).alias("title"), text.alias("description"), score.alias("cvss_score"), F.coalesce(named, S.cvss_level(score)).alias("severity"), weak.alias("weaknesses"), F.transform("c.references", lambda r: F.struct(r["url"].alias("url"), F.get(r["tags"], F.lit(0)).alias("tag"))).alias("refs"), F.col("c.lastModified").alias("last_modified"))


def _bounds(ranges: Column) -> Column:
    """>=introduced and <fixed of all events."""
    events = F.flatten(F.transform(F.coalesce(ranges, F.array().cast(_EVENTS)), lambda r: F.coalesce(r["events"], F.array().cast("array<struct<introduced:string,fixed:string>>"))))
    each = F.transform(events, lambda e: F.when(e["introduced"].isNotNull(), F.concat(F.lit(">="), e["introduced"])).when(e["fixed"].isNotNull(), F.concat(F.lit("<"), e["fixed"])))
    return F.filter(each, lambda x: x.isNotNull())


def osv_malware(feed: DataFrame, ecosystem: str) -> DataFrame:
    """MAL- advisories, a row for each affected package of the ecosystem; one with an empty name if nothing is affected."""
    rows = feed.filter(F.startswith("id", F.lit("MAL-"))).select("id", "summary", "modified", F.explode_outer("affected").alias("a"))
    wanted = F.col("a").isNull() | (F.lower("a.package.ecosystem") == ecosystem)
    versions = F.array_distinct(F.concat(F.coalesce("a.versions", F.array().cast("array<string>")), _bounds(F.col("a.ranges"))))
    return rows.filter(wanted).select(F.col("id").alias("advisory_id"), F.coalesce("a.package.name", F.lit("")).alias("package_name"), F.lit(ecosystem).alias("ecosystem"), versions.alias("affected_versions"), "summary", F.col("modified").alias("updated_at"))


def osv_affected(feed: DataFrame) -> DataFrame:
    """advisory, package, range and fix of each affected package; the last range wins."""
    rows = feed.select("id", F.explode("affected").alias("a"))
    last = F.try_element_at(F.col("a.ranges"), F.lit(-1))["events"]
    start, fixed = F.get(F.filter(F.transform(last, lambda e: e["introduced"]), lambda x: x.isNotNull()), F.lit(0)), F.get(F.filter(F.transform(last, lambda e: e["fixed"]), lambda x: x.isNotNull()), F.lit(0))
    return rows.select(F.col("id").alias("advisory_id"), F.col("a.package.name").alias("package_name"), F.concat_ws(", ", F.concat(F.lit(">="), start), F.concat(F.lit("<"), fixed)).alias("affected_range"), fixed.alias("patched_version"))


def kev_catalogue(feed: DataFrame) -> DataFrame:
    v = feed.select(F.explode("vulnerabilities").alias("v"))
    return v.select(F.upper("v.cveID").alias("cve_id"), F.to_date("v.dateAdded").alias("date_added"), F.when(F.lower("v.knownRansomwareCampaignUse") == "known", "widespread").otherwise("active-exploitation").alias("maturity"))


def registry_versions(docs: DataFrame) -> DataFrame:
    """package, version and time of publication; `created` and `modified` aren't versions."""
    t = docs.select("name", F.explode("time").alias("version", "at"))
    return t.filter(~F.col("version").isin("created", "modified")).select(F.col("name").alias("package"), "version", F.col("at").try_cast("timestamp").alias("published_at"))


def registry_dependencies(docs: DataFrame) -> DataFrame:
    v = docs.select("name", F.explode("versions").alias("version", "v"))
    return v.select(F.col("name").alias("package"), "version", F.explode("v.dependencies").alias("dependency", "range"))


def sbom_components(docs: DataFrame, ecosystem: str | None = None) -> DataFrame:
    """Components with the parts of their package URL and SHA-256 digest."""
    c = docs.select(F.explode("components").alias("c"))
    purl = r"^pkg:([^/]+)/(.+?)@([^?#]+)"
    part = lambda i: F.nullif(F.regexp_extract("c.purl", purl, i), F.lit(""))
    digest = F.get(F.filter("c.hashes", lambda h: F.upper(h["alg"]) == "SHA-256"), F.lit(0))["content"]
    out = c.select(part(1).alias("ecosystem"), F.coalesce(part(2), F.col("c.name")).alias("name"), F.coalesce(part(3), F.col("c.version")).alias("version"), F.lower(digest).alias("sha256"))
    return out if ecosystem is None else out.filter(F.col("ecosystem") == ecosystem)
