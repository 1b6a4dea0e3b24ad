"""Column functions: ladders, boosts, names, versions, licences and texts.

Rounding follows js_round: halves go up.  Nulls mean "unavailable" and give null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def ladder(x: Column, steps: Sequence[tuple[float, str]], otherwise: str | int = "none", strict: bool = False) -> Column:
    """The name of the first step that x reaches, or exceeds if strict."""
    out = None
    for least, name in steps:
        hit = x > least if strict else x >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


#: Ranks of severities and of risk levels.
SEVERITIES = ("info", "low", "medium", "high", "critical")
LEVELS = ("none", "low", "medium", "high", "critical")


def rank_of(level: Column, names: Sequence[str] = LEVELS) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), level) - 1, F.lit(-1)).cast("int")


def level_of(rank: Column, names: Sequence[str] = LEVELS) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), rank)


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 30, "medium").when(score > 0, "low").otherwise("none")


def normalize_risk(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(x))).cast("int")


def health_level(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").when(score > 0, "low").otherwise("none")


def cvss_level(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("none")


def confusion_level(score: Column) -> Column:
    return ladder(score, ((0.85, "critical"), (0.70, "high"), (0.55, "medium")), "low")


def builder_level(score: Column) -> Column:
    return F.when(score <= 10, "none").when(score <= 30, "low").when(score <= 55, "medium").when(score <= 75, "high").otherwise("critical")


#: The five exploit-probability ladders, as (bound, points, whether the bound must be exceeded).
EPSS = {
    "a": ((0.90, 25, True), (0.75, 15, True)),
    "b": ((0.90, 25, True), (0.75, 15, True), (0.40, 5, False)),
    "c": ((0.90, 20, False), (0.75, 10, False)),
    "d": ((0.90, 25, True), (0.75, 15, True), (0.50, 8, True)),
}


def epss_boost(percentile: Column, kind: str) -> Column:
    """Points of a percentile by ladder a to d, or e: 40 times the percentile."""
    if kind == "e":
        return js_round(percentile * 40).cast("int")
    out = F.when(percentile.isNull(), 0)
    for bound, points, strict in EPSS[kind]:
        out = out.when(percentile > bound if strict else percentile >= bound, points)
    return out.otherwise(0)


def kev_boost(is_kev: Column, maturity: Column) -> Column:
    return F.when(is_kev & maturity.isin("active-exploitation", "widespread"), 20).otherwise(0)


def kev_flat(is_kev: Column, points: int) -> Column:
    return F.when(is_kev, points).otherwise(0)


def fix_boost(patched: Column, unmerged: Column) -> Column:
    return F.when(patched.isNull() | (patched == ""), 10).when(unmerged, 5).otherwise(0)


def patch_penalty(confidence: Column) -> Column:
    return F.when(confidence == "high", -15).when(confidence == "medium", -10).when(confidence == "low", -5).otherwise(0)


def deployment_modifier(days: Column, adoption: Column) -> Column:
    return F.when((days < 7) | (adoption < 0.05), 0).when((days >= 90) & (adoption >= 0.5), -10).when((days >= 30) & (adoption >= 0.25), -5).otherwise(0)


def cvss_floor(score: Column) -> Column:
    return F.when(score >= 9, 55).when(score >= 7, 40).when(score >= 4, 20).when(score > 0, 5).otherwise(0)


def vector_severity(vector: Column) -> Column:
    """Severity by a CVSS vector's access, complexity and impact; null for a null vector."""
    at = lambda k: F.try_element_at(F.str_to_map(vector, F.lit("/"), F.lit(":")), F.lit(k))
    near, easy = at("AV"), at("AC") == "L"
    hard = (at("C") == "H") | (at("I") == "H")
    return F.when(vector.isNull(), None).when((near == "N") & easy & hard, "CRITICAL").when(near == "N", "HIGH").when(near.isin("A", "L"), "MEDIUM").otherwise("LOW")


def heat_score(cvss: Column, percentile: Column, exploited: Column) -> Column:
    return F.least(F.lit(100), F.floor(cvss * 5 + percentile * 40 + F.when(exploited, 30).otherwise(0))).cast("int")


def heat_tier(heat: Column, exploited: Column, patch: Column) -> Column:
    return F.when(exploited | (heat >= 75), "red").when(patch & (heat >= 35), "yellow").otherwise("green")


def maturity(in_kev: Column, percentile: Column) -> Column:
    return F.when(in_kev, "active-exploitation").when(percentile >= 0.95, "widespread").when(percentile >= 0.5, "active-exploitation").when(percentile > 0, "proof-of-concept").otherwise("none")


# --- names ------------------------------------------------------------------


def npm_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^@[^/]+/", "")


def pypi_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def cross_name(name: Column) -> Column:
    return F.regexp_replace(pypi_name(npm_name(name)), r"^-+|-+$", "")


def collapsed_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[-_.]", "")


#: Visual substitutions, applied in this order.
VISUAL = (("0", "o"), ("1", "l"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m"))


def visual_name(name: Column) -> Column:
    for a, b in VISUAL:
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


#: Characters that look like letters, and what they look like; the soft hyphen vanishes.
LOOKALIKES = {"а": "a", "е": "e", "х": "x", "о": "o", "р": "r", "с": "c", "у": "y", "α": "a", "ε": "e", "ι": "i", "ο": "o", "–": "-", "—": "-", "0": "o", "1": "l", "3": "e", "5": "s", "!": "i", "@": "a"}


def homoglyph_name(name: Column) -> Column:
    return F.translate(F.lower(name), "".join(LOOKALIKES) + "\u00ad", "".join(LOOKALIKES.values()))


#: Names that are well known on both registries, and parts of names that make a short cut to credentials.
CROSS_LISTED = """redis requests urllib3 six certifi chardet idna packaging cryptography click rich toml attrs flask django numpy pandas pytest
black flake8 mypy twine wheel pip setuptools grpcio protobuf""".split()
RISKY_PARTS = "helper utils util tool tools common core lib sdk".split()


def cross_listed_risky(name: Column) -> Column:
    low = F.lower(name)
    return ~low.isin(CROSS_LISTED) & ((F.length(low) <= 6) | low.rlike("|".join(RISKY_PARTS)))


def trick_confidence(trick: Column) -> Column:
    return F.when(trick == "scope-strip", 0.95).when(trick == "separator-variation", 0.90).when(trick.isin("visual-substitution", "edit-distance-1"), 0.85).when(trick == "edit-distance-2", 0.65).otherwise(0.50)


#: Names, prefixes and suffixes of packages with native code, and build tools.
NATIVE_NAMES = """bcrypt argon2 sodium-native keytar sharp canvas @napi-rs/image better-sqlite3 sqlite3 pg-native lmdb leveldown rocksdb duckdb
libsql esbuild @swc/core lightningcss @biomejs/biome node-sass fsevents turbo zeromq grpc ssh2 node-pty serialport usb node-hid ffi-napi ref-napi
cpu-features systeminformation @tensorflow/tfjs-node onnxruntime-node re2 oniguruma msgpackr snappy lz4 node-zstd zlib-sync ffmpeg-static
@discordjs/opus node-opus speaker node-canvas gl headless-gl node-addon-api cld node-webrtc unix-dgram bufferutil utf-8-validate""".split()
NATIVE_PREFIXES = "@esbuild/ @swc/core- @rollup/rollup- @biomejs/cli- lightningcss- @napi-rs/ turbo- @parcel/watcher- @next/swc- @tailwindcss/oxide-".split()
NATIVE_SUFFIXES = "-linux-x64-gnu -linux-arm64-gnu -darwin-arm64 -darwin-x64 -win32-x64-msvc -linux-x64-musl -linux-arm64-musl -freebsd-x64 -android-arm64".split()
BUILD_TOOLS = "node-gyp node-pre-gyp prebuild-install prebuild node-gyp-build @mapbox/node-pre-gyp cmake-js napi-rs node-addon-api nan".split()
INSTALL_SCRIPT = r"(?i)node-gyp|prebuild|cmake-js|napi"
AUTO_RUN = "preinstall install postinstall prepare".split()


def is_native_name(name: Column) -> Column:
    out = name.isin(NATIVE_NAMES)
    for p in NATIVE_PREFIXES:
        out = out | name.startswith(p)
    for s in NATIVE_SUFFIXES:
        out = out | name.endswith(s)
    return out


def has_build_tool(dependencies: Column) -> Column:
    return F.arrays_overlap(dependencies, F.array(*[F.lit(t) for t in BUILD_TOOLS]))


def has_install_script(scripts: Column) -> Column:
    """Whether a map of scripts has a hook that runs by itself and isn't blank."""
    out = F.lit(False)
    for hook in AUTO_RUN:
        out = out | (F.length(F.trim(F.coalesce(F.try_element_at(scripts, F.lit(hook)), F.lit("")))) > 0)
    return out


def discovery_priority(downloads: Column, indicators: Column, known: Column) -> Column:
    return F.least(F.lit(100), F.floor(F.log10(downloads + 1) * 15 + indicators * 10 + F.when(known, 10).otherwise(0))).cast("int")


# --- versions ---------------------------------------------------------------


def semver(version: Column) -> Column:
    """struct<major, minor, patch> of a version with two parts at least; null if a part isn't a number."""
    clean = F.get(F.split(F.regexp_replace(version, r"^[v=^~>=<\s]+", ""), "[-+]"), F.lit(0))
    parts = F.split(clean, r"\.")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    return F.when(clean.rlike(r"^[0-9]+(\.[0-9]+)+$"), F.struct(at(0).alias("major"), at(1).alias("minor"), at(2).alias("patch")))


def lenient_version(version: Column) -> Column:
    """struct<major, minor, patch>, from one part on; null if it doesn't begin with a number."""
    clean = F.get(F.split(F.regexp_replace(version, r"^[v=^~>=<\s]+", ""), "[-+]"), F.lit(0))
    parts = F.split(clean, r"\.")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    return F.when(clean.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.struct(at(0).alias("major"), at(1).alias("minor"), at(2).alias("patch")))


def version_in_range(version: Column, low: Column, high: Column) -> Column:
    """Inclusive range; an unreadable version is outside, an unreadable bound is ignored."""
    return parsed_in_range(lenient_version(version), lenient_version(low), lenient_version(high))


def parsed_in_range(v: Column, a: Column, b: Column) -> Column:
    """The same for versions that lenient_version has read."""
    return F.coalesce(v.isNotNull() & (a.isNull() | (v >= a)) & (b.isNull() | (v <= b)), F.lit(False))


def bump_type(current: Column, target: Column) -> Column:
    c, t = semver(current), semver(target)
    return F.when(c.isNull() | t.isNull() | (c["major"] != t["major"]), "major").when(c["minor"] != t["minor"], "minor").otherwise("patch")


def _clause(v: Column, clause: Column) -> Column:
    r = F.trim(clause)
    base = semver(F.regexp_replace(r, r"^(\^|~|>=|<=|>|<|=)", ""))
    first = F.regexp_extract(r, r"^(\^|~|>=|<=|>|<|=)", 1)
    caret = (v["major"] == base["major"]) & F.when(base["major"] == 0, (v["minor"] == base["minor"]) & (v["patch"] >= base["patch"])).otherwise(v >= base)
    tilde = (v["major"] == base["major"]) & (v["minor"] == base["minor"]) & (v["patch"] >= base["patch"])
    test = F.when(first == "^", caret).when(first == "~", tilde).when(first == ">=", v >= base).when(first == ">", v > base).when(first == "<=", v <= base).when(first == "<", v < base).otherwise(v == base)
    return F.when(r.isin("", "*") | base.isNull(), True).otherwise(test)


def semver_satisfies(version: Column, range_: Column) -> Column:
    """Alternatives by ||, of clauses that must all hold; a clause that can't be read holds."""
    v = semver(version)
    alternatives = F.split(range_, r"\|\|")
    holds = F.exists(alternatives, lambda a: F.forall(F.filter(F.split(F.trim(a), r"\s*&&\s*|\s+"), lambda c: c != ""), lambda c: _clause(v, c)))
    return F.when(range_.isNull() | range_.isin("", "*"), True).when(v.isNull(), False).otherwise(holds)


def is_version_patched(resolved: Column, patched: Column) -> Column:
    """Whether a version equals or exceeds the patched one, part by part; anything but numbers gives false."""
    ints = lambda c: F.transform(F.split(c, r"\."), lambda p: p.try_cast("long"))
    a, b = ints(resolved), ints(patched)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < F.size(x), F.get(x, i)).otherwise(F.lit(0).cast("long")))
    bad = F.exists(a, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull())
    return F.when(resolved.isNull() | patched.isNull(), False).when(resolved == patched, True).when(bad, False).otherwise(pad(a) >= pad(b))


# --- packages ---------------------------------------------------------------


def wheel_tags(filename: Column) -> Column:
    """struct<python, abi, platform> of a wheel's file name; null with fewer than three parts."""
    parts = F.split(F.regexp_replace(filename, r"\.whl$", ""), "-")
    n = F.size(parts)
    return F.when(n >= 3, F.struct(F.get(parts, n - 3).alias("python"), F.get(parts, n - 2).alias("abi"), F.get(parts, n - 1).alias("platform")))


def is_python_extension(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(so|pyd|dylib)$")


def required_name(requirement: Column) -> Column:
    return pypi_name(F.regexp_extract(F.trim(requirement), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))


#: Licences that are deprecated, not approved or missing, as they can match after upper-casing.
BAD_LICENCES = "UNLICENSED|UNLICENSE|SEE LICENSE IN LICENSE|SEE LICENSE IN LICENCE|GPL-2.0|GPL-3.0|LGPL-2.0|LGPL-2.1|LGPL-3.0|AGPL-3.0|AGPL-1.0|MPL-1.0|MPL-1.1|CDDL-1.0|EPL-1.0|OSL-1.0|OSL-1.1|OSL-2.0|OSL-2.1|OSL-3.0|".split("|")


def bad_licence(licence: Column) -> Column:
    return licence.isNull() | F.upper(F.trim(licence)).isin(BAD_LICENCES)


def is_fresh(ts: Column, as_of: Column, days: int = 30, absent: bool = False) -> Column:
    return F.when(ts.isNull(), absent).otherwise(F.unix_timestamp(as_of) - F.unix_timestamp(ts) <= days * 86400)


#: Patterns of tokens that evidence must not show.
SECRETS = (
    r"\b(?:xai|sk|pk|rk|ghp|gho|ghu|ghs|ghr|github_pat|npm|AKIA|ASIA)[-_][A-Za-z0-9_-]{12,}",
    r"(?i)\bBearer\s+[A-Za-z0-9._-]{16,}",
    r"\beyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"\b[A-Fa-f0-9]{40,}\b",
)


def redact(evidence: Column, most: int = 240) -> Column:
    out = F.trim(F.regexp_replace(evidence, r"\s+", " "))
    for p in SECRETS:
        out = F.regexp_replace(out, p, "[REDACTED]")
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("…"))).otherwise(out)


#: Plans in order, and the least plan of each feature.
PLANS = ("free", "pro", "team", "enterprise")
FEATURES = {"api_access": "pro", "watchlists": "pro", "proactive_alerts": "pro", "binary_diff_alerts": "pro", "sbom_export": "team", "slack_alerts": "team", "compliance_reports": "enterprise"}


def entitled(plan: Column, least: Column) -> Column:
    """Whether a plan reaches a feature's least plan; an unknown feature (null) is refused."""
    return F.coalesce(rank_of(plan, PLANS) >= rank_of(least, PLANS), F.lit(False)) & least.isNotNull()
