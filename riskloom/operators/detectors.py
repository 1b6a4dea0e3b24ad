"""Detectors: token hints, behaviours of strings, Python build files, provenance scores, and the plug-in registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .rules import Rule

#: What hints at a behaviour in a string.
HINTS = {
    "network": r"(?i)https?://",
    "filesystem": r"(?i)(/tmp|/var|cache|temp|tmp|readFile|writeFile|open|unlink|mkdir)",
    "process": r"(?i)(spawn|exec|fork|child_process|system\()",
    "crypto": r"(?i)(crypto|hash|sha|md5|bcrypt|argon2|evp_|aes|rsa|urandom)",
    "obfuscation": r"(?i)(base64|xor|pack|obfus|eval|fromcharcode|atob)",
    "dataExfiltration": r"(?i)(token|secret|password|auth|cookie|telemetry|upload|exfil|beacon)",
}
#: What shows a behaviour in an interesting string.
BEHAVIOURS = {
    "network": r"(?i)https?://|connect|socket|dns|curl|fetch",
    "filesystem": r"(?i)/tmp|/var|cache|read|write|open|unlink|mkdir|fs_",
    "process": r"(?i)spawn|exec|fork|system|child_process",
    "crypto": r"(?i)crypto|hash|sha|md5|bcrypt|argon2|evp_|aes|rsa|urandom",
    "obfuscation": r"(?i)base64|xor|packed|obfus|eval|atob|fromcharcode",
    "dataExfiltration": r"(?i)token|secret|password|auth|cookie|telemetry|upload|exfil|beacon|env",
}
#: Rules over Python build files.
BUILD_RULES = (
    Rule("shell-execution", "remoteCodeExecution", "high", "Shell execution in build file", (r"subprocess\s*\.\s*(?:run|call|check_call|check_output|Popen)\s*\(", r"os\s*\.\s*system\s*\(", r"os\s*\.\s*(?:popen|execv?[ep]?[l]?[pe]?)\s*\(", r"shell\s*=\s*True", r"commands\s*\.\s*(?:getoutput|getstatus|getstatusoutput)\s*\(")),
    Rule("dynamic-evaluation", "scriptInjection", "high", "Dynamic evaluation in build file", (r"\beval\s*\(", r"\bexec\s*\(", r"\bcompile\s*\(\s*(?:open|read|fetch|request)", r"importlib\s*\.\s*import_module\s*\(\s*(?:os|subprocess|ctypes)", r"__import__\s*\(\s*['\"](?:os|subprocess|ctypes|socket)")),
    Rule("install-hook", "setupToolsHookExecution", "medium", "Hook in build file", (r"cmdclass\s*=\s*\{[^}]*['\"](?:install|develop|build_ext|build_clib|sdist|bdist)['\"]", r"class\s+\w+\s*\(\s*install\s*\)\s*:", r"class\s+\w+\s*\(\s*develop\s*\)\s*:", r"class\s+\w+\s*\(\s*build_ext\s*\)\s*:", r"setup_requires\s*=\s*\[", r"\[\s*tool\.setuptools\.cmdclass\s*\]")),
)
#: Build systems by their declared back end, in order.
BUILD_SYSTEMS = (("poetry", r"build-backend\s*=\s*[\"']poetry(?:\.core)?\.masonry\.api[\"']"), ("pdm", r"build-backend\s*=\s*[\"']pdm\.(?:pep517\.)?api[\"']"), ("flit", r"build-backend\s*=\s*[\"']flit(?:_core)?\.buildapi[\"']"), ("hatch", r"build-backend\s*=\s*[\"']hatchling\.build[\"']"), ("setuptools", r"setuptools\.build_meta|from\s+setuptools\s+import|import\s+setuptools|\[metadata\]|\[options\]"))


def token_hints(strings: Column, hints: dict[str, str] = HINTS) -> Column:
    """The hints that any string of an array gives, in order."""

    def hit(pattern: str) -> Column:
        return F.exists(strings, lambda s: s.rlike(pattern))

    return F.filter(F.array(*[F.when(hit(p), n) for n, p in hints.items()]), lambda x: x.isNotNull())


def string_behaviours(df: DataFrame, strings: str, keys: list[str]) -> DataFrame:
    """Per behaviour: detected and the number of strings that show it; exfiltration counts only together with network."""

    def shows(pattern: str) -> Column:
        return F.size(F.filter(strings, lambda s: s.rlike(pattern)))

    out = df.select(*keys, *[shows(p).alias(n) for n, p in BEHAVIOURS.items()])
    out = out.withColumn("dataExfiltration", F.when(F.col("network") > 0, F.col("dataExfiltration")).otherwise(0))
    tall = out.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("behaviour"), F.col(n).alias("n_details")) for n in BEHAVIOURS])).alias("b"))
    return tall.select(*keys, "b.behaviour", "b.n_details").filter("n_details > 0").withColumn("detected", F.lit(True))


def build_system(content: Column) -> Column:
    out = None
    for name, pattern in BUILD_SYSTEMS:
        out = F.when(content.rlike(pattern), name) if out is None else out.when(content.rlike(pattern), name)
    return out.otherwise("unknown")


def tri_state(check: Column, bad: int, unknown: int, good: int) -> Column:
    return F.when(check.isNull(), unknown).when(check, good).otherwise(bad)


def provenance_risk(signature: Column, publisher: Column, correlated: Column, fresh: Column, consistent: Column) -> Column:
    """20 and the points of five checks, each failed, unknown or passed, within 0 to 100."""
    total = F.lit(20) + tri_state(signature, 25, 10, -10) + tri_state(publisher, 30, 5, -10) + tri_state(correlated, 35, 5, -10) + tri_state(fresh, 20, 3, -5) + tri_state(consistent, 20, 2, -5)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def builder_reputation(trusted: Column, entries: Column, public_logs: Column, attested: Column, repository: Column, level: Column) -> Column:
    total = F.lit(30) + F.when(trusted, -20).otherwise(0) + F.when(entries > 0, -15).otherwise(0) + F.when(public_logs, -10).otherwise(0) + F.when(attested, 0).otherwise(15) + F.when(repository.isNull() | (repository == ""), 20).otherwise(0) + F.when(level <= 1, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def health_override(level: Column, commits: Column, orphaned: Column, cadence: Column, cycles: Column, bad_licence: Column) -> Column:
    """At least high for abandoned packages with orphans, cycles or a bad licence."""
    forced = ((commits == 0) & (F.coalesce(orphaned, F.lit(0)) >= 5)) | ((F.coalesce(cadence, F.lit(0)) >= 365) & (F.coalesce(cycles, F.lit(0)) > 0)) | ((commits == 0) & F.coalesce(bad_licence, F.lit(False)))
    return F.when(F.coalesce(forced, F.lit(False)) & (S.rank_of(level) < 3), "high").otherwise(level)


# --- plug-ins ---------------------------------------------------------------------

FINDINGS = "artifact_id long, detector string, detected boolean, confidence double, signals array<string>"


class Registry:
    """Detectors by name: functions of a DataFrame, or of one row in Python; all give the columns of FINDINGS."""

    def __init__(self) -> None:
        self.frames: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, detect: Callable[[DataFrame], DataFrame]) -> None:
        self.frames[name] = detect

    def add_python(self, name: str, detect: Callable[[dict], tuple[bool, float, list[str]]]) -> None:
        """A detector of one row; one that fails gives a placeholder row."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for row in b.to_dict("records"):
                    try:
                        detected, confidence, signals = detect(row)
                    except Exception as e:
                        detected, confidence, signals = False, 0.0, [f"error: {type(e).__name__}"]
                    out.append((row["artifact_id"], name, detected, confidence, signals))
                yield pd.DataFrame(out, columns=["artifact_id", "detector", "detected", "confidence", "signals"])

        self.frames[name] = lambda df: df.mapInPandas(run, FINDINGS)

    def disable(self, name: str) -> None:
        self.frames.pop(name, None)

    def run(self, artifacts: DataFrame) -> DataFrame:
        out = artifacts.sparkSession.createDataFrame([], FINDINGS)
        for detect in self.frames.values():
            out = out.unionByName(detect(artifacts))
        return out


@F.udtf(returnType=T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())]))
class ParseRequirements:
    """Table function over the text of a requirements file, for SQL."""

    def eval(self, content: str):
        for line in (content or "").splitlines():
            line = line.strip()
            if line and line[0] not in "#-" and (m := re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)[^=<>~!]*(?:[=<>~!]+\s*([^\s,;#]+))?", line)):
                yield re.sub(r"[-_.]+", "-", m[1].lower()), m[2] or "unknown"


def register(spark) -> None:
    spark.udtf.register("parse_requirements", ParseRequirements)
