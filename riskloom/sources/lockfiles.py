"""parse_lockfile(filename, content): a table function over lockfiles of every format, for SQL and lateral joins.

It gives what files.lockfile_deps() gives for one file: format, name, version and dev, the first row of each name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_HEADER, _NAME = re.compile(r'^"?@?[^\s#"][^"]*@.*:\s*$'), re.compile(r'^"?(@?[^@"]+)@')
_VERSION = re.compile(r'^\s+version:?\s+"?([^"\s]+)"?')
_PNPM = re.compile(r"(?m)^\s+'?/?((?:@[^/\s'@]+/)?[^@\s'(/]+)@([^:\s'(]+)[^\n]*:")
_PINNED = re.compile(r"^[A-Za-z0-9._\[\],-]+\s*(?:===|==|>=|<=|~=|!=|>|<)\s*([^\s,;#]+)")
_PYPI = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)")


def lockfile_format(path: str, content: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    if name == "yarn.lock":
        return "yarn-berry" if "__metadata:" in content else "yarn"
    if name in ("package-lock.json", "pnpm-lock.yaml"):
        return {"p": "pnpm"}.get(name[0] if name[1] == "n" else "", "npm")
    if re.match(r"^requirements.*\.txt$", name):
        return "requirements"
    marks = (('"lockfileVersion"', "npm"), ("# yarn lockfile v1", "yarn"), ("lockfileVersion:", "pnpm"))
    return next((f for m, f in marks if m in content), None)


def _npm(content: str) -> Iterator[tuple[str, str, bool]]:
    try:
        found = json.loads(content)
    except ValueError:
        return
    if not isinstance(found, dict):
        return
    row = lambda name, d: (name, d.get("version") or "0.0.0", bool(d.get("dev")))
    if isinstance(found.get("packages"), dict):
        for key, d in found["packages"].items():
            if (m := re.search(r"^(?:.*/)?node_modules/(.+)$", key)) and isinstance(d, dict):
                yield row(m[1], d)
        return
    todo = [iter((found.get("dependencies") or {}).items())]
    while todo:
        name, d = next(todo[-1], (None, None))
        if name is None:
            todo.pop()
        elif isinstance(d, dict):
            yield row(name, d)
            todo.append(iter((d.get("dependencies") or {}).items()))


def _yarn(content: str) -> Iterator[tuple[str, str, bool]]:
    name = None
    for line in content.split("\n"):
        if _HEADER.search(line):
            name = _NAME.search(line)[1] if _NAME.search(line) else ""
        if (m := _VERSION.search(line)) and name is not None:
            yield name, m[1], False


def _pnpm(content: str) -> Iterator[tuple[str, str, bool]]:
    for m in _PNPM.finditer(content):
        yield m[1], m[2], False


def _requirements(content: str) -> Iterator[tuple[str, str, bool]]:
    for line in map(str.strip, re.split(r"\r?\n", content)):
        if line and line[0] not in "#-" and (m := _PYPI.match(line)):
            pinned = _PINNED.match(line)
            yield re.sub(r"[-_.]+", "-", m[1].lower()), pinned[1] if pinned else "unknown", False


PARSERS = {"npm": _npm, "yarn": _yarn, "yarn-berry": _yarn, "pnpm": _pnpm, "requirements": _requirements}


class _Parse:
    def eval(self, filename: str, content: str):
        kind = lockfile_format(filename or "", content or "")
        seen = set()
        for name, version, dev in PARSERS[kind](content or "") if kind else ():
            if name and name not in seen:
                seen.add(name)
                yield kind, name, version, dev


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_lockfile", F.udtf(_Parse, returnType="format string, name string, version string, dev boolean"))
