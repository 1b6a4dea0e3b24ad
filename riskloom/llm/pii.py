"""Personal data: base patterns, and candidates scored by gradient-boosted trees.

The base patterns give spans of four kinds.  High-recall generators propose further, overlapping spans (disguised
addresses, local phone numbers, separated card numbers, defanged hosts); boosted trees score each by its format and
context; those above the calibrated threshold that touch no base span are added.  Everything runs as column
expressions on each row by itself, without a shuffle; only the trees are fitted by numpy, on generated labelled texts
of a fixed number (TRAIN_TEXTS).

Patterns are possessive and anchored where a failed start could be retried inside a run, so that time is linear in
the text.

Defined results: a null or empty text has no spans and the checksum of the empty string; repeated rows each get
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a base pattern to be tried.
HAS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Generators of candidates: kind, pattern, what a text must contain.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,24}", r"[\[(]at[\])]"),
    ("phone", r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])", r"[0-9][ .-][0-9]{4}"),
    ("card", r"(?<![0-9])[0-9](?:[ ./_-]?[0-9]){13,18}(?![0-9])", r"[0-9]{2}[ ./_-]?[0-9]{2}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])", r"\[\.\]"),
)
CUES = {"email": r"mail|contact|write", "phone": r"tel|phone|call|fax|mobile", "card": r"card|visa|account|pay", "ip": r"ip|host|server|address"}
BEFORE, TRAIN_TEXTS, SEED = 24, 600, 11
FEATURES = ["kind", "digits", "length", "kinds_of_separator", "luhn", "octets", "cue", "other_cue", "glued", "distinct_digits"]


def located(text: Column, pattern: str, has: str) -> Column:
    """array<struct<s, e, m>> of a pattern's leftmost, non-overlapping matches, in code points, end exclusive.

    Starts follow from the lengths of the pieces between the matches.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = "struct<at:int,out:array<struct<s:int,e:int,m:string>>>"

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    pairs = F.filter(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out")).cast(kind)
    fold = F.aggregate(pairs, start, lambda a, x: step(a, x).cast(kind), lambda a: a["out"])
    return F.when(text.rlike(has), fold).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    r = F.split(F.reverse(d), "")
    doubled = F.transform(r, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, k, e>>, k the kind's place in KINDS."""
    hits = F.filter(located(text, BASE[kind], HAS[kind]), lambda x: valid(kind, x["m"]))
    return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def candidates(text: Column) -> Column:
    """array<struct<s, k, e, and the FEATURES>> of all generators."""

    def proposed(kind: str, pattern: str, has: str) -> Column:
        k = KINDS.index(kind)

        def described(x: Column) -> Column:
            m, d = x["m"], digits(x["m"])
            # substring costs its offset; candidates are rare
            before = F.lower(F.substring(text, F.greatest(x["s"] - BEFORE + 1, F.lit(1)), F.least(x["s"], F.lit(BEFORE))))
            around = F.concat(F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(F.lit("")), F.lit(" "), F.substring(text, x["e"] + 1, F.lit(1)))
            seps = F.regexp_replace(m, "[A-Za-z0-9]", "")
            octets = F.regexp_replace(m, r"[\[\]]", "").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
            f = {
                "kind": F.lit(k),
                "digits": F.length(d),
                "length": F.length(m),
                "kinds_of_separator": F.size(F.array_distinct(F.split(seps, ""))),
                "luhn": F.when(F.length(d).between(14, 19), luhn(d).cast("int")).otherwise(0),
                "octets": octets.cast("int"),
                "cue": before.rlike(rf"\b(?:{CUES[kind]})\b").cast("int"),
                "other_cue": before.rlike(r"\b(?:version|order|isbn|page|ref|id|number|part|build)\b").cast("int"),
                "glued": around.rlike("[A-Za-z0-9_]").cast("int"),
                "distinct_digits": F.size(F.array_distinct(F.split(d, ""))),
            }
            return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), *[f[n].cast("int").alias(n) for n in FEATURES])

        return F.transform(located(text, pattern, has), described)

    return F.concat(*[proposed(*g) for g in GENERATORS])


def labelled_texts(n: int = TRAIN_TEXTS, seed: int = SEED) -> list[tuple[str, int]]:
    """Generated texts with one candidate each and whether it is personal data."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 8)))

    def card(ok: bool) -> str:
        body = "4" + num(14)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body))
        last = (10 - total % 10) % 10
        full = body + str(last if ok else (last + r.randint(1, 9)) % 10)
        sep = r.choice("./_")
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    out = []
    for i in range(n):
        good, kind = r.random() < 0.5, KINDS[i % 4]
        cue = r.choice({"email": ["mail", "contact", "write to"], "phone": ["tel", "call", "phone"], "card": ["card", "visa", "pay with"], "ip": ["ip", "server", "host"]}[kind])
        other = r.choice(["version", "order", "isbn", "page", "ref", "part", "build", word()])
        if kind == "email":
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)")])
            body = f"{word()}{at}{word()}{dot}com" if good else f"{word()} (at) {word()}. {word()}"
        elif kind == "phone":
            body = f"({num(3)}) {num(3)}-{num(4)}" if good else r.choice([f"{num(4)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(2)} {num(3)} {num(4)}"])
        elif kind == "card":
            body = card(good)
        else:
            body = "[.]".join(str(r.randint(1, 254) if good else r.randint(256, 999)) for _ in range(4))
        glue = "" if good or r.random() < 0.7 else word()
        lead = cue if good or (kind in ("card", "ip") and r.random() < 0.5) else other
        out.append((f"{word()} {word()} {lead} {glue}{body} {word()}", int(good)))
    return out


@functools.cache
def _fitted(rows: tuple) -> Boosted:
    x = np.array([r[:-1] for r in rows], dtype=float)
    return fit(x, np.array([r[-1] for r in rows], dtype=float), FEATURES)


def train(spark: SparkSession) -> Boosted:
    """Boosted trees fitted on the features of TRAIN_TEXTS generated texts, which the same expressions compute."""
    texts = spark.createDataFrame([(i, *x) for i, x in enumerate(labelled_texts())], "i int, text string, y int").coalesce(1)
    rows = texts.select("i", F.explode(candidates(F.col("text"))).alias("c"), "y").select("i", *[f"c.{f}" for f in FEATURES], "y").collect()
    return _fitted(tuple(tuple(r[1:]) for r in sorted(rows)))


def find_spans(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The documents with `base` and `spans`, arrays of struct<s, k, e> ordered by start and kind."""
    model = model or train(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = docs.withColumn("base", F.array_sort(F.concat(*[base_spans(text, k) for k in KINDS])))

    def accepted(c: Column) -> Column:
        free = ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        return free & (model.column({f: c[f] for f in FEATURES}) >= model.threshold)

    maybe = text.rlike("|".join(f"(?:{has})" for _, _, has in GENERATORS))
    extra = F.transform(F.filter(candidates(text), accepted), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return with_base.withColumn("spans", F.array_sort(F.array_union("base", F.when(maybe, extra).otherwise(empty))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlaps merged, replaced by [KIND] of the earliest."""
    kind = "struct<at:int,out:array<string>>"

    def step(a: Column, x: Column) -> Column:
        piece = F.when(x["s"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"])), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.array_append(a["out"], piece).alias("out")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind)
    whole = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
