"""Look-alike names: typosquats, name intelligence, malware names, cross-ecosystem confusion.

Edit distances of one or two are found by deletion neighbourhoods: two names within distance d share a name after
deleting at most d letters from each, so candidate pairs come from an equi-join and are then measured.  No join here
is over lengths or over everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .tables import first_by


#: Letters of names, the common ones first.
RARE_LETTERS = "earoitnslcdupmhgbfywkvxzjq-_0123456789."


def deletions(name: Column, most: int = 2) -> Column:
    """The name and all names with up to `most` of its letters left out."""
    out = F.array(name)
    for _ in range(most):
        shorter = F.flatten(F.transform(out, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(1))), lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def near_names(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 2) -> DataFrame:
    """Pairs (a, b, distance) of distinct names of both sides at a distance of 1 to `most`."""
    l_ = left.select(F.col(a).alias("a")).distinct().select("a", F.explode(deletions(F.col("a"), most)).alias("d"))
    r_ = right.select(F.col(b).alias("b")).distinct().select("b", F.explode(deletions(F.col("b"), most)).alias("d"))
    met = l_.join(r_.hint("merge"), "d").filter("a <> b").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most)).filter(F.col("distance").between(1, most))


def typosquats(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """The popular name (name, ord) that each candidate name imitates: target, distance, trick and confidence.

    Popular names and bare names of under three letters imitate nothing.  A stripped scope goes first, then the first
    popular name in list order that is equal without separators or after visual substitutions, then the nearest.
    """
    bare = S.npm_name(F.col("candidate"))
    cand = candidates.select(F.col("name").alias("candidate")).distinct().withColumn("low", F.lower("candidate")).withColumn("bare", bare).filter(F.length("bare") >= 3)
    cand = cand.join(popular.select(F.lower("name").alias("low")).distinct(), "low", "left_anti")
    pop = popular.select(F.col("name").alias("target"), "ord", S.npm_name(F.col("name")).alias("pbare"))
    cand = cand.withColumn("c", S.collapsed_name(F.col("bare"))).withColumn("v", S.visual_name(F.col("c")))
    pop = pop.withColumn("c", S.collapsed_name(F.col("pbare"))).withColumn("v", S.visual_name(F.col("c")))
    scope = cand.filter("low <> bare").join(popular.select(F.col("name").alias("target"), F.lower("name").alias("bare"), "ord"), "bare").select("candidate", "target", F.lit(0).alias("distance"), F.lit("scope-strip").alias("trick"), F.lit(0).alias("class"), F.lit(0).cast("long").alias("ord"))
    same = cand.join(pop.drop("v"), "c").filter("bare <> pbare").select("candidate", "target", F.lit(0).alias("distance"), F.lit("separator-variation").alias("trick"), F.lit(1).alias("class"), F.col("ord").cast("long").alias("ord"))
    seen = cand.join(pop.drop("c"), "v").filter("bare <> pbare").select("candidate", "target", F.lit(0).alias("distance"), F.lit("visual-substitution").alias("trick"), F.lit(1).alias("class"), F.col("ord").cast("long").alias("ord"))
    near = near_names(cand, pop, "bare", "pbare").withColumnsRenamed({"a": "bare", "b": "pbare"}).join(cand.select("candidate", "bare"), "bare").join(pop.select("target", "pbare", "ord"), "pbare")
    near = near.select("candidate", "target", "distance", F.concat(F.lit("edit-distance-"), F.col("distance").cast("string")).alias("trick"), (F.col("distance") + 1).alias("class"), F.col("ord").cast("long").alias("ord"))
    every = scope.unionByName(same).unionByName(seen).unionByName(near)
    best = first_by(every, ["candidate"], "class", "ord", "trick")
    return best.select("candidate", "target", "distance", "trick").withColumn("confidence", S.trick_confidence(F.col("trick")))


def legitimate_extension(a: Column, b: Column) -> Column:
    """Whether one name is the other with - or / and more after it."""
    ext = lambda x, y: F.startswith(x, F.concat(y, F.lit("-"))) | F.startswith(x, F.concat(y, F.lit("/")))
    return ext(a, b) | ext(b, a)


def name_intelligence(packages: DataFrame, popular: DataFrame, known: DataFrame) -> DataFrame:
    """Per package name and target the greatest risk: known typosquat, look-alike letters, distance 1 or 2, both ecosystems."""
    pk = packages.select(F.col("name").alias("n"), "ecosystem").distinct().withColumn("low", F.lower("n"))
    corpus = pk.join(known.select(F.lower("name").alias("low"), "ecosystem", "imitates"), ["low", "ecosystem"]).select("n", "ecosystem", F.col("imitates").alias("target"), F.lit(4).alias("rank"))
    pop = popular.select(F.col("name").alias("target"), "ecosystem", F.lower("name").alias("plow"))
    glyph = pk.withColumn("g", S.homoglyph_name(F.col("n"))).join(pop.withColumn("g", S.homoglyph_name(F.col("target"))), ["g", "ecosystem"]).filter("low <> plow")
    glyph = glyph.select("n", "ecosystem", "target", F.lit(4).alias("rank"))
    met = near_names(pk, pop, "low", "plow").withColumnsRenamed({"a": "low", "b": "plow"})
    near = pk.join(met, "low").join(pop, ["plow", "ecosystem"]).filter(~legitimate_extension(F.col("low"), F.col("plow")))
    near = near.join(glyph.select("n", "ecosystem", "target"), ["n", "ecosystem", "target"], "left_anti").select("n", "ecosystem", "target", F.when(F.col("distance") == 1, 3).otherwise(2).alias("rank"))
    norm = packages.select(S.cross_name(F.col("name")).alias("x"), "ecosystem").distinct()
    both = norm.filter("ecosystem = 'npm'").select("x").intersect(norm.filter("ecosystem = 'pypi'").select("x"))
    cross = pk.withColumn("x", S.cross_name(F.col("n"))).join(both, "x", "left_semi").filter(S.cross_listed_risky(F.col("n"))).select("n", "ecosystem", F.col("n").alias("target"), F.lit(3).alias("rank"))
    every = corpus.unionByName(glyph).unionByName(near).unionByName(cross)
    return every.groupBy(F.col("n").alias("name"), "ecosystem", "target").agg(S.level_of(F.max("rank")).alias("risk_level"))


def malware_matches(packages: DataFrame, malware: DataFrame) -> DataFrame:
    """Malware advisories (name, advisory, ord) of a name: the same one, else the nearest at distance 1 or 2."""
    pk, mal = packages.select("name").distinct(), malware.select(F.col("name").alias("bad"), "advisory", "ord")
    exact = pk.join(mal.withColumn("name", F.col("bad")), "name").select("name", "bad", "advisory", F.lit(0).alias("distance"))
    rest = pk.join(exact.select("name").distinct(), "name", "left_anti")
    near = near_names(rest, mal, "name", "bad").withColumnsRenamed({"a": "name", "b": "bad"}).join(mal, "bad")
    best = first_by(near, ["name"], "distance", "ord").select("name", "bad", "advisory", "distance")
    return exact.unionByName(best)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, common = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                common.append(c)
                break
    if not common:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(common, other, strict=True)) / 2
    m = len(common)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    jaro = _jaro(a, b)
    if jaro < 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity: a prefix of up to four letters counts 0.1 each where Jaro is at least 0.7."""
    return pd.Series([_winkler(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b, strict=True)])


def register(spark) -> None:
    spark.udf.register("jaro_winkler", jaro_winkler)


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer name."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def counted_letters(name: Column) -> Column:
    """The letters of a name, each with the number of its kind before it, the rarer kinds of names first.

    The order is a fixed guess (further repeats first, then letters from the end of RARE_LETTERS); any order gives
    the same pairs.
    """
    letters = F.split(name, "")
    places = F.sequence(F.lit(0), F.greatest(F.size(letters) - 1, F.lit(0)))
    rank = lambda c: F.lpad(F.lit(99) - F.greatest(F.instr(F.lit(RARE_LETTERS), c), F.lit(0)), 2, "0")
    repeat = lambda i: F.size(F.filter(F.slice(letters, F.lit(1), i), lambda x: x == F.get(letters, i)))
    key = F.transform(places, lambda i: F.concat(F.lpad(F.lit(99) - F.least(repeat(i), F.lit(99)), 2, "0"), rank(F.get(letters, i)), F.get(letters, i), repeat(i).cast("string")))
    return F.array_sort(key)


def letters_needed(n: Column, m: Column, share: float) -> Column:
    """The least number of letters in common for which their shares of both lengths sum up to `share`."""
    return F.ceil(share * n * m / (n + m) - 1e-9)


def cross_ecosystem_pairs(packages: DataFrame, least: float = 0.85) -> DataFrame:
    """npm and PyPI names of which either similarity reaches `least`: similarity, score and level.

    No pair is lost.  Jaro is at most a third of the shares of both names' letters that they have in common, plus one
    third, and the prefix of p letters adds a tenth of the rest for each.  So a pair has either four first letters in
    common, or its letters in common make up `share` of its lengths; the edit similarity asks for more.  Names meet
    if they have one of the rarest letters in common, of as many as leave too few for that, length by length.
    """
    share = 3 * (least - 0.3) / 0.7 - 1
    with_prefix = 3 * (least - 0.4) / 0.6 - 1
    names = packages.select("ecosystem", S.cross_name(F.col("base_name")).alias("x")).distinct().filter("length(x) > 0")
    names = names.select("ecosystem", "x", F.length("x").alias("n"), counted_letters(F.col("x")).alias("w"))
    lengths = names.select("n").distinct().agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    names = names.join(F.broadcast(lengths))

    def side(ecosystem: str, name: str, first: bool) -> DataFrame:
        other = F.explode(F.filter("lengths", lambda m: letters_needed(F.col("n"), m, share) <= F.least(F.col("n"), m)))
        own = names.filter(F.col("ecosystem") == ecosystem).select(F.col("x").alias(name), F.col("n"), "w", "lengths")
        by_length = own.select(name, "n", "w", other.alias("m")).select(name, F.explode(F.transform(F.slice("w", F.lit(1), (F.col("n") - letters_needed(F.col("n"), F.col("m"), share) + 1).cast("int")), lambda t: F.concat_ws(":", (F.col("n") if first else F.col("m")).cast("string"), (F.col("m") if first else F.col("n")).cast("string"), t))).alias("k"))
        by_prefix = own.filter("n >= 4").select(name, F.concat(F.lit("^"), F.substring(name, 1, 4)).alias("k"))
        return by_length.unionByName(by_prefix)

    met = side("npm", "a", True).join(side("pypi", "b", False).hint("merge"), "k").select("a", "b").distinct()
    common = F.size(F.array_intersect(counted_letters(F.col("a")), counted_letters(F.col("b"))))
    met = met.filter(common >= letters_needed(F.length("a"), F.length("b"), with_prefix))
    met = met.withColumn("similarity", F.greatest(similarity(F.col("a"), F.col("b")), jaro_winkler("a", "b"))).filter(F.col("similarity") >= least)
    score = F.least(F.lit(1.0), F.col("similarity") * 0.5 + F.when(F.col("a") == F.col("b"), 0.20).otherwise(0.0))
    return met.withColumn("score", F.round(score, 4)).withColumn("similarity", F.round("similarity", 4)).withColumn("level", S.confusion_level(F.col("score")))


def name_audit(found: DataFrame, packages: DataFrame) -> DataFrame:
    """Scanned, risky and clean names, and risky ones by level, per ecosystem."""
    worst = found.groupBy("name", "ecosystem").agg(F.max(S.rank_of(F.col("risk_level"))).alias("rank"))
    joined = packages.select("name", "ecosystem").distinct().join(worst, ["name", "ecosystem"], "left")
    return joined.groupBy("ecosystem").agg(F.count("*").alias("scanned"), F.count("rank").alias("risky"), (F.count("*") - F.count("rank")).alias("clean"), *[F.count_if(F.col("rank") == S.LEVELS.index(v)).alias(v) for v in ("medium", "high", "critical")])
