"""Joins on containment, version ranges and patterns, each over an index instead of a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import checkpointed

#: Letters of an index entry, levels of range bins (majors from 2 ** LEVELS on share the last bin), patterns in a block.
GROUP, LEVELS, PATTERNS = 3, 20, 500


def letter_groups(text: Column, n: int) -> Column:
    """All distinct groups of n neighbouring letters of a text."""
    last = F.length(text) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(names: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (name, text) of distinct lower-case names and texts where the text contains the name.

    A name is looked up by its rarest group of GROUP letters among the texts (all its letters, if it has fewer), so a
    text is met only by names that have this group in common with it.  The empty name is in every text, and is left to
    the caller.
    """
    sizes = [r[0] for r in names.filter("name <> ''").select(F.least(F.length("name"), F.lit(GROUP)).alias("n")).distinct().collect()]  # at most GROUP numbers
    if not sizes:
        return names.join(texts.limit(0), F.lit(False)).select("name", "text")
    groups = F.concat(*[letter_groups(F.col("text"), n) for n in sorted(sizes)])
    index = checkpointed(texts.select("text", F.explode(groups).alias("g")))
    often = index.groupBy("g").agg(F.count("*").alias("df"))
    own = F.concat(*[F.when(F.least(F.length("name"), F.lit(GROUP)) == n, letter_groups(F.col("name"), n)).otherwise(F.array().cast("array<string>")) for n in sizes])
    asked = checkpointed(names.filter("name <> ''").select("name", F.explode(own).alias("g")))
    # a group that no text has rules its name out
    found = asked.join(often.hint("merge"), "g", "left").groupBy("name").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
    rare = checkpointed(found.filter("df > 0").select("name", "g"))
    return index.join(rare.hint("merge"), "g").filter(F.contains("text", "name")).select("name", "text")


def range_bins(lo: Column, hi: Column) -> Column:
    """Bins (level, number) that together cover the majors from lo to hi once, at most two a level.

    On each level the outermost odd ends are taken as they are, and what is between goes up as pairs.
    """
    a, b = F.least(F.greatest(lo, F.lit(0)), F.lit(2**LEVELS - 1)), F.least(F.greatest(hi, F.lit(0)), F.lit(2**LEVELS - 1))
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.array().cast("array<struct<level:int,bin:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        x, y, none = s["a"], s["b"], F.array().cast("array<struct<level:int,bin:bigint>>")
        here = lambda v: F.array(F.struct(level.cast("int").alias("level"), v.alias("bin")))
        left, right = (x <= y) & (x % 2 == 1), (x <= y) & (y % 2 == 0)
        out = F.concat(s["out"], F.when(left, here(x)).otherwise(none), F.when(right & ~(left & (x == y)), here(y)).otherwise(none))
        up, down = F.when(left, x + 1).otherwise(x), F.when(right, y - 1).otherwise(y)
        done = (x > y) | (up > down)
        return F.struct(F.when(done, F.lit(1)).otherwise(F.shiftright(up, 1)).cast("long").alias("a"), F.when(done, F.lit(0)).otherwise(F.shiftright(down, 1)).cast("long").alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), state, step, lambda s: s["out"])


def version_bins(major: Column) -> Column:
    """The bin of a major on every level."""
    m = F.least(F.greatest(major, F.lit(0)), F.lit(2**LEVELS - 1)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(m / F.pow(F.lit(2.0), k)).cast("long").alias("bin")))


def in_ranges(versions: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version and advisory_id where a range (keys, advisory_id, min_version, max_version) contains the version.

    Both ends count, an absent or unreadable one is open; a version that can't be read is in no range.  Versions meet
    ranges in the one bin that covers their major, so ranges elsewhere aren't compared.
    """
    v = versions.select(*keys, "version", S.lenient_version(F.col("version")).alias("v")).filter("v is not null")
    r = ranges.select(*keys, "advisory_id", S.lenient_version(F.col("min_version")).alias("a"), S.lenient_version(F.col("max_version")).alias("b"))
    v = checkpointed(v.select("*", F.inline(version_bins(F.col("v.major")))))
    r = checkpointed(r.select("*", F.inline(range_bins(F.coalesce("a.major", F.lit(0)), F.coalesce("b.major", F.lit(2**LEVELS))))))
    hit = v.join(r.hint("merge"), [*keys, "level", "bin"]).filter((F.col("a").isNull() | (F.col("v") >= F.col("a"))) & (F.col("b").isNull() | (F.col("v") <= F.col("b"))))
    return hit.select(*keys, "version", "advisory_id")


def product_advisories(dependencies: DataFrame, advisories: DataFrame, products: DataFrame, ranges: DataFrame, as_of: Column, days: int) -> DataFrame:
    """name, version, n_vulns, highest_percentile and has_kev of every dependency (name, version).

    advisories: advisory_id, epss_percentile, kev, ingested_at, those within `days` of as_of count; products:
    advisory_id, cpe; ranges: advisory_id, min_version, max_version.  An advisory matches if it names no product or one
    that contains the name in lower case, and if it has no range or one that contains the version.  Advisories without
    a product are matched per distinct version, those without a range as well are one row for all.
    """
    fresh = checkpointed(advisories.filter(S.is_fresh(F.col("ingested_at"), as_of, days)).select("advisory_id", "epss_percentile", "kev"))
    products = checkpointed(products.join(fresh.select("advisory_id").hint("merge"), "advisory_id", "left_semi").select("advisory_id", F.lower("cpe").alias("text")).distinct())
    ranges = checkpointed(ranges.join(fresh.select("advisory_id").hint("merge"), "advisory_id", "left_semi").distinct())
    ranged = ranges.select("advisory_id").distinct()
    deps = checkpointed(dependencies.select("name", "version").distinct().withColumn("low", F.lower("name")))
    names = deps.select(F.col("low").alias("name")).distinct()
    met = checkpointed(contained(names, products.select("text").distinct()))
    named = met.join(products.hint("merge"), "text").select(F.col("name").alias("low"), "advisory_id").distinct()
    empty = deps.filter("low = ''").select("low").distinct().join(products.select("advisory_id").distinct().withColumn("low", F.lit("")), "low")
    named = checkpointed(named.unionByName(empty.select("low", "advisory_id")))
    versions = deps.select("low", "version").distinct()
    any_version = versions.join(named.join(ranged, "advisory_id", "left_anti").hint("merge"), "low")
    some = in_ranges(versions, named.join(ranges.hint("merge"), "advisory_id"), ["low"])
    bare = fresh.join(products.select("advisory_id").distinct(), "advisory_id", "left_anti")
    score = [F.count("*").alias("n"), F.max("epss_percentile").alias("p"), F.bool_or("kev").alias("k")]
    own = any_version.select("low", "version", "advisory_id").unionByName(some.select("low", "version", "advisory_id")).distinct().join(fresh.hint("merge"), "advisory_id").groupBy("low", "version").agg(*score)
    loose = in_ranges(versions.select("version").distinct(), ranges.join(bare.select("advisory_id").hint("merge"), "advisory_id", "left_semi"), []).distinct()
    loose = loose.join(fresh.hint("merge"), "advisory_id").groupBy("version").agg(*[c.alias(f"l{x}") for c, x in zip((F.count("*"), F.max("epss_percentile"), F.bool_or("kev")), "npk", strict=True)])
    n, p, k = bare.join(ranged, "advisory_id", "left_anti").agg(*score).first()
    x = deps.join(own.hint("merge"), ["low", "version"], "left").join(loose.hint("merge"), "version", "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("ln", F.lit(0)) + F.lit(n)
    highest = F.greatest(F.coalesce("p", F.lit(0.0)), F.coalesce("lp", F.lit(0.0)), F.lit(float(p or 0)))
    kev = F.coalesce("k", F.lit(False)) | F.coalesce("lk", F.lit(False)) | F.lit(bool(k))
    return x.select("name", "version", total.cast("long").alias("n_vulns"), highest.alias("highest_percentile"), kev.alias("has_kev"))


#: What stands for itself in a pattern.
_LITERAL = r"[A-Za-z0-9@/_-]"


def literal_prefixes(pattern: Column) -> Column:
    """The texts of which a match must begin with one; null if the pattern isn't anchored or begins with no literal.

    Read are ^text and ^(text|text)text; a literal before ?, * or { is left off, and alternatives elsewhere make it null.
    """
    plain = F.regexp_extract(pattern, rf"^\^({_LITERAL}+)", 1)
    after = F.substring(pattern, F.length(plain) + 2, F.lit(1))
    cut = F.when(after.isin("?", "*", "{"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)
    group = F.regexp_extract(pattern, rf"^\^\(({_LITERAL}+(?:\|{_LITERAL}+)*)\)(?![?*{{])", 1)
    rest = F.substring(pattern, F.length(group) + 4, F.length(pattern))
    return F.when((cut != "") & ~F.contains(pattern, F.lit("|")), F.array(cut)).when((group != "") & ~F.contains(rest, F.lit("|")), F.split(group, r"\|"))


def _compiles(patterns):
    import re

    def good(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    return patterns.map(good)


def trusted_source(source: Column, trusted: Column) -> Column:
    """Whether a source belongs to one of the trusted scopes and hosts; an unknown source doesn't."""
    src, host = F.lower(source), F.lower(F.try_parse_url(source, F.lit("HOST")))

    def one(d: Column) -> Column:
        d = F.lower(d)
        scope = (src == d) | F.startswith(src, F.concat(d, F.lit("/")))
        at_host = F.when(host.isNotNull(), (host == d) | F.endswith(host, F.concat(F.lit("."), d))).otherwise(scope | F.endswith(src, F.concat(F.lit("."), d)))
        return F.when(F.startswith(d, F.lit("@")), scope).otherwise(at_host)

    return F.coalesce(source.isNotNull() & (source != "") & F.exists(F.coalesce(trusted, F.array().cast("array<string>")), one), F.lit(False))


def _by_rule(packages: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (no, rule, package_id, name) and members (no, rule, org_id, watchlist_id) of rules, as confusion_rules() says; no is one of each rule."""
    patterns = patterns.filter("internal_package_pattern is not null and internal_package_pattern <> ''")
    same = (F.col("pattern") == F.col("internal_package_pattern")) & F.col("d").eqNullSafe(F.col("trusted_domains"))
    rules = patterns.groupBy(F.col("internal_package_pattern").alias("pattern"), F.col("trusted_domains").alias("d")).agg(F.min("watchlist_id").alias("rule"))
    rules = checkpointed(rules.withColumn("no", F.monotonically_increasing_id()))
    members = patterns.join(rules.hint("merge"), same).select("no", "rule", "org_id", "watchlist_id")
    one = rules.select("pattern").distinct()
    one = checkpointed(one.filter(F.pandas_udf(_compiles, "boolean")("pattern")).withColumn("starts", literal_prefixes(F.col("pattern"))))
    names = packages.select("name").distinct()
    anchored = checkpointed(one.filter("starts is not null").select("pattern", F.explode("starts").alias("start")))
    sizes = sorted(r[0] for r in anchored.select(F.length("start")).distinct().collect())  # lengths of literals: a few numbers
    cuts = F.array(*[F.substring("name", 1, n) for n in sizes]) if sizes else F.array().cast("array<string>")
    begun = checkpointed(names.select("name", F.explode(F.array_distinct(cuts)).alias("start")))
    hits = begun.join(anchored.hint("merge"), "start").filter(F.expr("name rlike pattern")).select("name", "pattern")
    loose = checkpointed(one.filter("starts is null").select("pattern", F.row_number().over(Window.orderBy("pattern")).alias("i")))
    for at in range(0, loose.count(), PATTERNS):
        block = F.broadcast(loose.filter(F.col("i").between(at + 1, at + PATTERNS)).select("pattern"))
        hits = hits.unionByName(names.join(block, F.expr("name rlike pattern")).select("name", "pattern"))
    hits = checkpointed(hits.distinct())
    found = packages.select("package_id", "name", "resolved_from").join(hits.hint("merge"), "name").join(rules.hint("merge"), "pattern")
    return found.filter(~trusted_source(F.col("resolved_from"), F.col("d"))).select("no", "rule", "package_id", "name"), members


def confusion_rules(packages: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages (package_id, name, resolved_from) whose name matches a pattern without a trusted source, by rule.

    patterns: org_id, watchlist_id, internal_package_pattern, trusted_domains.  Watchlists of equal pattern and domains are
    one rule, named by the least of them: the hits (rule, package_id, name) are found once a rule, and its members (rule,
    org_id, watchlist_id) are the other table.  Patterns that begin with literals are joined on these, so only names that
    begin alike are tested; the others are counted, and tested against all names in blocks of PATTERNS.  Patterns that
    can't be read match nothing.
    """
    hits, members = _by_rule(packages, patterns)
    return hits.drop("no"), members.drop("no")


#: Hits and watchlists of a rule that meet in a block, rules whose sizes are broadcast, tasks that write blocks.
HITS, MEMBERS, SIZES, TASKS = 1000, 10_000, 200_000, 2000


def confusion_hits(packages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Packages as in confusion_rules() for each watchlist that they hit (org_id, watchlist_id, package_id, name); its rows are pairs.

    Few rules may have most hits and most watchlists.  So a rule's hits are dealt to slots and its watchlists to lists, and
    every slot meets every list in a block: what is shuffled is a row a hit and list and an entry a watchlist and slot,
    and pairs are written where they meet.
    """
    hits, members = [checkpointed(x.drop("rule")) for x in _by_rule(packages, patterns)]
    slots = hits.groupBy("no").agg(F.ceil(F.count("*") / HITS).alias("slots"))
    lists = members.groupBy("no").agg(F.ceil(F.count("*") / MEMBERS).alias("lists"))
    sizes = checkpointed(slots.join(lists.hint("merge"), "no"))
    n, blocks = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("slots") * F.col("lists")), F.lit(1))).first()
    sizes = F.broadcast(sizes) if n <= SIZES else sizes.hint("merge")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = ["no", "slot", "list"]
    hit = hits.join(sizes, "no").select("no", F.pmod(F.xxhash64("package_id", "name"), F.col("slots")).alias("slot"), every("lists").alias("list"), "package_id", "name")
    listed = members.join(sizes, "no").groupBy("no", "slots", F.pmod(F.xxhash64("org_id", "watchlist_id"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct("org_id", "watchlist_id")).alias("of"))
    listed = listed.select("no", every("slots").alias("slot"), "list", "of")
    # numbered, so that few bytes that make many rows aren't put into one task
    tasks = min(blocks, TASKS)
    met = hit.repartition(tasks, *at).join(listed.repartition(tasks, *at).hint("merge"), at)
    return met.select(F.inline("of"), "package_id", "name")


def timestamp_skew(files: DataFrame, keys: list[str], at: str, most: int = 48 * 3600) -> DataFrame:
    """Per release: n_files, max_skew (seconds), n_inconsistent (pairs more than `most` seconds apart) and consistent.

    Files are added up per second first; then each second has the files before it by more than `most` in its range frame,
    so pairs are counted without being made.  With fewer than two times the last three are null.
    """
    second = F.unix_timestamp(at).alias("s")
    each = files.filter(F.col(at).isNotNull()).groupBy(*keys, second).agg(F.count("*").alias("m"))
    before = Window.partitionBy(*keys).orderBy("s").rangeBetween(Window.unboundedPreceding, -most - 1)
    pairs = each.withColumn("pairs", F.col("m") * F.coalesce(F.sum("m").over(before), F.lit(0)))
    found = pairs.groupBy(*keys).agg(F.sum("m").alias("timed"), (F.max("s") - F.min("s")).alias("skew"), F.sum("pairs").alias("pairs"))
    every = files.groupBy(*keys).agg(F.count("*").alias("n_files")).join(found, keys, "left")
    enough = F.coalesce("timed", F.lit(0)) > 1
    return every.select(*keys, "n_files", F.when(enough, F.col("skew")).alias("max_skew"), F.when(enough, F.col("pairs")).alias("n_inconsistent"), F.when(enough, F.col("pairs") == 0).alias("consistent"))
