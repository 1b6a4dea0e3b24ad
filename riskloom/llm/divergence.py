"""Divergence audit of sources within each language, partitioned as a cube.

A language keeps the terms that at least LEAST of its documents hold.  Each of its (lang, source) groups and the
language itself give every kept term a smoothed share p in billionths; the divergence of two of them adds
f = floor((p - q)^2 / (p + q)) over the kept terms.

The pairs are worked out in cells (group block, group block, term block): each group's counts of a term block are
copied to the cells of all group blocks, a cell fills a dense array of its groups' shares, adds up f for its pairs of
groups, and the parts are added along the term axis.  Terms that no group of a cell holds add one number each for a
pair, which is multiplied at the end.  A cell has about 2 * GROUPS groups and TERMS terms, whatever the input.

Counts are added up per task before the shuffle, so a hot source or term is a row a task.

Defined results: null text, lang and source are read as empty; every row is a document of its own, repeated ones too;
groups without terms give every kept term the same share; a language that keeps no term has value 0 for every pair;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_side

#: Documents that a kept term needs, ranks of the term part, groups and terms in a block, entries that a task adds up.
LEAST, TOP, GROUPS, TERMS, ENTRIES = 10, 10, 32, 4096, 200_000
#: Letters in lower case and bytes above 127; all else separates terms.
LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTER).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term of every group, added up while few enough."""
    found: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flushed() -> pa.RecordBatch:
        of = [(*g, t, k, docs[t]) for g, (n, docs) in found.items() for t, k in n.items()]
        found.clear()
        columns = list(zip(*of, strict=True)) or [()] * 5
        kinds = [pa.binary()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

    entries = 0
    for batch in batches:
        for lang, source, text in zip(*[batch.column(c).cast(pa.binary() if c != "text" else pa.large_binary()).to_pylist() for c in ("lang", "source", "text")], strict=True):
            n, docs = found[lang, source]
            entries -= len(n)
            ws = terms(text)
            n.update(ws)
            docs.update(set(ws))
            entries += len(n)
            if entries > ENTRIES:
                yield flushed()
                entries = 0
    yield flushed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) over all rows."""
    parts = docs.select("lang", "source", "text").mapInArrow(_count, "lang binary, source binary, term binary, n long, docs long")
    names = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).select(*names, "n", "docs")


def share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term in billionths, exact for any count."""
    up = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    down = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", up, down))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares, in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(table: pa.Table) -> pa.Table:
    """Sums of f over a cell's terms for each pair of its groups; rows without a term only name a group.

    rest is f of a term that neither has.
    """
    source = table.column("source").combine_chunks().dictionary_encode()
    term = table.column("term").combine_chunks().dictionary_encode()
    s, names = source.indices.to_numpy(), source.dictionary
    t = term.indices.to_numpy(zero_copy_only=False)
    p, bare, block = (table.column(c).to_numpy() for c in ("p", "bare", "block"))
    of, base = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    of[s], base[s] = block, bare
    shares = np.repeat(base[:, None], max(1, len(term.dictionary)), axis=1)
    some = ~np.isnan(t.astype(np.float64))
    shares[s[some], t[some].astype(np.int64)] = p[some]
    present = len(term.dictionary)
    lo, hi = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(of == lo), np.flatnonzero(of == hi)
    a, b, total = [], [], []
    for k, x in enumerate(left):
        others = right[right > x] if lo == hi else right
        d = shares[others] - shares[x]
        a.append(np.full(len(others), x))
        b.append(others)
        total.append((d * d // (shares[others] + shares[x])).sum(axis=1) if present else np.zeros(len(others), dtype=np.int64))
    a, b, total = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (a, b, total))
    n = len(a)
    lang = pa.array([table.column("lang")[0].as_py()] * n, pa.string())
    return pa.table({"lang": lang, "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "rest": (base[a] - base[b]) ** 2 // (base[a] + base[b]), "part": total, "present": np.full(n, present, dtype=np.int64)})


def pair_divergences(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, a, b and value of every unordered pair of sources of a language.

    groups: lang, source, bare (the share of an absent term), kept (terms), blocks, of each group; shares: lang, source,
    term, p of the terms that a group holds.
    """
    many = F.ceil(F.col("kept") / TERMS).cast("int")
    some = groups.filter("kept > 0").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")).withColumn("slices", many)
    held = shares.join(small_side(saved(some)), ["lang", "source"]).withColumn("k", F.pmod(F.xxhash64("term"), F.col("slices").cast("long")).cast("int"))
    named = some.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("k")).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("bare"))
    columns = ["lang", "source", "term", "p", "bare", "block", "blocks", "k"]
    copies = held.select(*columns).unionByName(named.select(*columns)).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    cells = copies.select("lang", "source", "term", "p", "bare", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "k")
    parts = cells.groupBy("lang", "i", "j", "k").applyInArrow(_cell, "lang string, a string, b string, rest long, part long, present long")
    kept = groups.select("lang", "kept").distinct()
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    sums = parts.groupBy("lang", *pair, "rest").agg(F.sum("part").alias("part"), F.sum("present").alias("present"))
    value = F.col("part") + (F.col("kept") - F.col("present")) * F.col("rest")
    found = sums.join(small_side(saved(kept)), "lang").select("lang", "a", "b", value.alias("value"))
    # languages that keep no term: their pairs are the result itself
    none = groups.filter("kept = 0").select("lang", "source")
    zero = none.withColumnRenamed("source", "a").join(none.withColumnRenamed("source", "b").hint("merge"), "lang").filter("a < b")
    return found.unionByName(zero.select("lang", "a", "b", F.lit(0).cast("long").alias("value")))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: every group's divergence from each other source, and its leading terms."""
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = saved(term_counts(named))
    kept = saved(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("d")).filter(F.col("d") >= least).drop("d"))
    held = saved(counts.join(kept.hint("merge"), ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = saved(kept.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count("*").alias("kept")))
    every = saved(named.select("lang", "source").distinct())
    sizes = saved(every.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).cast("long").alias("blocks")))
    groups = every.join(small_side(saved(totals)), ["lang", "source"], "left").join(small_side(langs), "lang", "left").join(small_side(sizes), "lang")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "total_lang", "kept")]
    groups = groups.select("lang", "source", "blocks", *filled)
    groups = saved(groups.withColumn("bare", share(F.lit(0), F.col("total"), F.col("kept"))))
    each = held.join(small_side(groups.drop("bare", "blocks")), ["lang", "source"])
    shares = saved(each.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q")))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    leading = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    leading = leading.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    pairs = saved(pair_divergences(groups.select("lang", "source", "bare", "kept", "blocks"), shares.select("lang", "source", "term", "p")))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = both.withColumn("rank", F.row_number().over(first)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return ranked.unionByName(leading)
