"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

One hash of each shingle picks its bin and its value; a bin keeps its least value, and an empty bin takes that of the
first filled bin in a fixed random order of its own.  BANDS bands of ROWS bins become buckets.  At a similarity of
0.75 a pair misses all buckets with a probability of about 5e-6.

Candidates are compared by a sketch first, one bit of each of the BINS values, of which a pair at 0.75 differs in 16
on average and in more than DIFFER with a probability of about 5e-6; the rest are confirmed on the full sets.

Copies (equal shingle sets) are one node.  In a round, each bucket's centres are compared with the members of other
components only, which are stars; links are confirmed on the full sets, components are contracted, buckets that lie
within one component are done, and the compared centres leave.  The rounds go on, with more centres each time,
until no bucket is left, so that no candidate pair between components goes unchecked although a linked group of n
copies costs n comparisons.  A pair meets in its first common bucket only.

A large group of copies that are alike but mostly not linked would cost n * n there.  After the first round its members
are therefore split by shingles: a pair either has a rare shingle in common, and is found by a join on these, or it
has only common ones, of which most members have too few to be linked with anything.  Both bounds are exact.  If what is
left then can be compared with each other for at most DIRECT comparisons a member on average, one round does that.

A node is named by 64 bits of its set's digest.

Defined results: documents without words have an empty set, link with nothing and are kept; component_id is null only
if all documents of a group have a null doc_id, and kept compares null-safely; repeated rows share their result; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_side, text_key
from .graph import components
from .tokens import mix, shingle_set, shingle_sets

BINS, BANDS, ROWS, SHINGLE, PERCENT, CENTRES, DIFFER, RARE = 128, 32, 4, 5, 75, 64, 34, 8
#: Comparisons by sketch a member on average, and members of the largest bucket, up to which all members are centres.
DIRECT, LARGEST = 1024, 4096
#: Bytes of the texts that are signed at once.
TOGETHER = 1 << 18
#: Each bin's own random order of all bins, itself first.
ORDER = np.stack([np.concatenate(([i], np.random.default_rng(977 + i).permutation(np.delete(np.arange(BINS), i)))) for i in range(BINS)])
_BIN = np.arange(BINS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_WEIGHT = np.random.default_rng(5).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The BINS values of each of several sorted, non-empty sets of hashes, given one after the other."""
    of, bins = np.repeat(np.arange(len(sizes)), sizes), (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (bins[1:] != bins[:-1])))
    value, filled = np.zeros((len(sizes), BINS), dtype=np.uint64), np.zeros((len(sizes), BINS), dtype=bool)
    value[of[first], bins[first]], filled[of[first], bins[first]] = hashes[first], True
    s, b = np.nonzero(~filled)
    for i in range(1, BINS):
        if not len(s):
            break
        source = ORDER[b, i]
        hit = filled[s, source]
        value[s[hit], b[hit]] = value[s[hit], source[hit]]
        s, b = s[~hit], b[~hit]
    return value


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of the signatures."""
    total = (values.reshape(-1, BANDS, ROWS) * _WEIGHT).sum(axis=2, dtype=np.uint64)
    return mix(total + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def sketches(values: np.ndarray) -> np.ndarray:
    """A bit of each value of the signatures, which depends on its bin, as two 64-bit numbers a signature."""
    bits = mix(values + _BIN) & np.uint64(1)
    return (bits.reshape(-1, 2, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # as many texts at once as their bytes stay in a cache
        bounds = np.flatnonzero(np.diff(np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER, prepend=-1))
        for at, to in zip(bounds.tolist(), [*bounds[1:].tolist(), batch.num_rows], strict=True):
            part = batch.slice(at, to - at)
            hashes, sizes, words = shingle_sets(part.column("text").to_pylist(), SHINGLE)
            some = sizes > 0
            values = signatures(hashes, sizes[some])
            ends = np.cumsum(sizes).tolist()
            node = [xxhash.xxh3_64_intdigest(hashes[e - n : e].tobytes()) - 2**63 if n else None for n, e in zip(sizes.tolist(), ends, strict=True)]
            rank, two = np.cumsum(some) - some, np.zeros((2, len(sizes)), dtype=np.int64)
            two[:, some] = sketches(values).T
            buckets = pa.ListArray.from_arrays(pa.array(np.append(rank, some.sum()) * BANDS, pa.int32()), pa.array(bands(values).ravel()), mask=pa.array(~some))
            keep = [c for c in part.schema.names if c != "text"]
            columns = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), buckets, pa.array(two[0], mask=~some), pa.array(two[1], mask=~some)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *columns], names=[*keep, "n_words", "n_shingles", "node", "bands", "s1", "s2"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [shingle_set(t.as_py(), SHINGLE).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "items"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have at least PERCENT of their union in common."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia")).hint("merge")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib")).hint("merge")
    possible = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    common = F.when(possible, F.size(F.array_intersect("ia", "ib"))).otherwise(0)
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", common.alias("common"))
    return both.filter(100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def alike(c1: str, c2: str) -> Column:
    """Whether a node (s1, s2, n) and a centre may be linked, by their sketches."""
    return F.bit_count(F.col("s1").bitwiseXOR(F.col(c1))) + F.bit_count(F.col("s2").bitwiseXOR(F.col(c2))) <= DIFFER


def first_shared(bands: str, other: str, band: str) -> Column:
    """Whether a band is the first that two nodes have in common, so that a pair meets in one bucket only."""
    return F.array_position(F.zip_with(bands, other, lambda x, y: x == y), True) == F.col(band) + 1


def enough(least: Column, n: str, m: str) -> Column:
    """Whether sets of n and m shingles can be linked if they have no more than `least` in common."""
    return (100 + PERCENT) * least >= PERCENT * (F.col(n) + F.col(m))


def pairs_of(star: DataFrame) -> DataFrame:
    return star.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after further links, by the components of the labels that they connect."""
    if links.isEmpty():
        return labels
    known = labels.hint("merge")
    ends = links.join(known.withColumnsRenamed({"node": "a", "label": "la"}), "a", "left").join(known.withColumnsRenamed({"node": "b", "label": "lb"}), "b", "left")
    ends = saved(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    merged = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    fresh = ends.select(F.col("a").alias("node"), F.col("la").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("lb").alias("label")))
    every = labels.unionByName(fresh).distinct()
    return saved(every.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")).hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def stars(members: DataFrame, centres: DataFrame) -> DataFrame:
    """The pairs of members (h, band, node, n, k, s1, s2, bands, label) and centres (h, c) of one bucket that may be linked."""
    meet = members.join(centres.hint("merge"), "h").filter((F.col("label") != F.col("c.label")) & enough(F.least("k", "c.k"), "n", "c.n") & alike("c.s1", "c.s2"))
    return meet.filter(first_shared("bands", "c.bands", "band")).select("node", F.col("c.node").alias("c"))


def centres_of(members: DataFrame, *keys: str) -> DataFrame:
    """The member of highest score for each of the keys, as a struct c."""
    return members.groupBy(*keys).agg(F.max(F.struct("score", "node", "n", "k", "s1", "s2", "bands", "label")).alias("c"))


def undone(members: DataFrame) -> DataFrame:
    """Members that may be linked with one of another component in their bucket, and the bucket's size."""
    whole = members.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.count("*").alias("size"))
    return members.join(whole.filter("lo < hi").hint("merge"), "h").filter(enough(F.col("k"), "n", "least")).drop("lo", "hi", "least")


def by_rare_shingles(nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes (node, label) that may be linked and have a rare shingle in common; k, the common ones of each node.

    A shingle is rare if 2 to RARE of the nodes have it.  A pair that has none in common has at most the lesser k in
    common, which rules most members of a large loose group out for all others at once.
    """
    own = nodes.join(sets.hint("merge"), "node")
    tokens = saved(own.select("node", "label", "n", F.explode("items").alias("item")))
    known = saved(tokens.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1"))
    common = tokens.select("node", "item").join(known.filter(F.col("df") > RARE).select("item").hint("merge"), "item").groupBy("node").agg(F.count("*").alias("k"))
    k = saved(nodes.select("node").join(common.hint("merge"), "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k")))
    rare = tokens.join(known.filter(F.col("df") <= RARE).select("item").hint("merge"), "item")
    left = rare.select("item", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
    right = rare.select("item", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    met = left.join(right.hint("merge"), "item").filter("a < b and la <> lb").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    met = met.join(k.withColumnsRenamed({"node": "a", "k": "ka"}).hint("merge"), "a").join(k.withColumnsRenamed({"node": "b", "k": "kb"}).hint("merge"), "b")
    return met.filter(enough(F.least("ka", "kb") + F.col("shared"), "na", "nb")).select("a", "b"), k


def star_components(buckets: DataFrame, sets: DataFrame) -> DataFrame | None:
    """node and label of the linked nodes in buckets (h, band, node, n, score, s1, s2, bands); None if there are no buckets.

    The first round has one centre a bucket, its member of highest score.  What isn't one component then is ruled out
    by its shingles where possible; the rest is compared in one round where DIRECT and LARGEST allow it, else in rounds
    of CENTRES centres and eight times as many each time.
    """
    if buckets.isEmpty():
        return None
    every = buckets.withColumn("k", F.col("n")).withColumn("label", F.col("node"))
    centres = saved(centres_of(every, "h"))
    labels = saved(components(linked(pairs_of(stars(every, centres)), sets)))

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))

    rest = every.drop("label").join(centres.select("h", F.col("c.node").alias("node")).hint("merge"), ["h", "node"], "left_anti")
    rest = saved(undone(labelled(rest)).drop("size", "label", "k"))
    if rest.isEmpty():
        return labels
    pairs, k = by_rare_shingles(saved(labelled(rest.select("node").distinct())), sets)
    labels = relabelled(labels, saved(linked(pairs, sets)))
    rest, many = rest.join(k.hint("merge"), "node"), CENTRES
    while True:
        rest = saved(undone(labelled(rest)))
        rows, met, largest = rest.agg(F.count("*"), F.sum("size"), F.max("size")).first()
        if not rows:
            return labels
        if met <= DIRECT * rows and largest <= LARGEST:
            centres = rest.select("h", F.struct("node", "n", "k", "s1", "s2", "bands", "label").alias("c"))
            pairs = stars(rest, centres).filter("node < c").withColumnsRenamed({"node": "a", "c": "b"})
            return relabelled(labels, saved(linked(pairs, sets)))
        rest = rest.withColumn("salt", F.when(F.col("size") <= many, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(many))))
        centres = saved(centres_of(rest, "h", "salt").drop("salt"))
        labels = relabelled(labels, saved(linked(pairs_of(stars(rest, centres)), sets)))
        rest = rest.drop("salt", "size", "label").join(centres.select("h", F.col("c.node").alias("node")).hint("merge"), ["h", "node"], "left_anti")
        many *= 8


def near_duplicates(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, k1, k2 (of the text), other columns that are named, n_words, n_shingles, component_id and kept of every row."""
    keyed = docs.select("doc_id", *text_key(F.col("text")), *others, "text")
    found = (("n_words", T.LongType()), ("n_shingles", T.LongType()), ("node", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("s1", T.LongType()), ("s2", T.LongType()))
    told = T.StructType([*[f for f in keyed.schema if f.name != "text"], *[T.StructField(*f) for f in found]])
    signed = saved(keyed.mapInArrow(_sign, told))
    keyed = keyed.drop(*others)
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r")
    one = [F.first(c).alias(c) for c in ("s1", "s2", "n_shingles", "bands")]
    classes = saved(signed.filter("node is not null").groupBy("node").agg(own, *one).select("node", F.col("r.doc_id").alias("cid"), "r.k1", "r.k2", "s1", "s2", F.col("n_shingles").alias("n"), "bands"))
    each = classes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = each.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    found = saved(each.join(small_side(saved(shared)), "h"))
    # a node in large buckets is close to many: a good centre
    score = found.groupBy("node").agg(F.sum("size").alias("score"))
    buckets = saved(found.select("h", "band", "node").join(classes.select("node", "n", "s1", "s2", "bands").join(score.hint("merge"), "node").hint("merge"), "node"))
    reps = saved(classes.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi"))
    by_text = small_side(reps.select("node", F.col("cid"), F.col("k1").alias("r1"), F.col("k2").alias("r2")))
    chosen = keyed.join(by_text, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("cid"))).select("node", "text").dropDuplicates(["node"])
    sets = saved(chosen.mapInArrow(_sets, "node long, n long, items array<long>"))
    labels = star_components(buckets, sets)
    if labels is None:
        found = classes.select("node", F.col("cid").alias("component_id"))
    else:
        named = saved(classes.select("node", "cid").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
        least = named.groupBy("label").agg(F.min("cid").alias("component_id"))
        found = named.join(least.hint("merge"), "label").select("node", "component_id")
    out = signed.drop("bands", "s1", "s2").join(found.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k1", "k2", *others, "n_words", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The kept documents, with all their columns."""
    gone = saved(near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__d"), F.col("k1").alias("__1"), F.col("k2").alias("__2")).distinct())
    k1, k2 = text_key(F.col("text"))
    keyed = docs.withColumn("__k1", k1).withColumn("__k2", k2)
    return keyed.join(small_side(gone), (F.col("__k1") == F.col("__1")) & (F.col("__k2") == F.col("__2")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti").select(*docs.columns)
