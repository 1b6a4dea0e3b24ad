"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

A text is cut where the hash of the next TRIGGER bytes is below a bound.  Which bytes start a phrase thus depends on
these bytes alone, so equal strings are cut alike, and no proper suffix of a phrase that is longer than a trigger is the
start of another.  A suffix of the corpus is named by the rest of its phrase (a suffix of the dictionary) and the parse
from the next trigger on; the order of both gives its place in corpus order, where its longest match is a neighbour.

Only suffixes that may match SPAN bytes are put in order.  The string of SPAN bytes at a place belongs to the first
trigger in it, which is up to BEFORE bytes later, so two equal strings agree in the SPAN - BEFORE bytes from there on.
Their digest names the start of the parse suffix, and triggers whose name is unique in the corpus have no repeats.  The
others meet in buckets by that name:

* if all triggers of a bucket have equal contexts (the phrase before them and SPAN bytes after them, by a second
  digest), as in copies, everything around them is repeated;
* else equal contexts are one entry, and a bucket's entries are ordered: the suffix array of its dictionary (the phrases
  before the triggers, read backwards) groups the entries that a place's suffix has in common, the suffix array of its
  parse (the bytes after the name) orders each group, and the least common prefix of neighbours says which places match;
* a bucket of more than LIMIT entries isn't brought together: it is split by the distance before the trigger and what
  strings there must have in common, down to single strings if need be, which are counted by two digests.

Places without a trigger in their first BEFORE bytes are rare but in periodic or very uniform text.  They are compared
by the digests of the whole string; within a document each distinct one is sent once.

A name is 64 bits, and a match needs an equal name and either a second digest of 64 bits or equal bytes.  Rows are kept
by an id of their own, so documents may share doc_id.

Defined results: null is an empty text; texts shorter than SPAN lose nothing and share nothing; repeated rows are
copies of each other and lose all; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import BYTE, STEP, mix, powers

#: Bytes of a repeated string and of a trigger, mean distance of triggers, bytes before a trigger, entries of a bucket.
SPAN, TRIGGER, MEAN, BEFORE, LIMIT = 400, 8, 48, 256, 256
#: Bytes after a trigger that name it, and distances before a trigger in the parts of large buckets.
NAME, WIDTHS = SPAN - BEFORE, (512, 32, 4, 1)
_HASH = np.random.default_rng(12).integers(0, 2**32, 256, dtype=np.uint32)
_STEPS = [np.uint32(0x9E3779B1), np.uint32(0x9E3779B1**2 % 2**32), np.uint32(0x9E3779B1**4 % 2**32)]
#: Two families of digests: a value per byte, powers of an odd number and of its inverse.
_SECOND = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
_BASES = [(BYTE, int(STEP)), (_SECOND, 0xD6E8FEB86659FD93)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both odd numbers and of their inverses, at least n of them."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(1 << 12, 1 << n.bit_length())
        _POWERS[:] = [(powers(size, np.uint64(m)), powers(size, np.uint64(pow(m, -1, 2**64)))) for _, m in _BASES]
    return _POWERS


class Digests:
    """64-bit digests of slices of a byte array, by two families."""

    def __init__(self, a: np.ndarray) -> None:
        self.tables = _tables(len(a) + 1)
        self.sums = [np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values[a] * up[: len(a)]))) for (values, _), (up, _) in zip(_BASES, self.tables, strict=True)]

    def of(self, family: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self.sums[family]
        return mix((total[end] - total[start]) * self.tables[family][1][start] + (end - start).astype(np.uint64))


def triggers(a: np.ndarray) -> np.ndarray:
    """Places whose next TRIGGER bytes start a phrase."""
    if len(a) < TRIGGER:
        return np.empty(0, dtype=np.int64)
    h = _HASH[a]
    for step, m in zip((1, 2, 4), _STEPS, strict=True):
        h = h[:-step] * m + h[step:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.flatnonzero((h ^ (h >> np.uint32(13))) < np.uint32(2**32 // MEAN))


def packed(at: np.ndarray, before: np.ndarray | int, after: np.ndarray | int) -> np.ndarray:
    """A place, and how many bytes before and after it are concerned, as one number."""
    return (np.asarray(at, dtype=np.int64) << 32) | (np.asarray(before, dtype=np.int64) << 22) | np.asarray(after, dtype=np.int64)


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 32, p >> 22 & 0x3FF, p & 0x3FFFFF


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Touching or overlapping intervals as one, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1]) if len(start) else np.empty(0, dtype=bool)
    return start[new], reach[np.append(new[1:], True)] if len(start) else reach


def contexts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, digest of the whole context and packed place of every trigger or place of a text that may start a repeat.

    What repeats within the text away from triggers is said by pairs of rows with a name of their own.
    """
    n = len(a)
    t = triggers(a)
    d = Digests(a)
    before = np.minimum(np.diff(t, prepend=-1) - 1, BEFORE)
    after = np.minimum(SPAN, n - t)
    able = after >= SPAN - before
    at, before, after = t[able], before[able], after[able]
    name = d.of(0, at, at + NAME)
    whole = mix(d.of(1, at - before, at + after) + before.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + after.astype(np.uint64))
    place = packed(at, before, after)
    # places without a near trigger
    last = np.arange(n - SPAN + 1)
    following = np.append(t, n + BEFORE + 1)[np.searchsorted(t, last)]
    bare = last[following - last > BEFORE]
    if len(bare):
        one, two = d.of(0, bare, bare + SPAN), d.of(1, bare, bare + SPAN)
        _, first, times = np.unique(one, return_index=True, return_counts=True)
        _, which = np.unique(one, return_inverse=True)
        often = np.flatnonzero(times > 1)
        sent = np.concatenate((first, first[often]))
        s, e = runs(bare[times[which] > 1], bare[times[which] > 1] + SPAN)
        cut = 1 << 21
        pieces = [(x, min(x + cut, y)) for x, y in zip(s.tolist(), e.tolist(), strict=True) for x in range(x, y, cut)]
        ps, pe = np.array([x for x, _ in pieces], dtype=np.int64), np.array([y for _, y in pieces], dtype=np.int64)
        own = mix(d.of(1, np.zeros(1, dtype=np.int64), np.array([n])) + ps.astype(np.uint64)) if len(ps) else np.empty(0, dtype=np.uint64)
        name = np.concatenate((name, mix(one[sent] + np.uint64(1)), own, own))
        whole = np.concatenate((whole, two[sent], own, own))
        place = np.concatenate((place, packed(bare[sent], 0, SPAN), packed(ps, 0, pe - ps), packed(ps, 0, pe - ps)))
    return name, whole, place


def raw(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, of = [], []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            found.append(contexts(raw(text)))
            of.append((row, len(found[-1][0])))
            if sum(n for _, n in of) > 200_000:
                yield _rows(found, of)
                found, of = [], []
        if found:
            yield _rows(found, of)


def _rows(found: list[tuple[np.ndarray, ...]], of: list[tuple[int, int]]) -> pa.RecordBatch:
    name, whole, place = (np.concatenate([f[i] for f in found]).view(np.int64) for i in range(3))
    row = np.repeat(np.array([r for r, _ in of], dtype=np.int64), [n for _, n in of])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (name, whole, row, place)], names=["name", "whole", "row", "place"])


def _bytes_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before each entry's trigger, backwards, and those behind its name."""
    for batch in batches:
        out: list[tuple] = []
        for row, text, entries in zip(*[batch.column(c).to_pylist() for c in ("row", "bytes", "entries")], strict=True):
            for e in entries:
                at, before, after = e["place"] >> 32, e["place"] >> 22 & 0x3FF, e["place"] & 0x3FFFFF
                out.append((e["name"], row, e["place"], e["times"], text[at - before : at][::-1], text[at + NAME : at + after]))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "row", "place", "times", "left", "right"])


def common_prefixes(strings: list[bytes], order: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Bytes that each string in order has in common with the one before it; -1 where a bucket starts."""
    out = np.full(len(order), -1, dtype=np.int64)
    width = max(map(len, strings), default=0)
    if not width:
        out[1:][bucket[order][1:] == bucket[order][:-1]] = 0
        return out
    sizes = np.array([len(s) for s in strings])
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)[order]
    differ = grid[1:] != grid[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    same = np.minimum(same, np.minimum(sizes[order][1:], sizes[order][:-1]))
    out[1:] = np.where(bucket[order][1:] == bucket[order][:-1], same, -1)
    return out


def matching_places(bucket: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance before its trigger of every place whose SPAN bytes another entry of its bucket has too.

    left: the phrases before the triggers, backwards; right: the bytes behind the names.
    """
    m = len(bucket)
    by_left = np.array(sorted(range(m), key=lambda i: (bucket[i], left[i])), dtype=np.int64)
    by_right = np.array(sorted(range(m), key=lambda i: (bucket[i], right[i])), dtype=np.int64)
    share_left, share_right = common_prefixes(left, by_left, bucket), common_prefixes(right, by_right, bucket)
    place_left, rank = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    place_left[by_left], rank[by_right] = np.arange(m), np.arange(m)
    size_left, size_right = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    # range minima of the parse's common prefixes
    least = [share_right]
    while 2 ** len(least) <= m:
        half = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    from_ = np.maximum(0, SPAN - NAME - size_right)
    entry = np.repeat(np.arange(m), np.maximum(0, size_left - from_ + 1))
    first = np.concatenate(([0], np.cumsum(np.maximum(0, size_left - from_ + 1))[:-1]))
    x = np.arange(len(entry)) - first[entry] + from_[entry]
    # entries that share x bytes before the trigger are neighbours in the dictionary's order
    groups = np.cumsum(share_left[:, None] < np.arange(BEFORE + 1)[None, :], axis=0)
    group = groups[place_left[entry], x]
    order = np.lexsort((rank[entry], group, x))
    e, x, group = entry[order], x[order], group[order]
    lo, hi = rank[e[:-1]] + 1, rank[e[1:]] + 1
    together = (x[1:] == x[:-1]) & (group[1:] == group[:-1])
    lo, hi = lo[together], hi[together]
    level = np.log2(np.maximum(1, hi - lo)).astype(np.int64)
    shared = np.empty(len(lo), dtype=np.int64)
    for k in np.unique(level):
        some = level == k
        shared[some] = np.minimum(least[k][lo[some]], least[k][hi[some] - 2**k])
    match = np.zeros(len(e), dtype=bool)
    pair = np.flatnonzero(together)[shared >= SPAN - NAME - x[1:][together]]
    match[pair] = match[pair + 1] = True
    return e[match], x[match]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and place of what is repeated among a bucket's entries."""
    for batch in batches:
        lists = batch.column("entries")
        at, counts = 0, pc.list_value_length(lists).to_numpy()
        while at < batch.num_rows:
            to = at + max(1, int(np.searchsorted(np.cumsum(counts[at:]), 4096, "right")))
            flat = lists.slice(at, to - at).flatten()
            row, place = (flat.field(c).to_numpy() for c in ("row", "place"))
            left, right = (flat.field(c).to_pylist() for c in ("left", "right"))
            e, x = matching_places(np.repeat(np.arange(to - at), counts[at:to]), left, right)
            order = np.lexsort((-x, e))
            e, where = e[order], (unpacked(place)[0][e] - x)[order]
            new = np.append(True, (e[1:] != e[:-1]) | (where[1:] != where[:-1] + 1))[: len(e)]
            more = np.diff(np.append(np.flatnonzero(new), len(e))) - 1
            yield pa.RecordBatch.from_arrays([pa.array(row[e][new]), pa.array(packed(where[new], 0, SPAN + more))], names=["row", "place"])
            at = to


def _bands(wide: int, width: int):
    """Of every entry's bands of `wide` distances before its trigger, the parts of `width` distances.

    one: a digest of what two entries have in common wherever strings at these distances are equal; whole: of all that
    these strings cover; span: that as a packed place.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, row, place, times, left, right, bands in zip(*[batch.column(c).to_pylist() for c in ("name", "row", "place", "times", "left", "right", "bands")], strict=True):
                n, least = len(left), max(0, SPAN - NAME - len(right))
                near = np.array([x for b in bands for x in range(b, b + wide, width) if x <= n and x + width > least], dtype=np.int64)
                far = np.minimum(near + width - 1, BEFORE)
                d, key = Digests(np.frombuffer(left[::-1] + right, dtype=np.uint8)), np.uint64(name % 2**64)
                one = mix(d.of(0, n - near, n + SPAN - NAME - far) ^ mix(key + near.astype(np.uint64)))
                first, last = np.minimum(far, n), np.maximum(near, least)
                whole = mix(d.of(1, n - first, n + SPAN - NAME - last) ^ mix(key + first.astype(np.uint64) * np.uint64(1 << 10) + last.astype(np.uint64)))
                span = packed((place >> 32) - first, 0, SPAN + first - last)
                out.append((one, whole, np.full(len(near), row), np.full(len(near), place), np.full(len(near), times), near, span))
            columns = [np.concatenate([o[i] for o in out]).view(np.int64) for i in range(7)] if out else [np.empty(0, dtype=np.int64)] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "whole", "row", "place", "times", "band", "span"])

    return cut


def _by_bands(entries: DataFrame) -> DataFrame:
    """row and place of what is repeated among the entries of large buckets, which are split again and again.

    A bucket is split by the distance before the trigger, and by what all strings at such distances cover.  Where all
    entries of a part agree in all that its strings cover, these are repeated; small parts are put in order; the rest
    is split finer, and at one distance a part is one string.  Parts are groups of counts, never brought together.
    """
    hot = saved(entries.withColumn("bands", F.array(F.lit(0).cast("long"))))
    results, wide = hot.filter(F.lit(False)).select("row", "place"), WIDTHS[0]
    for width in WIDTHS[1:]:
        if hot.isEmpty():
            break
        parts = saved(hot.mapInArrow(_bands(wide, width), "one long, whole long, row long, place long, times long, band long, span long"))
        keys = ["one", "whole"] if width == 1 else ["one"]
        counts = parts.groupBy(*keys).agg(F.sum("times").alias("n"), F.count("*").alias("size"), (F.min("whole") == F.max("whole")).alias("same"))
        met = saved(parts.drop("times").join(saved(counts.filter("n > 1").drop("n")).hint("merge"), keys))
        results = results.unionByName(met.filter("same").select("row", F.col("span").alias("place")))
        left = met.filter("not same").select("one", "row", "place", "band", "size")
        few = left.filter(F.col("size") <= LIMIT).join(hot.select("row", "place", "left", "right").hint("merge"), ["row", "place"])
        results = results.unionByName(_in_order(few.withColumnRenamed("one", "name")))
        more = left.filter(F.col("size") > LIMIT).groupBy("row", "place").agg(F.collect_list("band").alias("bands"))
        hot, wide = saved(hot.drop("bands").join(saved(more).hint("merge"), ["row", "place"])), width
    return results


def _in_order(entries: DataFrame) -> DataFrame:
    """row and place of what is repeated among the entries (name, row, place, left, right) of small buckets."""
    buckets = entries.groupBy("name").agg(F.collect_list(F.struct("row", "place", "left", "right")).alias("entries"))
    return buckets.select("entries").mapInArrow(_match, "row long, place long")


def repeated_places(texts: DataFrame) -> DataFrame:
    """row and packed place of what is repeated, overlapping ones too, in texts (row, bytes)."""
    parsed = texts.filter(F.length("bytes") >= SPAN).select("row", "bytes").mapInArrow(_parse, "name long, whole long, row long, place long")
    again = parsed.groupBy("name").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    again = saved(again.filter("n > 1").select("name", (F.col("lo") != F.col("hi")).alias("mixed")))
    met = parsed.join(again.hint("merge"), "name")
    met = saved(met.select(F.when(F.col("mixed"), F.col("name")).alias("name"), F.when(F.col("mixed"), F.col("whole")).alias("whole"), "row", "place"))
    mixed = met.filter("name is not null")
    first = F.min(F.struct("row", "place")).alias("first")
    entries = saved(mixed.groupBy("name", "whole").agg(F.count("*").alias("times"), first).select("name", "whole", "times", "first.row", "first.place"))
    often = entries.filter("times > 1").select("name", "whole")
    equal = mixed.join(often.hint("merge"), ["name", "whole"], "left_semi").select("row", "place")
    per_row = saved(entries.groupBy("row").agg(F.collect_list(F.struct("name", "place", "times")).alias("entries")))
    around = texts.select("row", "bytes").join(per_row.hint("merge"), "row").mapInArrow(_bytes_around, "name long, row long, place long, times long, left binary, right binary")
    sizes = saved(entries.groupBy("name").agg(F.count("*").alias("size")).filter("size > 1"))
    around = saved(around.join(sizes.hint("merge"), "name"))
    ordered = _in_order(around.filter(F.col("size") <= LIMIT))
    split = _by_bands(around.filter(F.col("size") > LIMIT).drop("size"))
    return met.filter("name is null").select("row", "place").unionByName(equal).unionByName(ordered).unionByName(split)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The documents with `row`, their `bytes` and `removed`: the runs of repeated bytes as struct<start, end>, in order."""
    own = [c for c in docs.columns if c not in ("row", "bytes", "removed")]
    texts = saved(docs.select(*own, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes")).drop("text").withColumn("row", F.monotonically_increasing_id()))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for places in batch.column("places"):
                at, before, after = unpacked(places.values.to_numpy())
                s, e = runs(at - before, at + after)
                lists.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["row", "removed"])

    # a document's places are few: triggers are MEAN bytes apart, and its length bounds them
    per_row = repeated_places(texts).groupBy("row").agg(F.collect_set("place").alias("places"))
    found = saved(per_row.mapInArrow(joined, "row long, removed array<struct<start:long,end:long>>"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return texts.join(found.hint("merge"), "row", "left").withColumn("removed", F.coalesce("removed", none))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and `kept`, the bytes that are left, of every row."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, digest = [], []
            for text, spans in zip(batch.column("bytes").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                ends = [0, *[s["end"] for s in spans]]
                left = b"".join(text[a:b] for a, b in zip(ends, [*[s["start"] for s in spans], len(text)], strict=True))
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")], pa.array(digest), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    counted = with_repeats(docs.select("doc_id", "text")).select("doc_id", "bytes", "removed", F.length("bytes").cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"))
    return counted.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
