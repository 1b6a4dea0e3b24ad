"""Substring deduplication by content-defined chunks.

A gear hash of the last CONTEXT bytes is taken at every byte; the least one of each WINDOW places (the rightmost of
equal ones) ends a chunk.  A chunk's digest covers the CONTEXT bytes before it too.  Chunks are counted by digest over
all documents; the first document (by id, then position) owns a chunk.  Neighbouring chunks that other documents
share make a span; spans of at least MIN_SPAN bytes are reported, and removed wherever the document isn't the owner.

A passage of over 50 words is never lost.  Ends depend on WINDOW places around them only, so within a passage that two
documents share all ends from the first window's to the last window's agree: fewer than WINDOW bytes are lost at
either end, and 2 * WINDOW + CONTEXT - 1 = 101 bytes, the least that 51 words have, hold a whole chunk.  Where 51 words
are shorter than MIN_SPAN and both losses together, the spans that touch them are seeds only: all windows of 51 words
around them are compared by digest, whichever documents hold them.

Two passes over the text: digests are pre-aggregated before their shuffle, and only repeated ones are joined back.  A
third one reads the documents with seeds in such short words.

Defined results: null and empty texts have no chunks and keep their text; repeated rows with equal id and text share
one result and are never removed against each other; rows with a null id come first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_side, text_key
from .tokens import BYTE, SPACE, STEP, mix, powers

CONTEXT, WINDOW, MIN_SPAN, WORDS = 16, 43, 112, 51
MAX = WINDOW + CONTEXT - 1
GEAR = np.random.default_rng(41).integers(0, 2**16, 256, dtype=np.uint16)
_UNSTEP = np.uint64(pow(int(STEP), -1, 2**64))
_tables = [powers(1 << 12), powers(1 << 12, _UNSTEP)]


def gear(a: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: older bytes are shifted out."""
    h = GEAR[a]
    for shift in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[shift:] = h[:-shift] << np.uint16(shift)
        h = h + older
    return h


def cuts(a: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array: the least hash of every WINDOW places, at most MAX bytes apart."""
    n = len(a)
    if n < MAX:
        return np.array([n] if n else [], dtype=np.int64)
    least, reach = (gear(a)[CONTEXT - 1 :].astype(np.int64) << 32) - np.arange(CONTEXT - 1, n), 1
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    end = (-least & 0xFFFFFFFF) + 1
    end = end[np.diff(end, prepend=0) > 0]
    return end if end[-1] == n else np.append(end, n)


def digests(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of slices of a byte array, which may overlap."""
    if len(a) > len(_tables[0]):
        size = 1 << len(a).bit_length()
        _tables[:] = powers(size), powers(size, _UNSTEP)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(BYTE[a] * _tables[0][: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * _tables[1][start] + (end - start).astype(np.uint64)).view(np.int64)


def word_windows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of WORDS words of a byte array."""
    inside = ~SPACE[a]
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    first = np.concatenate(([0], first)) if inside[0] else first
    last = np.append(last, len(a)) if inside[-1] else last
    return first[: max(0, len(first) - WORDS + 1)], last[WORDS - 1 :]


def raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def chunks(text: str, short: int = MIN_SPAN + 2 * WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and digest of each chunk of the text's UTF-8 bytes, and whether WORDS words of fewer than `short` bytes touch it.

    Equal neighbours, as in a run of one character, are one chunk.
    """
    a = raw(text)
    if not len(a):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    end = cuts(a)
    start = np.concatenate(([0], end[:-1]))
    digest = digests(a, np.maximum(0, start - CONTEXT), end)
    new = np.diff(digest, prepend=~digest[0]) != 0
    start, end, digest = start[new], np.append(start[new][1:], len(a)), digest[new]
    dense = np.zeros(len(start), dtype=np.int64)
    first, last = word_windows(a)
    few = last - first < short
    if few.any():
        covered = np.cumsum(np.bincount(first[few], minlength=len(a) + 1) - np.bincount(last[few], minlength=len(a) + 1)) > 0
        before = np.concatenate(([0], np.cumsum(covered)))
        dense = (before[end] > before[start]).astype(np.int64)
    return start, end - start, digest, dense


def _row() -> Column:
    """A document is named by its id and text: it counts once for each digest however often that occurs in it."""
    return F.xxhash64("doc_id", *text_key(F.col("text"))).alias("row")


def _repeated(found: DataFrame) -> DataFrame:
    """Digests that at least two documents hold, and the least id of these."""
    totals = found.groupBy("digest").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.min("id").alias("owner"))
    return saved(totals.filter("lo < hi").select("digest", "owner"))


def _shared(found: DataFrame) -> DataFrame:
    """The found slices whose digest at least two documents hold, with `later`: an earlier document holds it."""
    return found.join(small_side(_repeated(found.select("digest", "row", "id"))), "digest").withColumn("later", F.col("id") > F.col("owner")).drop("digest", "id", "owner")


def _word_matches(keyed: DataFrame, seeds: DataFrame, short: int) -> DataFrame:
    """Row, start, end and `later` of all windows of WORDS words of fewer than `short` bytes that are near seeds and that another document holds."""
    places = saved(seeds.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("seeds")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, id_, text, near in zip(*[batch.column(c).to_pylist() for c in ("row", "id", "text", "seeds")], strict=True):
                a = raw(text)
                first, last = word_windows(a)
                keep = np.zeros(len(first) + 1, dtype=np.int64)
                for s in near:
                    i, j = np.searchsorted(first, s["start"] - CONTEXT - WINDOW), np.searchsorted(last, s["end"] + WINDOW, "right")
                    if i < j:
                        keep[i] += 1
                        keep[j] -= 1
                keep = (np.cumsum(keep)[:-1] > 0) & (last - first < short)
                first, last = first[keep], last[keep]
                columns = [np.full(len(first), row), np.full(len(first), id_), first, last, digests(a, first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "id", "start", "end", "digest"])

    met = keyed.join(small_side(places), "row").select("row", "id", "text", "seeds")
    return _shared(met.mapInArrow(windows, "row long, id long, start long, end long, digest long"))


def substring_duplicates(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Per row (named by _row): both lists of struct<start, end> in bytes, of the shared and of the removed spans."""
    short = min_span + 2 * WINDOW

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [chunks(t.as_py(), short) for t in part.column("text")]
                of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                start, length, digest, dense = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(4))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(of) for c in ("row", "id")], pa.array(start << 32 | length << 1 | dense), pa.array(digest)], names=["row", "id", "at", "digest"])

    keyed = docs.filter(F.col("text").isNotNull()).select(_row(), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "text")
    shared = _shared(keyed.mapInArrow(cut, "row long, id long, at long, digest long")).distinct()
    start, length = F.shiftright("at", 32), F.shiftright(F.col("at").bitwiseAND(0xFFFFFFFF), 1)
    shared = saved(shared.select("row", start.alias("start"), (start + length).alias("end"), (F.col("at") % 2 == 1).alias("dense"), "later"))
    per = Window.partitionBy("row").orderBy("start")

    def runs(parts: DataFrame) -> DataFrame:
        """Touching or overlapping parts as one."""
        reach = F.max("end").over(per.rowsBetween(Window.unboundedPreceding, -1))
        new = F.coalesce((reach < F.col("start")).cast("int"), F.lit(1))
        run = F.sum("new").over(per.rowsBetween(Window.unboundedPreceding, 0))
        return parts.withColumn("new", new).withColumn("run", run).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("dense").alias("dense")).drop("run")

    seeds = saved(runs(shared).filter("dense"))
    words = saved(_word_matches(keyed, seeds, short).distinct()) if seeds.limit(1).count() else None

    def spans(chosen: Column, name: str) -> DataFrame:
        """Runs of at least min_span bytes and the repeated words, listed per row."""
        from_context = F.greatest(F.lit(0).cast("long"), F.col("start") - CONTEXT).alias("start")
        parts = runs(shared.filter(chosen)).select("row", from_context, "end", "dense").filter(F.col("end") - F.col("start") >= min_span)
        if words:
            parts = parts.unionByName(words.filter(chosen).select("row", "start", "end", F.lit(True).alias("dense")))
        return runs(parts).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))

    return spans(F.lit(True), "shared").join(spans(F.col("later"), "removed").hint("merge"), "row", "full")


def with_spans(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """The documents with `shared` and `removed`: spans of bytes that other documents hold too, and those of them that an earlier document owns."""
    found = saved(substring_duplicates(docs, min_span).select(F.col("row").alias("__r"), "shared", "removed"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    keyed = docs.drop("shared", "removed").withColumn("__row", _row())
    out = keyed.join(small_side(found), F.col("__row") == F.col("__r"), "left")
    return out.drop("__row", "__r").withColumns({"shared": F.coalesce("shared", none), "removed": F.coalesce("removed", none)})


def deduplicated(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """The documents with the removed spans taken out of their text; bytes of a cut character go with the span."""
    kept = with_spans(docs, min_span)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans in zip(b.column("text").to_pylist(), b.column("removed").to_pylist(), strict=True):
                if spans:
                    raw, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
                    for s in spans:
                        parts.append(raw[at : s["start"]].decode("utf-8", "ignore"))
                        at = s["end"]
                    t = "".join([*parts, raw[at:].decode("utf-8", "ignore")])
                texts.append(t)
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return kept.mapInArrow(strip, kept.schema)
