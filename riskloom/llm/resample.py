"""Resampling of documents towards a target distribution by hashed n-gram importance weights.

A feature is a run of words, its bucket the CRC-32 of its bytes modulo BUCKETS.  The checksum is linear but for a
constant of the length: a byte adds a value that depends on it and on its distance from the feature's end only.  These
values are read from a table of TABLE distances and folded with one exclusive-or over each feature; features longer
than the table are folded in blocks of that size from their end, each moved on by a block's zero bytes.

Buckets are counted over all documents and all target texts, each task adding up its own first; the gains are
BUCKETS numbers, whatever the input.  A document's weight is the floored mean of its features' gains, its score adds
Gumbel noise that depends on doc_id, and the highest scores are drawn without replacement.  Exact ranks come from a
count of documents per score: scores are whole numbers within fixed limits (SCORES), so that table stays small, and
only documents at or above the last drawn score are ordered, each score by itself.

Defined results: null or wordless texts have no features and weight 0; a null doc_id counts as an empty string in the
noise and comes last among equal scores; repeated rows are drawn one by one; without target texts all gains follow
from T = 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_side
from .tokens import LOWER

#: Defaults: buckets, words a feature has at most, words a document needs, percent drawn, seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Distances in the table, and bytes of text that are treated at once.
TABLE, PIECE = 64, 4_000_000
#: Scores lie within +-SCORES: 1000 times the logarithm of a ratio of counts below 2 ** 63, and the noise.
SCORES = 120_000
WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _table() -> np.ndarray:
    """Checksum register of a byte at each distance from the end, from an empty register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    rows = [t]
    for _ in range(TABLE - 1):
        rows.append((rows[-1] >> 8) ^ t[rows[-1] & 255])
    return np.stack(rows)


CONTRIBUTION = _table()


def _advance() -> np.ndarray:
    """A register moved on by TABLE zero bytes, by each of its four bytes."""
    x = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(TABLE):
        x = (x >> 8) ^ CONTRIBUTION[0][x & 255]
    return x


ADVANCE = _advance()


def moved(x: np.ndarray) -> np.ndarray:
    return ADVANCE[0][x & 255] ^ ADVANCE[1][x >> 8 & 255] ^ ADVANCE[2][x >> 16 & 255] ^ ADVANCE[3][x >> 24]


def span_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of non-empty spans of a byte array, which may overlap."""
    if not len(start):
        return np.empty(0, dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    left = np.repeat(length, length) - 1 - place
    values = CONTRIBUTION[left % TABLE, data[np.repeat(start, length) + place]]
    blocks = -(-length // TABLE)
    if int(blocks.max()) == 1:
        out = np.bitwise_xor.reduceat(values, first)
    else:
        new = (place == 0) | (left % TABLE == TABLE - 1)
        folded = np.bitwise_xor.reduceat(values, np.flatnonzero(new))
        at = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        out = folded[at]
        for k in range(1, int(blocks.max())):
            more = np.flatnonzero(blocks > k)
            out[more] = moved(out[more]) ^ folded[at[more] + k]
    sizes, which = np.unique(length, return_inverse=True)
    return out ^ np.array([zlib.crc32(bytes(int(n))) for n in sizes], dtype=np.uint32)[which]


def features(texts: list[bytes | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of some texts, and the words of each text."""
    a = LOWER[np.frombuffer(b"\0".join([t or b"" for t in texts]), dtype=np.uint8)]
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    inside = WORD[a]
    before = np.concatenate(([False], inside))[:-1]
    doc = np.searchsorted(ends, np.flatnonzero(inside & ~before), "right")
    # one separator after each word
    a = np.where(inside, a, np.uint8(0x20))[inside | before]
    inside = a != 0x20
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside))[:-1])
    end = np.flatnonzero(inside & ~np.append(inside, False)[1:]) + 1
    found, of = [], []
    for n in range(1, longest + 1):
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        s, e = start[: len(whole)][whole], end[n - 1 :][whole]
        found.append(span_crcs(a, s, e - s) % np.uint32(buckets))
        of.append(doc[: len(whole)][whole])
    return np.concatenate(found).astype(np.int64), np.concatenate(of), np.bincount(doc, minlength=len(texts))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about PIECE bytes of text, or one row."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size > PIECE or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, its features in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, part in _pieces(batches):
            total += np.bincount(features(part, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; the driver gets `buckets` numbers."""
    own = bucket_counts(docs, longest, buckets).withColumnRenamed("n", "s")
    theirs = bucket_counts(target, longest, buckets).withColumnRenamed("n", "t")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in own.join(theirs.hint("merge"), "bucket", "full").collect():
        s[r.bucket], t[r.bucket] = r.s or 0, r.t or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _pieces(batches):
            bucket, doc, words = features(texts, longest, len(gain))
            n = np.bincount(doc, minlength=len(texts))
            total = np.bincount(doc, weights=gain[bucket], minlength=len(texts)).astype(np.int64)  # whole numbers below 2 ** 53
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (words, n, total // np.maximum(n, 1))]], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row."""
    weights = weighted(docs, gains(docs, target, longest, buckets), longest)
    scored = saved(weights.withColumn("score", F.col("weight") + noise(seed)))
    able = F.col("n_words") >= least_words
    # at most 2 * SCORES rows, so one task may add them up
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = saved(counts.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), "n"))
    drawn = places.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * percent / 100).cast("long")).first()[0]
    places = saved(places.filter(F.col("before") < drawn).select("score", "before"))
    last = places.agg(F.min("score")).first()[0]
    chosen = able & (F.col("score") >= last) if last is not None else F.lit(False)
    own = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = scored.filter(chosen).join(small_side(places), "score").withColumn("rank", F.col("before") + F.row_number().over(own))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).drop("n_words")
