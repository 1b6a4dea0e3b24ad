"""Best-fit packing under conflicts.

Documents are cut into pieces of at most CAPACITY tokens and packed into bins of that size.  Two pieces of one bin
must not share a source or a duplicate cluster.  Pieces are spread by a hash of the document over packing groups of
about GROUP pieces, so that no group grows with the input and a hot source or cluster is dealt evenly; within a
group, longest piece first, the search starts at the bin with the least sufficient residual and goes on to the
successors until one is compatible, and opens a new bin otherwise.  Bins carry their sources and clusters as bitmaps.
Clusters are groups of near-duplicates (near_clusters()), or copies of a text where those were taken out before.

A token is a run of characters other than white space.  A full piece is a bin by itself.  Only keys and lengths are
shuffled, not texts.

Defined results: null texts and those without tokens have no piece and so no row; a null source or cluster conflicts
with nothing; repeated rows with equal ids are packed separately; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import saved, text_key

CAPACITY, GROUP = 2048, 4096
SCHEMA = "doc_id long, piece int, first_token int, n_tokens int, bin_id long, bin_offset int"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order."""
    bit: dict = {}

    def mask(kind: int, value) -> int:
        return 0 if value is None else 1 << bit.setdefault((kind, value), len(bit))

    free: list[tuple[int, int]] = []
    held: list[int] = []
    out = []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        own = mask(0, source) | mask(1, cluster)
        at = bisect_left(free, (n, -1))
        while at < len(free) and held[free[at][1]] & own:
            at += 1
        residual, number = free.pop(at) if at < len(free) else (capacity, len(held))
        if number == len(held):
            held.append(0)
        held[number] |= own
        out.append((number, capacity - residual))
        if residual > n:
            insort(free, (residual - n, number))
    return out


def near_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, source, n (tokens) and cluster of every document: its group of near-duplicates, named by that group's least id.

    Tokens are the words of near-duplicates, so each text is read through once.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "source", "text"), "source")
    return found.select("doc_id", "source", F.col("n_words").alias("n"), F.coalesce("component_id", "k1").alias("cluster"))


def pieces(docs: DataFrame, capacity: int = CAPACITY, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, source, cluster, piece, first_token and n_tokens of every piece; copies of a text are a cluster unless near_clusters() of the documents are given."""
    if clusters is None:
        k1, _ = text_key(F.col("text"))
        clusters = docs.filter(F.col("text").isNotNull()).select("doc_id", "source", k1.alias("cluster"), n_tokens(F.col("text")).alias("n"))
    counted = clusters.filter("n > 0")
    return counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)")))).select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_tokens")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, clusters: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """The bin and offset of every piece of every document; clusters: those of near_clusters(), else copies of a text are one."""
    cut = saved(pieces(docs, capacity, clusters))
    groups = max(1, -(-cut.count() // group))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
        plain = [[None if pd.isna(v) else v for v in rows[c].tolist()] for c in ("source", "cluster")]
        placed = best_fit(rows["n_tokens"].tolist(), *plain, capacity)
        out = rows[["doc_id", "piece", "first_token", "n_tokens"]].assign(bin_id=[int(key[0]) << 32 | b for b, _ in placed], bin_offset=[o for _, o in placed])
        return out.astype({"doc_id": "Int64"})

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(run, SCHEMA)


def bin_texts(docs: DataFrame, packed: DataFrame, separator: str = "\n\n") -> DataFrame:
    """bin_id, doc_ids and text of every bin, pieces in order of their offsets; doc_id must be unique here."""
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("ws"))
    cut = packed.join(words.hint("merge"), "doc_id").select("bin_id", F.struct("bin_offset", "doc_id", F.array_join(F.slice("ws", F.col("first_token") + 1, F.col("n_tokens")), " ").alias("t")).alias("p"))
    held = cut.groupBy("bin_id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # at most CAPACITY tokens
    return held.select("bin_id", F.col("p.doc_id").alias("doc_ids"), F.array_join(F.col("p.t"), separator).alias("text"))
