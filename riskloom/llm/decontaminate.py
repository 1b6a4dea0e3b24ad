"""Benchmark decontamination by winnowing.

A text's k-gram hashes are winnowed: of every w consecutive ones the least is kept.  Two texts that share
w + k - 1 consecutive words keep a common hash, so joining the fingerprints of documents and items finds every
shared span of that length.  Each hit is then extended to the spans of that length around it, which are compared by
their words.  An item shorter than the span is one span by itself (k its length, w 1).

Work is done per distinct text; documents meet their results by a 128-bit key of the text.

Defined results: null or wordless texts have no words, no hits and the checksum of the empty string; repeated rows
each get their row; items with a null id mark words but are not listed; repeated items count once; empty tables give
no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, saved, small_side, text_key

#: The words' separators after lower-casing A-Z, and the span's words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, K = 10, 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), NO_WORD), lambda w: w != "")


def grams(ws: Column, k: int) -> Column:
    """Hashes of all k-grams of a word array; empty if there are fewer words."""
    n = F.size(ws) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.lit(k), *[F.get(ws, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, w: int) -> Column:
    """The distinct least hashes of all windows of w; empty if there are fewer hashes."""
    if w == 1:
        return F.array_distinct(hashes)
    n = F.size(hashes) - w
    return F.when(n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)])))).otherwise(F.array().cast("array<bigint>"))


def configs(lengths: list[int], span: int, k: int) -> list[tuple[int, int, int]]:
    """(span, k, w) for each length of item window."""
    return [(n, k, n - k + 1) if n == span else (n, n, 1) for n in lengths]


def item_windows(items: DataFrame, span: int) -> DataFrame:
    """length, window (its words joined by a space) and the number of the item's word sequence."""
    seqs = items.select(words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).distinct()
    n = F.least(F.size("ws"), F.lit(span))
    starts = F.sequence(F.lit(1), F.size("ws") - n + 1)
    return seqs.select(F.sha2(F.array_join("ws", " "), 256).alias("seq"), n.alias("length"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("ws", i, n), " ")))).alias("window"))


def find_hits(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame | None:
    """k1, k2, start, length and seq of every occurrence of an item window in a distinct text; None without items."""
    windows = saved(item_windows(items, span))
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most `span` numbers
    if not lengths:
        return None
    cfg = configs(sorted(lengths), span, k)

    def hashed(df: DataFrame) -> DataFrame:
        """With the word array and a column of hashes for each length: columns, so that lambdas don't compute them anew."""
        for n, kk, _ in cfg:
            df = df.withColumn(f"h{n}", grams(F.col("ws"), kk))
        return df

    empty = F.array().cast("array<bigint>")
    own = hashed(windows.select(F.split("window", " ").alias("ws"), "length"))
    marks = saved(own.select(F.explode(F.concat(*[F.when(F.col("length") == n, winnow(F.col(f"h{n}"), w)).otherwise(empty) for n, _, w in cfg])).alias("mark")).distinct())
    keyed = docs.filter(F.col("text").isNotNull()).select(*text_key(F.col("text")), "text")
    prints = hashed(keyed.select("k1", "k2", words(F.col("text")).alias("ws"))).select("k1", "k2", F.explode(F.array_distinct(F.concat(*[winnow(F.col(f"h{n}"), w) for n, _, w in cfg]))).alias("mark"))
    found = saved(prints.join(small_side(marks), "mark").groupBy("k1", "k2").agg(F.collect_set("mark").alias("marks")))

    def spans(n: int, w: int) -> Column:
        """struct<start, length, window> of all spans of n words around the hits, in one row."""
        ws, last = F.col("ws"), F.size("ws") - n
        at = F.filter(F.transform(f"h{n}", lambda h, i: F.when(F.array_contains("marks", h), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (w - 1), F.lit(0)), F.greatest(F.least(p, last), F.lit(0))))))
        return F.transform(F.filter(starts, lambda s: s <= last), lambda s: F.struct(s.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(ws, s + 1, n), " ").alias("window")))

    hit = hashed(keyed.join(small_side(found), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "marks", words(F.col("text")).alias("ws")))
    around = hit.select("k1", "k2", F.explode(F.concat(*[spans(n, w) for n, _, w in cfg])).alias("s")).select("k1", "k2", "s.start", "s.length", "s.window")
    return around.join(small_side(windows), ["length", "window"]).select("k1", "k2", "start", "length", "seq")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256 and contaminated."""
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    counted = docs.select(*own, F.size(words(F.col("text"))).cast("long").alias("n_words"), *[c.alias(f"__{i}") for i, c in enumerate(text_key(F.col("text")))])
    hits = find_hits(docs, items, span, k)
    none = F.sha2(F.lit(""), 256)
    if hits is None:
        return counted.drop("__0", "__1").withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": none, "contaminated": F.lit(False)})
    hits = saved(hits)
    end = F.col("start") + F.col("length")
    upto = Window.partitionBy("k1", "k2").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    n_hit = hits.select("k1", "k2", "start", "length").distinct().withColumn("seen", F.coalesce(F.max(end).over(upto), F.lit(0))).groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    ids = items.filter(F.col("item_id").isNotNull()).select(F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("seq"), F.col("item_id").cast("string").alias("item")).distinct()
    listed = hits.select("k1", "k2", "seq").distinct().join(small_side(saved(ids)), "seq").select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    results = n_hit.join(listed, ["k1", "k2"], "left").select(F.col("k1").alias("__0"), F.col("k2").alias("__1"), "n_hit", "n_items", "items_sha256")
    return (
        counted.join(small_side(saved(results)), ["__0", "__1"], "left")
        .drop("__0", "__1")
        .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "n_items": F.coalesce("n_items", F.lit(0)).cast("long"), "items_sha256": F.coalesce("items_sha256", none), "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False))})
    )
