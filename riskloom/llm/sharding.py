"""Hilbert-curve sharding.

Several metadata dimensions are quantised to a few bits each, a Hilbert index orders the cells, and the order is
cut into shards of equal row counts, so each shard's files cover a small box of the dimensions and a reader prunes
files on any of them.

Ranks are exact without a global sort: rows are counted per (cell, sub-bucket), the counts are summed up along the
curve, and rows are numbered inside their sub-bucket only.  A hot cell is spread over SUBS sub-buckets by a hash of
the row.

Source and lang are cut at sixteenths of their rows (approximate percentiles over all of them, of the first six bytes),
in the order of their values, so that a file's least and greatest value bound a narrow range.

Defined results: a null text has size 16 and checksum 0; null lang, source or doc_id fall into bin 0 of their
dimension; equal rows get different slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BITS, DIMS, SUBS, SHARDS = 4, 4, 64, 40


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell with the given int coordinates below 2**bits.

    The transpose form of the curve: the high bits fold the low ones, a Gray code follows, then the coordinates'
    bits are interleaved.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def fold(x: Column, s: Column) -> Column:
        first, own, low = F.get(x, F.lit(0)), F.get(x, s["i"]), s["q"] - F.lit(1)
        is_set = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(is_set, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    def gray(x: Column) -> Column:
        def upto(j: Column) -> Column:
            return F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b))

        flip = F.lit(0)
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(upto(F.lit(n - 1)).bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.transform(x, lambda v, j: upto(j).bitwiseXOR(flip))

    def interleave(x: Column) -> Column:
        order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).alias("q")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(order, F.lit(0), lambda h, s: h * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))

    start = F.array(*[a.cast("int") for a in axes])
    # each step is bound once through a one-element array, so that nothing is evaluated twice
    bound = F.array(F.aggregate(steps, start, fold))
    return F.get(F.transform(F.transform(bound, gray), interleave), F.lit(0))


def prefix_code(value: Column) -> Column:
    """The first six bytes of a text as a number, in the order of the texts."""
    return F.conv(F.rpad(F.hex(F.substring(value.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def edge_bin(code: Column, edges: list[float] | None) -> Column:
    """How many of the edges a number reaches: bins in the order of the values, about equal in rows; null is 0."""
    if not edges:
        return F.lit(0)
    return F.coalesce(sum((code >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def size_bin(size: Column) -> Column:
    """Bit length of the size less 5, within 0 to 15."""
    return F.least(F.lit(15), F.greatest(F.lit(0), F.length(F.bin(size)) - 5))


def range_bin(value: Column, low: int | None, high: int | None, bins: int = 1 << BITS) -> Column:
    """Equal-width bin of an integer between the table's least and greatest value; null is 0."""
    if low is None:
        return F.lit(0)
    width = (high - low) // bins + 1
    return F.coalesce(F.floor((value - F.lit(low)) / F.lit(width)).cast("int"), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard and slot of every row; shard sizes differ by at most one row."""
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    edges = [F.percentile_approx(prefix_code(F.col(c)), shares, 1000) for c in ("source", "lang")]
    low, high, sources, langs = docs.agg(F.min("doc_id"), F.max("doc_id"), *edges).first()
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    narrow = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), "lang", "source")
    rows = saved(
        narrow.select(
            "doc_id",
            "size",
            "text_crc32",
            hilbert_index([edge_bin(prefix_code(F.col("source")), sources), edge_bin(prefix_code(F.col("lang")), langs), size_bin(F.col("size")), range_bin(F.col("doc_id"), low, high)]).alias("hilbert"),
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SUBS)).cast("int").alias("sub"),
        )
    )
    counts = rows.groupBy("hilbert", "sub").agg(F.count("*").alias("n")).withColumn("prefix", F.shiftright("hilbert", 8))
    # at most 256 prefixes of at most 256 cells of SUBS sub-buckets: both windows are bounded whatever the input
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.groupBy("prefix").agg(F.sum("n").alias("m")).select("prefix", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("head"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("prefix").orderBy("hilbert", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("hilbert", "sub", "prefix", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("into")).join(F.broadcast(heads), "prefix").select("hilbert", "sub", (F.col("head") + F.col("into")).alias("first"), "total")
    own = Window.partitionBy("hilbert", "sub").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("at", F.row_number().over(own) - 1).join(starts.hint("merge"), ["hilbert", "sub"]).withColumn("rank", F.col("first") + F.col("at"))
    exact = F.expr(f"(rank * {shards}) div total")
    begin = F.expr(f"((rank * {shards}) div total * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "hilbert", exact.cast("int").alias("shard"), (F.col("rank") - begin).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents as one folder per shard, ordered along the curve; doc_id must be unique here."""
    placed = hilbert_shards(docs, shards).select("doc_id", "shard", "slot")
    docs.join(placed.hint("merge"), "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
