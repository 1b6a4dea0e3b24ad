"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random lines.  Two vectors collide on a line if one lies in the window around the
other, and pairs with enough collisions are verified by their cosine; the least count is that which a pair at the
threshold reaches with probability COUNT_RECALL.  Counting goes in two steps: on SIDES lines the window is the
query's side, so that a 64-bit sketch counts by bits, and on LINES lines it is WINDOW deviations wide.  A window on a
single line keeps a third of all unrelated pairs or more, so counting alone would be quadratic: pairs are counted
only if they also fall in the same cell (the signs on `bits` further lines) in one of several rounds, with as many
bits as the logarithm of the vectors and as many rounds as give a pair at the threshold CELL_RECALL.

Dense groups don't become pairs: a cell's centre (its least node) takes those within half the threshold's angle into
its ball; by the triangle inequality all members of a ball are linked, and are counted without being listed.  Pairs
are sought between balls only, pruned by the angles between centres and radii.  Equal vectors are one node.

Defined results: a vector that is null, empty, zero or has a null or non-finite component has no links and is its
own component; vectors of different lengths never link; component_id is null only if all ids of a component are;
repeated rows link with each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side
from .graph import components
from .tokens import mix

COSINE, LINES, SIDES, CELL_RECALL, COUNT_RECALL = 0.9, 24, 64, 0.985, 0.995
#: Half-width of a window in standard deviations of a pair at the threshold; slack of the balls' half angle; deviations
#: that a pair's differing sides may exceed their mean by.
WINDOW, SLACK, DEVIATIONS = 1.5, 1e-6, 3.5


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a cell and rounds for n vectors."""
    bits = max(8, math.ceil(math.log2(max(2, n))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - same))


def least_count(recall: float = COUNT_RECALL) -> int:
    """The greatest count of LINES that a pair at the threshold reaches with the given probability."""
    p, total = math.erf(WINDOW / math.sqrt(2)), 0.0
    for c in range(LINES, -1, -1):
        total += math.comb(LINES, c) * p**c * (1 - p) ** (LINES - c)
        if total >= recall:
            return c
    return 0


def sides_differ(a: str, b: str, most: Column) -> Column:
    """Whether two sketches are too far apart for an angle of `most`."""
    p = F.least(most / math.pi, F.lit(1.0))
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) > SIDES * p + DEVIATIONS * F.sqrt(SIDES * p * (1 - p))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def projector(bits: int, rounds: int):
    """A function over Arrow batches: node, unit vector, cells and places on the lines of every row."""

    def lines(dim: int) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(7000 + dim)
        return r.standard_normal((dim, bits * rounds)), r.standard_normal((dim, LINES)), r.standard_normal((dim, SIDES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        weight, side = np.uint64(1) << np.arange(bits, dtype=np.uint64), np.uint64(1) << np.arange(SIDES, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[tuple] = []
                for v in part.column("embedding").to_pylist():
                    x = np.array(v, dtype=float) if v and None not in v else np.zeros(0)
                    top = np.abs(x).max() if len(x) else 0.0
                    if not top or not np.isfinite(top):
                        rows.append((None,) * 5)
                        continue
                    u = x / top
                    u = u / np.sqrt((u * u).sum()) + 0.0
                    if len(u) not in known:
                        known[len(u)] = lines(len(u))
                    sign, place, half = known[len(u)]
                    code = ((u @ sign).reshape(rounds, bits) > 0) @ weight
                    salt = np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(u) << 48)
                    rows.append((xxhash.xxh3_64_intdigest((x + 0.0).tobytes()) - 2**63, u, mix(mix(code.astype(np.uint64)) + salt).view(np.int64), u @ place, int((((u @ half) > 0) @ side).astype(np.int64))))
                node, unit, cells, places, sketch = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(node, pa.int64()), pa.array(unit, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.float64())), pa.array(sketch, pa.int64())], names=["vec_id", "node", "unit", "cells", "places", "sketch"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    theta = math.acos(cosine)
    bits, rounds = plan(vectors.count(), cosine)
    rows = saved(vectors.select("vec_id", "embedding").mapInArrow(projector(bits, rounds), "vec_id long, node long, unit array<double>, cells array<long>, places array<double>, sketch long"))
    valid = rows.filter("node is not null")
    classes = saved(valid.groupBy("node").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    points = saved(valid.select("node", "unit", "places", "cells", "sketch").dropDuplicates(["node"]))
    each = points.select("node", "sketch", F.explode("cells").alias("h"))
    shared = each.groupBy("h").agg(F.min("node").alias("centre"), F.max("node").alias("hi")).filter("centre < hi").select("h", "centre")
    cells = saved(each.join(small_side(saved(shared)), "h"))

    def point(name: str, *what: str) -> DataFrame:
        return points.select(F.col("node").alias(name), *[F.col(w).alias(f"{w}_{name}") for w in what]).hint("merge")

    centres = cells.filter("node = centre").select("h", F.col("sketch").alias("sketch_centre")).hint("merge")
    star = cells.filter("node <> centre").join(centres, "h").filter(~sides_differ("sketch", "sketch_centre", F.lit(theta / 2))).select("node", "centre").distinct()
    near = saved(star).join(point("node", "unit"), "node").join(point("centre", "unit"), "centre").withColumn("cos", dot("unit_node", "unit_centre"))
    own = near.filter(F.col("cos") >= math.cos(theta / 2) + SLACK).groupBy("node").agg(F.min("centre").alias("ball"), F.min_by("cos", "centre").alias("cos"))
    balls = saved(cells.select("node").distinct().join(own.hint("merge"), "node", "left").select("node", F.coalesce("ball", "node").alias("ball"), F.coalesce(angle(F.col("cos")), F.lit(0.0)).alias("off")))
    radius = balls.groupBy("ball").agg(F.max("off").alias("r")).join(points.select(F.col("node").alias("ball"), "sketch").hint("merge"), "ball")
    known = saved(balls.join(radius.hint("merge"), "ball"))

    in_cell = saved(cells.select("h", "node").join(known.select("node", "ball", "r", "sketch").hint("merge"), "node").select("h", "ball", "r", "sketch").distinct())
    met = in_cell.withColumnsRenamed({"ball": "a", "r": "ra", "sketch": "sa"}).join(in_cell.withColumnsRenamed({"ball": "b", "r": "rb", "sketch": "sb"}).hint("merge"), "h").filter("a < b").filter(~sides_differ("sa", "sb", theta + F.col("ra") + F.col("rb")))
    reach = saved(met.select("a", "b", "ra", "rb").distinct()).join(point("a", "unit"), "a").join(point("b", "unit"), "b")
    close = saved(reach.filter(angle(dot("unit_a", "unit_b")) <= theta + SLACK + F.col("ra") + F.col("rb")).select("a", "b", "rb"))
    # members of a against the centre of b, then against its members
    one = close.join(balls.select(F.col("ball").alias("a"), F.col("node").alias("x")).hint("merge"), "a").join(point("x", "unit", "places"), "x").join(point("b", "unit"), "b").filter(angle(dot("unit_x", "unit_b")) <= theta + SLACK + F.col("rb")).drop("unit_b")
    two = one.join(balls.select(F.col("ball").alias("b"), F.col("node").alias("y")).hint("merge"), "b").join(point("y", "unit", "places"), "y")
    width = WINDOW * math.sqrt(2 - 2 * cosine)
    count = F.size(F.filter(F.zip_with("places_x", "places_y", lambda p, q: F.abs(p - q) <= width), lambda hit: hit))
    links = saved(two.filter(count >= least_count()).filter(dot("unit_x", "unit_y") >= cosine).select("a", "b", "x", "y"))

    both = links.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("other")))
    outside = both.join(classes.select(F.col("node").alias("other"), "copies").hint("merge"), "other").groupBy("node").agg(F.sum("copies").alias("outside"))
    labels = components(links.select("a", "b").distinct())
    placed = classes.join(balls.select("node", "ball").hint("merge"), "node", "left").withColumn("ball", F.coalesce("ball", "node"))
    placed = placed.join(labels.select(F.col("node").alias("ball"), "label").hint("merge"), "ball", "left").withColumn("label", F.coalesce("label", "ball"))
    placed = saved(placed.join(outside.hint("merge"), "node", "left"))
    inside = placed.groupBy("ball").agg(F.sum("copies").alias("inside"))
    least = placed.groupBy("label").agg(F.min("id").alias("component_id"))
    each_node = saved(placed.join(inside.hint("merge"), "ball").join(least.hint("merge"), "label").select("node", (F.col("inside") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "node").join(small_side(each_node), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
