"""Places of cells: distances within a range, neighbours, and regions of groups.

Cells of a sample are dealt to squares as wide as the range; a cell is compared with
those of its own and the eight adjoining squares only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import written


def _distance(a: str, b: str):
    return F.sqrt(F.pow(F.col(f"{a}x") - F.col(f"{b}x"), 2) + F.pow(F.col(f"{a}y") - F.col(f"{b}y"), 2))


def cell_distances(cells: DataFrame, reach: float, ratio: float = 1.0, tol: float = 0.0) -> DataFrame:
    """(sample, i, j, d) of pairs i < j whose distance is at most ``reach`` + ``tol``."""
    wide = float((reach + tol) / ratio)
    square = [F.floor(F.col(c) / wide).cast("long") for c in ("x", "y")]
    own = cells.select("sample", F.col("cell").alias("i"), F.col("x").alias("ix"), F.col("y").alias("iy"), square[0].alias("sx"), square[1].alias("sy"))
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    other = cells.select("sample", F.col("cell").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy"), *(s.alias(n) for s, n in zip(square, ("px", "py"))), F.explode(near).alias("o"))
    other = other.select("sample", "j", "jx", "jy", (F.col("px") + F.col("o.a")).alias("sx"), (F.col("py") + F.col("o.b")).alias("sy"))
    pairs = own.join(other, ["sample", "sx", "sy"]).filter("i < j").withColumn("d", _distance("i", "j") * ratio)
    return pairs.filter(F.col("d") <= reach + tol).select("sample", "i", "j", "d")


def nearest(cells: DataFrame) -> DataFrame:
    """(sample, i, a, b, nn, d): of each cell of group a the nearest of group b in its
    sample (itself, if a = b), ties to the smaller id.

    By widening squares, as ``knn``: a cell that has found one of a group nearer than a
    square is wide is done with that group. Cells without a place take no part."""
    cells = cells.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    box = cells.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    extent, side = _first_square(box, 4)
    own = cells.select("sample", F.col("cell").alias("i"), F.col("grp").alias("a"), F.col("x").alias("ix"), F.col("y").alias("iy"))
    other = cells.select("sample", F.col("cell").alias("j"), F.col("grp").alias("b"), F.col("x").alias("jx"), F.col("y").alias("jy"))
    each = cells.select("sample", F.col("grp").alias("b")).distinct()
    todo, done = own.join(each, "sample"), None
    while True:
        pairs = _pairs_by_squares(todo, other, side, ["b"])
        best = pairs.groupBy("sample", "i", "a", "b").agg(F.min(F.struct(_distance("i", "j").alias("d"), F.col("j").alias("nn"))).alias("m"))
        found = best.select("sample", "i", "a", "b", F.col("m.nn").alias("nn"), F.col("m.d").alias("d"))
        if side > extent:
            return found if done is None else done.unionByName(found)
        found = written(found.filter(F.col("d") < side), "near")
        done = found if done is None else done.unionByName(found)
        todo = written(todo.join(found.select("sample", "i", "b"), ["sample", "i", "b"], "left_anti"), "todo")
        if todo.isEmpty():
            return done
        side *= 4


def _first_square(box, k: int) -> tuple[float, float]:
    """(extent, side): squares that hold about ``k`` cells, from the widths and the number."""
    extent = max(box[0] or 0.0, box[1] or 0.0)
    least = extent / 1024
    return extent, math.sqrt(max(box[0] or 0.0, least) * max(box[1] or 0.0, least) * k / max(box[2], 1)) or 1.0


def _pairs_by_squares(own: DataFrame, other: DataFrame, side: float, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (sample, i, ix, iy) with those (sample, j, jx, jy) of their own and the eight
    adjoining squares, which hold all that are nearer than ``side``."""
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    around = own.withColumn("o", F.explode(near)).withColumn("sx", square("ix") + F.col("o.a")).withColumn("sy", square("iy") + F.col("o.b")).drop("o")
    return around.join(other.withColumn("sx", square("jx")).withColumn("sy", square("jy")), ["sample", "sx", "sy", *more])


def knn(cells: DataFrame, k: int) -> DataFrame:
    """(sample, node, neighbour, rnk, d): k nearest others, ties to the smaller id.

    Squares begin with about k cells each. A cell whose k-th neighbour is nearer than a
    square is wide is settled; the others go on with squares four times as wide, to the
    last when one holds everything. Cells without a place take no part."""
    cells = cells.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    box = cells.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    extent, side = _first_square(box, k + 1)
    own = cells.select("sample", F.col("cell").alias("i"), F.col("x").alias("ix"), F.col("y").alias("iy"))
    other = cells.select("sample", F.col("cell").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy"))
    order, each = Window.partitionBy("sample", "i").orderBy("d", "j"), Window.partitionBy("sample", "i")
    todo, done = own, None
    while True:
        pairs = _pairs_by_squares(todo, other, side).filter("i <> j").withColumn("d", _distance("i", "j"))
        best = pairs.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)
        found = best.select("sample", F.col("i").alias("node"), F.col("j").alias("neighbour"), "rnk", "d", F.max(F.when(F.col("rnk") == k, F.col("d"))).over(each).alias("far"))
        if side > extent:
            found = found.drop("far")
            return found if done is None else done.unionByName(found)
        found = written(found.filter(F.col("far") < side).drop("far"), "near")
        done = found if done is None else done.unionByName(found)
        todo = todo.join(found.select("sample", F.col("node").alias("i")).distinct(), ["sample", "i"], "left_anti")
        todo = written(todo, "todo")
        if todo.isEmpty():
            return done
        side *= 4


def region_distances(cells: DataFrame, reach: float, k_min: int = 10, ratio: float = 1.0, tol: float = 0.0) -> DataFrame:
    """(src, tgt, d, adjacent): trimmed means of nearest distances, averaged over samples
    and both directions; null where groups do not adjoin in any sample both ways."""
    n = nearest(cells).withColumn("d", F.col("d") * ratio)
    by = Window.partitionBy("sample", "a", "b")
    ranked = n.withColumn("rn", F.row_number().over(by.orderBy("d", "i"))).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("cut", F.floor(F.col("n") * 0.1))
    near = F.when(F.col("d") - reach < tol, F.col("nn"))
    inner = F.when((F.col("rn") > F.col("cut")) & (F.col("rn") <= F.col("n") - F.col("cut")), F.col("d"))
    each = ranked.groupBy("sample", "a", "b").agg(F.avg(inner).alias("d"), (F.countDistinct(near) >= k_min).cast("int").alias("adj"))
    both = each.groupBy("a", "b").agg(F.avg("d").alias("d"), F.max("adj").alias("adj"))
    back = both.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("d").alias("d2"), F.col("adj").alias("adj2"))
    adjacent = F.col("adj") * F.col("adj2")
    return both.join(back, ["a", "b"]).select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.when(adjacent == 1, (F.col("d") + F.col("d2")) / 2).alias("d"), adjacent.alias("adjacent"))


def weights(regions: DataFrame, scale: float = 0.01, use_distance: bool = True) -> DataFrame:
    """(src, tgt, weight): 1 / scaled distance, a group's own the largest of all; 0 where
    groups do not adjoin."""
    if not use_distance:
        return regions.select("src", "tgt", F.when(F.col("d").isNotNull(), 1.0).otherwise(0.0).alias("weight"))
    raw = regions.withColumn("w", F.when((F.col("src") != F.col("tgt")) & (F.col("d") > 0), 1 / (F.col("d") * scale)))
    return raw.select("src", "tgt", F.when(F.col("src") == F.col("tgt"), F.coalesce(F.max("w").over(Window.partitionBy()), F.lit(0.0))).otherwise(F.coalesce("w", F.lit(0.0))).alias("weight"))


def contact_overlap(cells: DataFrame, k: int, reach: float, k_min: int = 1, tol: float = 0.0) -> DataFrame:
    """(src, tgt, adjacent) for every pair of groups: 1 where, in some sample and both
    ways, enough of the other group's nearest cells within reach are among the k nearest
    of any cell of the group."""
    near = nearest(cells)
    close = knn(cells, k).join(cells.select("sample", F.col("cell").alias("node"), F.col("grp").alias("a")), ["sample", "node"])
    close = close.select("sample", "a", F.col("neighbour").alias("nn")).distinct()
    hits = near.filter(F.col("d") - reach < tol).select("sample", "a", "b", "nn").distinct().join(close, ["sample", "a", "nn"])
    each = hits.groupBy("sample", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k_min)
    found = each.select("a", "b").distinct()
    both = found.join(found.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).withColumn("hit", F.lit(1))
    every = near.select("a", "b").distinct().join(both, ["a", "b"], "left")
    return every.select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.coalesce("hit", F.lit(0)).alias("adjacent"))
