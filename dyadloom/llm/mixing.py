"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame only.

A document's key is -ln(u) / weight, u being a hash of its id, so that the documents
of a source in ascending order of keys are a weighted sample without replacement at
every length. A source's target is filled by complete epochs first; what is left is a
prefix of that order. Prefix sums go by bins of keys: sums of bins first, then sums
within a bin, so that no task has to order a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settle

#: Weights of the sources in order, repeating; share of all sizes; largest repeat.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Least bins of keys, and rows for each bin of a source that has all rows.
BINS, BIN_ROWS = 1024, 1 << 16
#: Quality weights: of label 1, of no label, of label 0. The least is 1.
GOOD, UNKNOWN, POOR = 2.0, 1.5, 1.0
#: Rows up to which the table of sources is broadcast (some 10 MB); beyond, it is joined.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with target: by weight, at most ``cap`` times the size,
    the excess going to the others by weight until none is above.

    That is min(cap * size, level * weight) for one level: with sources in ascending
    order of cap * size / weight, the full ones are a prefix.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, whole = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(up))
        .withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(whole))
    )
    full = F.col("open").isNull() | (F.col("place") < F.col("open.place"))
    return out.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("open.level") * F.col("weight")).alias("target"))


def qualities(labels: DataFrame) -> DataFrame:
    """(doc_id, weight), one row a document; labels that differ count as their mean."""
    mean = F.avg(F.col("quality").cast("double"))
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.lit(POOR) + (GOOD - POOR) * F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix", bins: int | None = None) -> DataFrame:
    """(doc_id, source, print, size, source_size, target, copies, taken) for every row,
    ``print`` being a hash of its text.

    ``weights``: (doc_id, weight >= 1), one row a document; others weigh ``UNKNOWN``.
    Whole documents are taken; of the last one that a target reaches into, whichever
    lands nearer to it. Null texts have size 0, a null source is a source of its own,
    and rows that repeat a doc_id each stand for themselves. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("print"))
    if weights is not None:
        rows = rows.join(weights.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left").drop("id")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    key = -F.ln((bits + 0.5) / float(1 << 52)) / F.coalesce("weight", F.lit(UNKNOWN))
    rows = settle(rows.select("doc_id", "source", "print", "size", key.alias("key"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("part")), "keys")
    bins = bins or max(BINS, rows.count() // BIN_ROWS)
    rows = rows.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins))

    sums = rows.groupBy("part", "bin").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    aim = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aim = settle(aim.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("part", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "targets")
    aim = F.broadcast(aim) if aim.count() <= BROADCAST_SOURCES else aim

    earlier = Window.partitionBy("part").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "bin", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset")).join(aim, "part")
    ahead = Window.partitionBy("part", "bin").orderBy("key", "doc_id", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(offsets, ["part", "bin"])
    chosen = F.col("offset") + F.col("inner") + F.col("size") / 2 < F.col("rest")
    copies = (F.col("epochs") + chosen.cast("int")).cast("long")
    return placed.select("doc_id", "source", "print", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with its columns as they
    are, whatever their names. Rows that repeat an id are told apart by their texts; of
    equal rows the first ones get the odd copies. An empty table gives none."""
    counts = mix(docs, weights).groupBy("doc_id", "source", "print").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.struct("doc_id", "source", "print").alias("taken"), "copies", "n").filter("copies > 0")
    own = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("print")).alias("own"))
    same = [F.col(f"own.{c}").eqNullSafe(F.col(f"taken.{c}")) for c in ("doc_id", "source", "print")]
    kept = own.join(counts, same)
    single = kept.filter("n = 1").select("row", "copies")
    equal = kept.filter("n > 1").withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy(F.xxhash64(F.to_json("row")))))
    share = F.floor(F.col("copies") / F.col("n")) + (F.col("nth") <= F.col("copies") % F.col("n")).cast("long")
    every = single.unionAll(equal.select("row", share.cast("long").alias("copies"))).filter("copies > 0")
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
