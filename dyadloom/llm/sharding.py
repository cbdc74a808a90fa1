"""Shards of bounded bytes by extendible hashing; DataFrame only.

A row's shard is a prefix of its hash bits: first bits of a digest of its id and text,
then bits of its own place, so even equal rows can be parted. The directory starts as one bucket
and only buckets over the limit are cut by a further bit. Sums by prefix decide, a
few bits a round, so a round reads only what is still too large, and the driver sees
one flag a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LIMIT = 64 << 20
#: Bits of a row's hash, and how many of them come from its place.
BITS, PLACE_BITS = 60, 24
STEP = 10


def _prefix(depth) -> F.Column:
    return F.call_function("shiftrightunsigned", F.col("hash"), (F.lit(BITS) - depth).cast("int"))


def shards(docs: DataFrame, limit: int = LIMIT, step: int = STEP, keep: F.Column | None = None) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversized) for every row.

    ``shard`` is the bucket's hash prefix in 0s and 1s, ``depth`` its length. Null texts
    have no bytes, and an empty table gives no rows. Rows that repeat an id, null
    included, lie apart by their texts, and equal rows by their places, which may differ
    from run to run; only then are bits beyond the first 36 looked at. A document above
    the limit is a shard at full depth, ``oversized``. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = lambda c, n: F.conv(F.substring(F.md5(c), 1, n // 4), 16, 10).cast("long")
    content = number(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))), BITS - PLACE_BITS)
    bits = F.shiftleft(content, PLACE_BITS) + number(F.monotonically_increasing_id().cast("string"), PLACE_BITS)
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bits.alias("hash"), F.octet_length(text).cast("long").alias("n_bytes"), *([keep.alias("kept")] if keep is not None else []))
    left, depth, done = settle(left, "sizes"), 0, []
    while True:
        deep = min(BITS, depth + step)
        fine = left.groupBy(_prefix(F.lit(deep)).alias("fine")).agg(F.sum("n_bytes").alias("n"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deep))))
        above = lambda: F.call_function("shiftrightunsigned", F.col("fine"), (F.lit(deep) - F.col("depth")).cast("int"))
        sums = levels.withColumn("prefix", above()).groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes"), F.collect_list("fine").alias("fines"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        place = F.min(F.when(fits, F.struct("depth", "shard_bytes"))).alias("place")
        directory = sums.select("depth", "shard_bytes", F.explode("fines").alias("fine")).groupBy("fine").agg(place)
        found = settle(left.withColumn("fine", _prefix(F.lit(deep))).join(directory, "fine").drop("fine"), "shards")
        done.append(found.filter("place is not null"))
        left = found.filter("place is null").drop("place")
        if deep == BITS or left.isEmpty():
            break
        depth = deep + 1
    every = reduce(DataFrame.unionAll, done)
    code = F.lpad(F.bin("hash"), BITS, "0")
    return every.select(
        "doc_id", "n_bytes", F.substr(code, F.lit(1), F.col("place.depth")).alias("shard"), F.col("place.depth").alias("depth"),
        F.col("place.shard_bytes").alias("shard_bytes"), (F.col("place.shard_bytes") > limit).alias("oversized"), *(["kept"] if keep is not None else []),
    )


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write the rows of ``docs`` as Parquet, a folder a shard. Rows that share an id go
    where their texts belong."""
    print_of = lambda c: F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    own = shards(docs, limit, keep=print_of(F.col("text"))).groupBy(F.col("doc_id").alias("own_id"), F.col("kept").alias("own_print")).agg(F.min("shard").alias("shard"))
    out = docs.select(F.struct("*").alias("row")).join(own, F.col("row.doc_id").cast("long").eqNullSafe(F.col("own_id")) & (print_of(F.col("row.text")) == F.col("own_print")))
    out.select("shard", "row.*").repartition("shard").write.partitionBy("shard").parquet(folder)
