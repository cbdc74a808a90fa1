"""Near copies by the Jaccard similarity of their shingles.

Tries over SimHash bits, joined with themselves (``simhash.alike``), say which texts may
be alike. Texts linked there, over some steps or one, form a block, and in a block
similarities are exact: a text is compared with the members of each class found so far
until one is near enough. Texts with the same shingles meet first and are one node; a
block is held by one task.
"""

from __future__ import annotations

import hashlib
from itertools import repeat
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_rows, settle
from .simhash import _SEED, _components

WIDTH = 5
LEAST = 0.8


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words, in order; a shorter text is one run."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(_SEED)), np.uint64))


def _node(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _wide(h: np.ndarray, least: float) -> bytes:
    """None for sets so small that one more or less is too far already."""
    return simhash.wide_fingerprint(h) if len(h) / (len(h) + 1) >= least else b""


def _marks(width: int, least: float):
    def run(batches):
        for ids, texts, prints in arrow_rows(batches, "doc_id", "text", "tx"):
            sets = [shingles(t, width) for t in texts]
            cols = [pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(map(_node, sets), pa.binary()), pa.array([_wide(h, least) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tx", "node", "wide"])

    return run


def _sets(width: int):
    def run(batches):
        for blocks, texts in arrow_rows(batches, "block", "text"):
            sets = [shingles(t, width) for t in texts]
            cols = [pa.array(blocks, pa.int64()), pa.array(map(_node, sets), pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "node", "hashes"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Of distinct hashes in order, ``a`` no longer than ``b``."""
    if len(a) / len(b) < least:
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both) >= least


def _block_links(least: float):
    def links(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        found = [(np.frombuffer(bytes(h), np.uint64), bytes(n)) for n, h in zip(rows["node"], rows["hashes"])]
        found.sort(key=lambda p: (len(p[0]), p[1]))
        classes: list[list[int]] = []
        u, v = [], []
        for k, (h, node) in enumerate(found):
            apart, mine = [], [k]
            for members in classes:
                # the longest member comes last: if that is too short, all are
                near = None
                if len(found[members[-1]][0]) / len(h) >= least:
                    near = next((m for m in members if _alike(found[m][0], h, least)), None)
                if near is None:
                    apart.append(members)
                else:
                    u.append(found[near][1])
                    v.append(node)
                    mine = members + mine
            classes = [*apart, sorted(mine)]
        return pd.DataFrame({"u": u, "v": v})

    return links


def _marked(docs: DataFrame, width: int, least: float) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _print(text).alias("tx"))
    return settle(rows.mapInArrow(_marks(width, least), "doc_id long, tx binary, node binary, wide binary"), "shingled")


def _print(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _first():
    """The row that stands for others: that of the smallest doc_id."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tx"))


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` as a struct, beside what ``wanted`` (doc_id, tx, more) has for them.
    The text's digest is part of the key, so rows without a doc_id do not all meet."""
    wanted = wanted.withColumnRenamed("doc_id", "want_id").withColumnRenamed("tx", "want_tx")
    own = docs.select(F.struct("*").alias("row"))
    here = F.col("row.doc_id").cast("long").eqNullSafe(F.col("want_id")) & (_print(F.col("row.text").cast("string")) == F.col("want_tx"))
    return own.join(wanted, here)


def _classes(docs: DataFrame, marks: DataFrame, width: int, least: float) -> DataFrame:
    """(node, root) of the nodes that have a near copy."""
    nodes = settle(marks.groupBy("node").agg(F.any_value("wide").alias("wide"), _first().alias("first")), "nodes")
    # the tries name nodes by half of their digests: if two share it, both enter the block
    half = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
    blocks = simhash.alike(nodes.filter("length(wide) > 0").select(half.alias("node"), "wide")).select(F.col("node").alias("half"), F.col("root").alias("block"))
    some = nodes.withColumn("half", half).join(blocks, "half").select("first.doc_id", "first.tx", "block")
    texts = _rows_of(docs.select("doc_id", "text"), some).select("block", F.col("row.text").cast("string").alias("text"))
    sets = texts.mapInArrow(_sets(width), "block long, node binary, hashes binary").dropDuplicates(["node"])
    return _components(sets.groupBy("block").applyInPandas(_block_links(least), "u binary, v binary"))


def one_of_each(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row of ``docs`` for each group that links of similarity ``least`` or more hold
    together, columns as they are: the row of the smallest doc_id, of rows that share it
    the one whose text has the least MD5. Rows without words are one group; rows with a
    null doc_id take part and stand for a group only if it has no other."""
    marks = _marked(docs, width, least)
    root = _classes(docs, marks, width, least)
    grouped = marks.join(root, "node", "left").withColumn("group", F.coalesce("root", "node"))
    best = grouped.groupBy("group").agg(_first().alias("first")).select("first.doc_id", "first.tx")
    # how many rows a doc_id and a text have is known before whole rows are moved
    many = marks.groupBy("doc_id", "tx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("many_id"), F.col("tx").alias("many_tx"), "n")
    best = best.join(many, F.col("doc_id").eqNullSafe(F.col("many_id")) & (F.col("tx") == F.col("many_tx")), "left").select("doc_id", "tx", "n")
    best = settle(best, "kept")
    single = _rows_of(docs, best.filter("n is null")).select("row.*")
    order = Window.partitionBy("want_id", "want_tx").orderBy(F.col("row.text"), F.xxhash64(F.to_json("row")))
    alike = _rows_of(docs, best.filter("n is not null")).withColumn("nth", F.row_number().over(order))
    return single.unionAll(alike.filter("nth = 1").select("row.*"))
