"""Robust means by group over sparse, non-negative values.

Zeros are never written out: each (gene, group) has one row for all of them, weighted
by how many there are, so the data shuffled are the stored values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_means, identity

KINDS = ("triMean", "truncatedMean", "thresholdedMean", "median", "mean")


def match_kind(name: str) -> str:
    """An exact name or a unique prefix of one."""
    found = [k for k in KINDS if k == name] or [k for k in KINDS if k.startswith(name)]
    if len(found) != 1:
        raise ValueError(f"{name!r} is not one of {', '.join(KINDS)}")
    return found[0]


def group_means(expr: DataFrame, cells: DataFrame, kind: str = "triMean", trim: float = 0.1, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """(gene, *by, value) for every gene of ``expr`` and group of ``cells``."""
    kind = match_kind(kind)
    by = list(by)
    if kind not in ("mean", "thresholdedMean"):
        return by_blocks(expr, cells, kind, trim, by)
    # sums by group of stored values, over groups times genes, the shape of the result
    stored = expr.join(cells.select("cell", *by), "cell").filter("value <> 0")
    seen = stored.groupBy("gene", *by).agg(F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("total"))
    groups, sizes, _ = numbered(cells, by)
    kinds = dict(cells.dtypes)
    each = [F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(by, g)), F.lit(n).alias("n")) for g, n in zip(groups, sizes)]
    grid = expr.select("gene").distinct().select("gene", F.explode(F.array(*each)).alias("g")).select("gene", "g.*")
    grid = grid.join(seen, ["gene", *by], "left").na.fill(0, ["nnz"]).na.fill(0.0, ["total"])
    value = F.col("total") / F.col("n")
    if kind == "thresholdedMean":
        value = F.when(F.col("nnz") / F.col("n") < trim, 0.0).otherwise(value)
    return grid.select("gene", *by, value.alias("value"))



def numbered(cells: DataFrame, by: list[str]) -> tuple[list[tuple], list[int], DataFrame]:
    """Groups in order, their sizes, and (cell, x, own) with the number of each cell's
    group. As many rows reach the driver as there are groups, the shape of a result."""
    found = sorted(((tuple(r[c] for c in by), r["n"]) for r in cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda r: repr(r[0]))
    groups, sizes = [g for g, _ in found], [n for _, n in found]
    if len(groups) > 1 << 16:
        raise ValueError(f"{len(groups)} groups are more than 16 bits number")
    kinds = ", ".join(f"`{c}` {t}" for c, t in cells.select(*by).dtypes)
    codes = cells.sparkSession.createDataFrame([(*g, k) for k, g in enumerate(groups)], f"{kinds}, own int")
    on = [cells[c].eqNullSafe(codes[c]) for c in by]
    return groups, sizes, cells.join(codes, on).select(cells["cell"], identity(cells["cell"]).alias("x"), "own")


def by_blocks(expr: DataFrame, cells: DataFrame, kind: str, trim: float, by: list[str]) -> DataFrame:
    groups, sizes, labels = numbered(cells, by)
    kinds = dict(cells.dtypes)
    schema = "gene string, " + ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", value double"
    arrow = [pa.string(), *(f.type for f in cells.select(*by).limit(0).toArrow().schema), pa.float64()]

    def rows(batches):
        for batch in batches:
            out = [(gene, *g, float(v)) for gene, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for g, v in zip(groups, np.frombuffer(m, "<f8") if m else np.zeros(len(groups)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(arrow)], ["gene", *by, "value"])

    means = expr.select("gene").distinct().join(block_means(expr, labels, sizes, kind, trim), "gene", "left")
    return means.mapInArrow(rows, schema)


def geometric(value):
    """Of a group; any zero makes it zero."""
    return F.when(F.min(value) <= 0, 0.0).otherwise(F.exp(F.avg(F.ln(value))))
