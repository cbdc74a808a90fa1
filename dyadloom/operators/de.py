"""Marker genes: shares, fold changes, rank sums, and what follows for interactions."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def shares(expr: DataFrame, cells: DataFrame, within: tuple[str, ...] = (), log: bool = True) -> DataFrame:
    """(gene, *within, grp, pct_1, pct_2, logfc): share of cells with a value within and
    outside a group, and the difference of log mean exp, or of plain means without
    ``log``. ``within`` names columns of cells that keep comparisons apart."""
    keys = ["gene", *within]
    stored = expr.join(cells.select("cell", "grp", *within), "cell").filter("value <> 0")
    one = stored.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.expm1("value") if log else F.col("value")).alias("s"))
    genes = one.groupBy(*keys).agg(F.sum("k").alias("k_all"), F.sum("s").alias("s_all"))
    grid = _paired(_sized(cells, within), genes, within).join(one, [*keys, "grp"], "left").na.fill(0, ["k"]).na.fill(0.0, ["s"])
    rest, last = F.col("n") - F.col("n1"), (lambda m: F.ln(m + 1)) if log else (lambda m: m)
    return grid.select(
        *keys, "grp", F.round(F.col("k") / F.col("n1"), 3).alias("pct_1"), F.round((F.col("k_all") - F.col("k")) / rest, 3).alias("pct_2"),
        (last(F.col("s") / F.col("n1")) - last((F.col("s_all") - F.col("s")) / rest)).alias("logfc"),
    )


def _sized(cells: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """(*within, grp, n1, n): cells of each group, and of all that it is compared with."""
    sizes = cells.groupBy(*within, "grp").agg(F.count(F.lit(1)).alias("n1"))
    return sizes.withColumn("n", F.sum("n1").over(Window.partitionBy(*within)))


def _paired(sizes: DataFrame, genes: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Groups with genes, the shape of a result: groups are few, so they travel as one list."""
    lists = sizes.groupBy(*within).agg(F.collect_list(F.struct("grp", "n1", "n")).alias("groups"))
    # without ``within`` there is one list, a row for each group of cells
    both = genes.join(lists, list(within)) if within else genes.join(F.broadcast(lists))
    return both.withColumn("g", F.explode("groups")).drop("groups").select("*", "g.*").drop("g")


def rank_sums(expr: DataFrame, cells: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(gene, *within, grp, n1, n2, w, z, tied): the rank sum of a group against the rest, with
    tie and continuity corrections. Zeros are one block of ties at the low end."""
    keys = ["gene", *within]
    stored = expr.join(cells.select("cell", "grp", *within), "cell").filter("value > 0")
    sizes = _sized(cells, within)
    every = sizes.select(*within, "n").distinct()
    values = stored.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("t"))
    ahead = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    tied = values.withColumn("below", F.coalesce(F.sum("t").over(ahead), F.lit(0))).withColumn("nnz", F.sum("t").over(Window.partitionBy(*keys))).join(F.broadcast(every), list(within) or None)
    tied = tied.withColumn("zeros", F.col("n") - F.col("nnz")).withColumn("rank", F.col("zeros") + F.col("below") + (F.col("t") + 1) / 2)
    cube = lambda c: c * c * c - c
    genes = tied.groupBy(*keys).agg(F.max("zeros").alias("zeros"), F.sum(cube(F.col("t").cast("double"))).alias("ties"))
    sums = stored.join(tied.select(*keys, "value", "rank"), [*keys, "value"]).groupBy(*keys, "grp").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("k"))
    grid = _paired(sizes, genes, within).join(sums, [*keys, "grp"], "left").na.fill(0.0, ["r"]).na.fill(0, ["k"])
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n").cast("double")
    w = F.col("r") + (n1 - F.col("k")) * (F.col("zeros") + 1) / 2 - n1 * (n1 + 1) / 2
    ties = F.col("ties") + cube(F.col("zeros").cast("double"))
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    z = w - n1 * n2 / 2.0
    return grid.select(*keys, "grp", n1.alias("n1"), n2.alias("n2"), w.alias("w"), F.when(var > 0, (z - 0.5 * F.signum(z)) / F.sqrt(var)).alias("z"), (ties > 0).alias("tied"))


#: Sizes below which a rank sum without ties has its exact p-value.
EXACT = 50


@pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    out = np.fromiter(map(math.erfc, np.abs(z.to_numpy(float)) / math.sqrt(2)), float, len(z))
    return pd.Series(out).where(z.notna().to_numpy())


@pandas_udf(DoubleType())
def _p_of_rank_sum(w: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([exact_p(round(a), int(b), int(c)) for a, b, c in zip(w, n1, n2)])


def p_value() -> Column:
    """Of (w, n1, n2, z, tied): exact for small samples without ties, else normal."""
    small = (F.col("n1") < EXACT) & (F.col("n2") < EXACT) & ~F.col("tied")
    # what the exact count does not serve goes in as the smallest question there is
    safe = lambda c, other: F.when(small, F.col(c)).otherwise(F.lit(other)).cast("double")
    return F.when(small, _p_of_rank_sum(safe("w", 0), safe("n1", 1), safe("n2", 1))).otherwise(two_sided(F.col("z")))


@cache
def _wins(m: int, n: int) -> tuple[int, ...]:
    """Orders of m and n values by how many of the m * n comparisons the first win: the
    coefficients of a Gaussian binomial, one factor after the other."""
    out = [1] + [0] * (m * n)
    for k in range(1, m + 1):
        for u in range(m * n, n + k - 1, -1):
            out[u] -= out[u - n - k]
        for u in range(k, m * n + 1):
            out[u] += out[u - k]
    return tuple(out)


def exact_p(w: int, n1: int, n2: int) -> float:
    """Two-sided p-value of a rank sum without ties, by counting arrangements."""
    counts, total = _wins(n1, n2), math.comb(n1 + n2, n1)
    return min(1.0, 2 * min(sum(counts[: w + 1]), sum(counts[w:])) / total)


def markers(expr: DataFrame, cells: DataFrame, n_genes: int, thresh_pc: float = 0.0, thresh_fc: float = 0.0, thresh_p: float = 0.05, only_pos: bool = True) -> DataFrame:
    """Marker rows with p-values and Bonferroni's by the number of all genes."""
    found = shares(expr, cells).filter(F.greatest("pct_1", "pct_2") > thresh_pc)
    found = found.filter(F.col("logfc") > thresh_fc if only_pos else F.abs("logfc") > thresh_fc)
    tested = found.join(rank_sums(expr, cells), ["gene", "grp"]).withColumn("pvalues", p_value()).filter(F.col("pvalues") < thresh_p)
    return tested.withColumn("pvalues_adj", F.least(F.lit(1.0), F.col("pvalues") * n_genes)).withColumn("rnk", F.row_number().over(Window.partitionBy("grp").orderBy("pvalues", F.desc("logfc"), "gene")))


def quick_markers(expr: DataFrame, cells: DataFrame, thresh_pc: float = 0.0, thresh_fc: float = 0.0, thresh_p: float = 0.05, only_pos: bool = True) -> DataFrame:
    """Marker rows by differences of means, shares as percentages and the normal
    approximation; (gene, grp, logfc, pct_1, pct_2, z, pvalues)."""
    found = shares(expr, cells, log=False).withColumn("pct_1", F.col("pct_1") * 100).withColumn("pct_2", F.col("pct_2") * 100)
    found = found.filter((F.greatest("pct_1", "pct_2") > thresh_pc * 100) & (F.abs("logfc") >= thresh_fc))
    tested = found.join(rank_sums(expr, cells).select("gene", "grp", "z"), ["gene", "grp"]).withColumn("pvalues", two_sided(F.col("z"))).filter(F.col("pvalues") < thresh_p)
    return tested.filter("logfc > 0") if only_pos else tested


def dataset_markers(expr: DataFrame, cells: DataFrame, positive, by: str = "sample", combined: bool = False) -> DataFrame:
    """(gene, grp, pct_1, pct_2, logfc, z, pvalues, positive) of the cells of one dataset
    against the others, group by group, or once for all groups with ``combined``."""
    own = cells.select("cell", F.lit("all").alias("cluster") if combined else F.col("grp").alias("cluster"), (F.col(by) == positive).alias("grp"))
    both = shares(expr, own, ("cluster",)).filter("grp").join(rank_sums(expr, own, ("cluster",)).filter("grp"), ["gene", "cluster", "grp"])
    out = both.select("gene", F.col("cluster").alias("grp"), "pct_1", "pct_2", "logfc", "z", two_sided(F.col("z")).alias("pvalues"), (F.col("logfc") > 0).alias("positive"))
    if not combined:
        return out
    groups = [r.grp for r in cells.select("grp").distinct().collect()]
    return out.drop("grp").withColumn("grp", F.explode(F.array(*map(F.lit, groups))))


def side_markers(marked: DataFrame, lr: DataFrame, complexes: DataFrame) -> DataFrame:
    """Marker rows (gene, ...) by ligand or receptor: a gene that is one itself keeps its
    row, any other has it once for each complex that it is part of, under ``name``."""
    names = lr.select(F.col("ligand").alias("name")).union(lr.select("receptor")).distinct()
    own = marked.join(names.withColumn("gene", F.col("name")), "gene")
    parts = complexes.filter("member <> ''").select(F.col("name"), F.col("member").alias("gene")).distinct()
    return own.unionByName(marked.join(names.select(F.col("name").alias("gene")), "gene", "left_anti").join(parts, "gene").select(*own.columns))


def expressed(expr: DataFrame, min_cells: int = 10) -> DataFrame:
    return expr.filter("value > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cells)


def over_expressed(lr: DataFrame, complexes: DataFrame, marked: DataFrame, measured: DataFrame, both: bool = True) -> DataFrame:
    """Interactions of which both sides are markers, or complexes fully measured with one
    marker at least; else one such side and the other measured."""
    parts = complexes.filter("member <> ''").select("name", F.col("member").alias("gene"))
    own = measured.select("gene").withColumn("m", F.lit(True)).join(marked.select("gene").distinct().withColumn("k", F.lit(True)), "gene", "left")
    whole = parts.join(own, "gene", "left").groupBy("name").agg(F.bool_and(F.coalesce("m", F.lit(False))).alias("measured"), F.bool_or(F.coalesce("k", F.lit(False))).alias("marked"))
    sides = whole.unionByName(own.select(F.col("gene").alias("name"), F.lit(True).alias("measured"), F.coalesce("k", F.lit(False)).alias("marked")))
    out = lr
    for side in ("ligand", "receptor"):
        out = out.join(sides.select(F.col("name").alias(side), F.col("measured").alias(f"{side}_measured"), (F.col("marked") & F.col("measured")).alias(f"{side}_marked")), side)
    ok = F.col("ligand_measured") & F.col("receptor_measured")
    marks = (F.col("ligand_marked") & F.col("receptor_marked")) if both else (F.col("ligand_marked") | F.col("receptor_marked"))
    return out.filter(ok & marks).select(*lr.columns)


def map_degs(kept: DataFrame, stats: DataFrame, complexes: DataFrame) -> DataFrame:
    """Communication rows with the statistics of their ligand in the source and receptor
    in the target; those of a complex are means over its parts."""
    parts = complexes.filter("member <> ''").select("name", F.col("member").alias("gene"))
    cols = [c for c in ("logfc", "pct_1", "pct_2") if c in stats.columns]
    whole = stats.join(parts, "gene").groupBy("name", "grp").agg(*(F.avg(c).alias(c) for c in cols))
    every = stats.select(F.col("gene").alias("name"), "grp", *cols).unionByName(whole)
    out = kept
    for side, end in (("ligand", "src"), ("receptor", "tgt")):
        out = out.join(every.select(F.col("name").alias(side), F.col("grp").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in cols)), [side, end], "left")
    return out


def enrichment(mapped: DataFrame, by: str = "pathway_name") -> DataFrame:
    """Mean over pairs of the product of changes of both sides, summed by ``by``."""
    gap = lambda s: F.abs(F.col(f"{s}_pct_1") - F.col(f"{s}_pct_2"))
    one = F.abs("ligand_logfc") * F.abs("receptor_logfc") * gap("ligand") * gap("receptor")
    return mapped.groupBy("lr_ix", by).agg(F.avg(one).alias("score")).groupBy(by).agg(F.sum("score").alias("score"))
