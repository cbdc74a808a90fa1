"""Relational reads of the tensor (lr_ix, src, tgt, prob, pval)."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import de


def significant(net: DataFrame, thresh: float, strict: bool = False) -> DataFrame:
    """Strengths of p-values at or above (``strict``: above) the threshold become 0."""
    out = F.col("pval") > thresh if strict else F.col("pval") >= thresh
    return net.withColumn("prob", F.when(out | F.col("pval").isNull(), 0.0).otherwise(F.col("prob")))


def filter_min_cells(net: DataFrame, cells: DataFrame, min_cells: int = 10) -> DataFrame:
    """Groups of ``min_cells`` cells or fewer have no strength, rows stay."""
    few = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= min_cells)
    out = net
    for side in ("src", "tgt"):
        out = out.join(F.broadcast(few.select(F.col("grp").alias(side), F.lit(True).alias(f"{side}_few"))), side, "left")
    gone = F.col("src_few").isNotNull() | F.col("tgt_few").isNotNull()
    return out.withColumn("prob", F.when(gone, 0.0).otherwise(F.col("prob"))).select(*net.columns)


def filter_min_samples(net: DataFrame, support: DataFrame, min_samples: int, rare: DataFrame | None = None) -> DataFrame:
    """``support``: (lr_ix, src, tgt, n) samples with a positive strength. An interaction
    some of whose pairs are partly supported keeps only pairs with enough samples, and,
    where ``rare`` (grp) is given, those of groups too small in some sample."""
    joined = net.join(support, ["lr_ix", "src", "tgt"], "left").na.fill(0, ["n"])
    partly = F.max(((F.col("n") > 0) & (F.col("n") < min_samples)).cast("int")).over(Window.partitionBy("lr_ix"))
    gone = (F.col("partly") == 1) & (F.col("n") < min_samples)
    if rare is not None:
        for side in ("src", "tgt"):
            joined = joined.join(rare.select(F.col("grp").alias(side)).distinct().withColumn(f"{side}_rare", F.lit(True)), side, "left")
        gone = gone & F.col("src_rare").isNull() & F.col("tgt_rare").isNull()
    return joined.withColumn("partly", partly).withColumn("prob", F.when(gone, 0.0).otherwise(F.col("prob"))).select(*net.columns)


def rare_groups(cells: DataFrame, min_cells: int = 10) -> DataFrame:
    """(grp): groups of ``min_cells`` cells or fewer in some sample, but not in all together."""
    own = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_cells).select("grp")
    every = cells.select("sample").distinct().join(own)  # samples by groups
    each = every.join(cells.groupBy("sample", "grp").agg(F.count(F.lit(1)).alias("n")), ["sample", "grp"], "left").na.fill(0, ["n"])
    return each.filter(F.col("n") <= min_cells).select("grp").distinct()


def aggregate_net(net: DataFrame, thresh: float = 0.05, sources=None, targets=None, lr_ix=None, remove_isolate: bool = False) -> DataFrame:
    """(src, tgt, count, weight) over interactions; ``remove_isolate`` drops empty pairs."""
    kept = significant(net, thresh)
    for name, wanted in (("src", sources), ("tgt", targets), ("lr_ix", lr_ix)):
        if wanted is not None:
            kept = kept.filter(F.col(name).isin(*wanted))
    out = kept.groupBy("src", "tgt").agg(F.count_if(F.col("prob") > 0).alias("count"), F.sum("prob").alias("weight"))
    return out.filter("count > 0") if remove_isolate else out


def pathway_strengths(net: DataFrame, lr: DataFrame, thresh: float = 0.05) -> DataFrame:
    """(pathway_ix, pathway_name, src, tgt, prob): pathways with any strength, the largest
    total first, ties by first interaction."""
    kept = significant(net, thresh, strict=True).join(F.broadcast(lr.select("lr_ix", "pathway_name")), "lr_ix")
    sums = kept.groupBy("pathway_name", "src", "tgt").agg(F.sum("prob").alias("prob"), F.min("lr_ix").alias("first_ix"))
    totals = sums.groupBy("pathway_name").agg(F.sum("prob").alias("total"), F.min("first_ix").alias("first_ix")).filter("total > 0")
    order = Window.orderBy(F.round("total", 9).desc(), "first_ix")  # as many rows as pathways
    totals = totals.select("pathway_name", F.row_number().over(order).alias("pathway_ix"))
    return sums.join(F.broadcast(totals), "pathway_name").select("pathway_ix", "pathway_name", "src", "tgt", "prob")


def deg_filters(df: DataFrame, **limits: float) -> DataFrame:
    """``pvalues`` at most, ``pct`` at least, ``logFC`` at least, or at most if negative."""
    for name, limit in limits.items():
        if limit is None or name not in df.columns:
            continue
        below = "pvalues" in name or ("logFC" in name and limit < 0)
        df = df.filter(F.col(name) <= limit if below else F.col(name) >= limit)
    return df


def subset_communication(net: DataFrame, lr: DataFrame, thresh: float = 0.05, sources=None, targets=None, signaling=None, pairs=None, **degs) -> DataFrame:
    """Rows with strength and what is known of their interactions."""
    kept = significant(net, thresh).filter("prob > 0").join(F.broadcast(lr), "lr_ix", "left")
    for name, wanted in (("pathway_name", signaling), ("interaction_name", pairs)):
        if wanted is not None:
            kept = kept.filter(F.col(name).isin(*wanted))
    kept = deg_filters(kept, **degs).dropna("all")
    for name, wanted in (("src", sources), ("tgt", targets)):
        if wanted is not None:
            kept = kept.filter(F.col(name).isin(*wanted))
    return kept


def by_pathway(kept: DataFrame) -> DataFrame:
    return kept.groupBy("src", "tgt", "pathway_name").agg(F.sum("prob").alias("prob"), F.avg("pval").alias("pval"))


def pairwise_rank(net: DataFrame) -> DataFrame:
    """Place of each interaction in a pair: p-value ascending, strength descending."""
    order = Window.partitionBy("src", "tgt").orderBy(F.col("pval").asc_nulls_last(), F.round("prob", 9).desc_nulls_last(), "lr_ix")
    return net.withColumn("rnk", F.row_number().over(order))


def enriched(net: DataFrame, source, target, both: bool = False, thresh: float = 0.05) -> DataFrame:
    pair = (F.col("src") == source) & (F.col("tgt") == target)
    if both:
        pair = pair | ((F.col("src") == target) & (F.col("tgt") == source))
    band = F.when(F.col("pval") > 0.05, 1).when(F.col("pval") > 0.01, 2).otherwise(3)
    return net.filter(pair & (F.col("pval") < thresh)).withColumn("band", band).withColumn("prob", F.when(F.col("band") == 1, 0.0).otherwise(F.col("prob")))


def enriched_pairs(net: DataFrame, lr: DataFrame, signaling: str, thresh: float = 0.05) -> DataFrame:
    """Interactions of a pathway with a total strength."""
    kept = significant(net, thresh).join(F.broadcast(lr.filter(F.col("pathway_name") == signaling)), "lr_ix")
    return kept.groupBy("lr_ix", "interaction_name").agg(F.sum("prob").alias("total")).filter("total <> 0")


def find_enriched(kept: DataFrame, features, groups, both_ends: bool = False) -> DataFrame:
    gene = F.col("ligand").isin(*features) | F.col("receptor").isin(*features)
    a, b = F.col("src").isin(*groups), F.col("tgt").isin(*groups)
    return kept.filter(gene & ((a & b) if both_ends else (a | b)))


def merge_groups(agg: DataFrame, mapping: DataFrame) -> DataFrame:
    """(src, tgt, count, weight) rolled up by ``mapping`` (grp, merged)."""
    out = agg
    for side in ("src", "tgt"):
        out = out.join(F.broadcast(mapping.select(F.col("grp").alias(side), F.col("merged").alias(f"{side}_merged"))), side)
    return out.groupBy(F.col("src_merged").alias("src"), F.col("tgt_merged").alias("tgt")).agg(F.sum("count").alias("count"), F.sum("weight").alias("weight"))


def contribution(net: DataFrame, lr: DataFrame, signaling: str, thresh: float = 0.05) -> DataFrame:
    """Share of each interaction in a pathway after scaling strengths to 0..1."""
    kept = significant(net, thresh, strict=True)
    ends = kept.agg(F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    scaled = kept.join(F.broadcast(ends)).withColumn("prob", (F.col("prob") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    sums = scaled.join(F.broadcast(lr.filter(F.col("pathway_name") == signaling).select("lr_ix", "interaction_name")), "lr_ix").groupBy("interaction_name").agg(F.sum("prob").alias("s"))
    return sums.select("interaction_name", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("contribution"))


def flow_transform(total: Column) -> Column:
    """-1 / ln(total), 0 for nothing."""
    return F.when(total <= 0, 0.0).when(total == 1, F.lit(None)).otherwise(-1 / F.ln(total))


def information_flow(netp: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """(pathway_name, *extra, total, flow). Totals of 1 and more, where the transform
    breaks off, are spread over 1.1 to 1.5 times the largest other flow, in order."""
    sums = netp.groupBy("pathway_name", *extra).agg(F.sum("prob").alias("total")).filter("total > 0")
    flagged = F.round("total", 9) >= 1
    sums = sums.withColumn("flow", F.when(~flagged, flow_transform(F.col("total"))))
    order = Window.partitionBy(flagged).orderBy(F.round("total", 9), "pathway_name", *extra)
    sums = sums.withColumn("rn", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(flagged))).withColumn("top", F.coalesce(F.max("flow").over(Window.partitionBy()), F.lit(1.0)))
    step = F.when(F.col("n") > 1, F.col("rn") / (F.col("n") - 1)).otherwise(0.0)
    return sums.select("pathway_name", *extra, "total", F.coalesce("flow", F.col("top") * (1.1 + 0.4 * step)).alias("flow"))


def compare_flow(netp: DataFrame, datasets=(0, 1)) -> DataFrame:
    """``netp`` with ``dataset``: (pathway_name, flow_... of each dataset, ratio of the
    last to the first)."""
    flow = information_flow(netp, ["dataset"])
    wide = flow.groupBy("pathway_name").agg(*(F.coalesce(F.max(F.when(F.col("dataset") == k, F.col("flow"))), F.lit(0.0)).alias(f"flow_{k}") for k in datasets))
    first, last = F.col(f"flow_{datasets[0]}"), F.col(f"flow_{datasets[-1]}")
    return wide.withColumn("ratio", F.when(first > 0, last / first))


@cache
def _signed_counts(n: int) -> tuple[int, ...]:
    """How many choices of signs of the ranks 1..n give each sum."""
    out = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for u in range(len(out) - 1, k - 1, -1):
            out[u] += out[u - k]
    return tuple(out)


@F.pandas_udf(DoubleType())
def _p_of_signed_rank(v: pd.Series, n: pd.Series) -> pd.Series:
    def one(v, n):
        counts, total = _signed_counts(n), 2**n
        return min(1.0, 2 * min(sum(counts[: v + 1]), sum(counts[v:])) / total)

    return pd.Series([one(round(a), int(b)) for a, b in zip(v, n)])


def paired_test(netp: DataFrame) -> DataFrame:
    """(pathway_name, pvalue) between datasets 0 and 1 over the same pairs of groups: exact
    below 50 differences without ties or zeros, else normal."""
    each = signed_rank(netp)
    exact = (F.col("n") < 50) & ~F.col("tied") & (F.col("zeros") == 0)
    safe = lambda c, other: F.when(exact, F.col(c)).otherwise(F.lit(other)).cast("double")
    return each.select("pathway_name", F.when(exact, _p_of_signed_rank(safe("v", 0), safe("n", 1))).otherwise(de.two_sided(F.col("z"))).alias("pvalue"))


def unpaired_test(netp: DataFrame) -> DataFrame:
    """(pathway_name, pvalue) between datasets 0 and 1 with all pairs of groups as two
    samples; pairs without strength count as zeros."""
    ends = netp.select("dataset", F.col("src").alias("g")).union(netp.select("dataset", "tgt")).distinct()
    grid = ends.join(ends.withColumnRenamed("g", "h"), "dataset")  # pairs of groups, a result's shape
    name = lambda a, b: F.concat_ws("|", F.col("dataset").cast("string"), F.col(a).cast("string"), F.col(b).cast("string"))
    cells = grid.select(name("g", "h").alias("cell"), (F.col("dataset") == 0).alias("grp"))
    expr = netp.groupBy("dataset", "src", "tgt", F.col("pathway_name").alias("gene")).agg(F.sum("prob").alias("value")).select(name("src", "tgt").alias("cell"), "gene", "value")
    return de.rank_sums(expr, cells).filter("grp").select(F.col("gene").alias("pathway_name"), de.p_value().alias("pvalue"))


def signed_rank(netp: DataFrame) -> DataFrame:
    """(pathway_name, n, v, z, zeros, tied) of ``netp`` with ``dataset`` 0 or 1: the paired
    test of all pairs of groups, z with tie and continuity corrections. Equal strengths
    are left out, as ``zeros`` tells."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("dataset") == k, F.col("prob"))), F.lit(0.0))
    d = netp.groupBy("pathway_name", "src", "tgt").agg(F.round(of(1) - of(0), 9).alias("d"))
    size = F.abs("d")
    live = d.filter("d <> 0")
    tie = F.count(F.lit(1)).over(Window.partitionBy("pathway_name", size))
    ranked = live.withColumn("t", tie).withColumn("r", F.rank().over(Window.partitionBy("pathway_name").orderBy(size)) + (F.col("t") - 1) / 2)
    each = ranked.groupBy("pathway_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("v"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"))
    n = F.col("n").cast("double")
    gap, var = F.col("v") - n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    zeros = d.groupBy("pathway_name").agg(F.count_if(F.col("d") == 0).alias("zeros"))
    out = each.select("pathway_name", "n", "v", ((gap - 0.5 * F.signum(gap)) / F.sqrt(var)).alias("z"), (F.col("ties") > 0).alias("tied"))
    return out.join(zeros, "pathway_name").select("pathway_name", "n", "v", "z", "zeros", "tied")


def heatmap(agg: DataFrame, measure: str = "weight") -> DataFrame:
    """(src, tgt, value, sent, received): a matrix and the sums of its rows and columns."""
    total = lambda side: F.sum(measure).over(Window.partitionBy(side))
    return agg.select("src", "tgt", F.col(measure).alias("value"), total("src").alias("sent"), total("tgt").alias("received"))


def compare_totals(agg: DataFrame) -> DataFrame:
    return agg.groupBy("dataset").agg(F.sum("count").alias("count"), F.sum("weight").alias("weight"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Second minus first (src, tgt, count, weight); what one lacks counts as 0."""
    one, two = (d.select("src", "tgt", F.col("count").alias(f"c{k}"), F.col("weight").alias(f"w{k}")) for k, d in enumerate((a, b)))
    both = one.join(two, ["src", "tgt"], "full").na.fill(0, ["c0", "c1"]).na.fill(0.0, ["w0", "w1"])
    return both.select("src", "tgt", (F.col("c1") - F.col("c0")).alias("count"), (F.col("w1") - F.col("w0")).alias("weight"))


def bubble(net: DataFrame, lr: DataFrame, thresh: float = 0.05) -> DataFrame:
    kept = subset_communication(net, lr, thresh)
    band = F.when(F.col("pval") > 0.05, 1).when(F.col("pval") > 0.01, 2).otherwise(3)
    return kept.select(F.concat_ws(" -> ", "src", "tgt").alias("source_target"), "interaction_name", "prob", band.alias("band"))


def chord_edges(net: DataFrame, lr: DataFrame, thresh: float = 0.05, by_gene: bool = True) -> DataFrame:
    """(src, tgt, name, start, end, prob): links of a chord diagram with where each begins
    on its source's and ends on its target's arc, the strongest first."""
    kept = subset_communication(net, lr, thresh)
    name = F.concat_ws(" - ", "ligand", "receptor") if by_gene else F.col("pathway_name")
    links = kept.groupBy("src", "tgt", name.alias("name")).agg(F.sum("prob").alias("prob"))

    def before(side):
        order = Window.partitionBy(side).orderBy(F.desc(F.round("prob", 9)), "src", "tgt", "name")
        return F.coalesce(F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))

    return links.select("src", "tgt", "name", before("src").alias("start"), before("tgt").alias("end"), "prob")


def river(patterns: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(pattern, group, pathway, flow) of contributions (kind, name, pattern, contribution):
    groups and pathways joined by the patterns to which both give at least ``cutoff``."""
    side = lambda kind, name: patterns.filter((F.col("kind") == kind) & (F.col("contribution") >= cutoff)).select("pattern", F.col("name").alias(name), F.col("contribution").alias(f"c_{name}"))
    return side("group", "group").join(side("pathway", "pathway"), "pattern").select("pattern", "group", "pathway", F.least("c_group", "c_pathway").alias("flow"))


def dots(netp: DataFrame, patterns: DataFrame, side: str = "src") -> DataFrame:
    """(grp, pathway_name, pattern, size): each group's part in a pathway, under the group's
    foremost pattern, times its contribution."""
    top = Window.partitionBy("name").orderBy(F.desc("contribution"), "pattern")
    first = patterns.filter("kind = 'group'").withColumn("nth", F.row_number().over(top)).filter("nth = 1")
    sums = netp.groupBy(F.col(side).alias("grp"), "pathway_name").agg(F.sum("prob").alias("s"))
    share = sums.withColumn("size", F.col("s") / F.max("s").over(Window.partitionBy("pathway_name")))
    return share.filter("size > 0").join(first, share["grp"].cast("string") == first["name"]).select("grp", "pathway_name", "pattern", (F.col("size") * F.col("contribution")).alias("size"))


def max_weights(aggs: DataFrame, measures=("count", "weight")) -> DataFrame:
    """The largest value of each measure over datasets, for a common scale."""
    return aggs.agg(*(F.max(m).alias(m) for m in measures))


def lift(net: DataFrame, groups: DataFrame) -> DataFrame:
    """The tensor over a superset of groups (grp), new cells without strength."""
    ends = groups.select(F.col("grp").alias("src")).join(F.broadcast(groups.select(F.col("grp").alias("tgt"))))
    grid = net.select("lr_ix").distinct().join(F.broadcast(ends))
    return grid.join(net, ["lr_ix", "src", "tgt"], "left").na.fill({"prob": 0.0, "pval": 1.0})


def import_scores(scores: DataFrame, groups: DataFrame, lr: DataFrame) -> DataFrame:
    """(interaction_name, src, tgt, prob, ix) as a tensor: the last of repeated rows."""
    last = scores.groupBy("interaction_name", "src", "tgt").agg(F.max_by("prob", "ix").alias("prob")).join(F.broadcast(lr.select("lr_ix", "interaction_name")), "interaction_name")
    return lift(last.select("lr_ix", "src", "tgt", "prob", F.lit(0.0).alias("pval")), groups).withColumn("pval", F.lit(0.0))
