"""Registered queries of the engine; ``oracle`` has the SQL of the same names."""

from __future__ import annotations

from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import written
from ..functions import transforms as T
from ..functions.means import group_means
from ..operators import de, graph, kb, kernel, learn, merge, net, spatial
from ..sources import adapters
from ..streaming.incremental import windowed_means
from . import oracle

#: Replicates, and the threshold of p-values: the operators' defaults.
NBOOT = 100
THRESH = 0.05
PAIRS = ("lr_ix", "src", "tgt")
_studies: WeakKeyDictionary = WeakKeyDictionary()


def _study(spark: SparkSession, sf_dir: str) -> adapters.Study:
    """Normalised and scaled; written once for the session that asks for it."""
    held = _studies.setdefault(spark, {})
    if sf_dir not in held:
        raw = adapters.retail(spark, sf_dir)
        raw = raw.with_(expr=written(raw.expr, "expr"), cells=written(raw.cells, "cells"))
        held[sf_dir] = raw.with_(expr=written(kernel.prepared(raw).expr, "prepared"))
    return held[sf_dir]


def _net(spark, sf_dir, **more) -> DataFrame:
    return kernel.communicate(_study(spark, sf_dir), nboot=more.pop("nboot", NBOOT), **more)


def _kept_for(spark, sf_dir, name: str, make) -> DataFrame:
    """A small result that several queries of a session read."""
    _study(spark, sf_dir)
    held = _studies[spark]
    if (sf_dir, name) not in held:
        held[sf_dir, name] = written(make(), name)
    return held[sf_dir, name]


def _seen(spark, sf_dir) -> DataFrame:
    """The tensor with p-values by permutation, made once for the reads of a session."""
    return _kept_for(spark, sf_dir, "seen", lambda: _net(spark, sf_dir))


def _netp(spark, sf_dir) -> DataFrame:
    return _kept_for(spark, sf_dir, "netp", lambda: net.pathway_strengths(_seen(spark, sf_dir), _study(spark, sf_dir).lr, THRESH))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _lr(spark) -> DataFrame:
    return adapters.knowledge_base(spark)["lr"]


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
    return f


def _raw(spark, sf_dir):
    return adapters.retail(spark, sf_dir)


@query
def norm_log1p(spark, sf_dir):
    return T.normalize(_raw(spark, sf_dir).expr).select("cell", "gene", "value")


@query
def global_max_scale(spark, sf_dir):
    return T.scale_by_max(T.normalize(_raw(spark, sf_dir).expr)).select("cell", "gene", "value")


@query
def scale_zscore(spark, sf_dir):
    s = _study(spark, sf_dir)
    return T.zscore(s.expr, s.cells.agg(F.count(F.lit(1)).alias("n")))


@query
def scale_l1(spark, sf_dir):
    return T.l1(_study(spark, sf_dir).expr, "gene").select("cell", "gene", "value")


def _mean_query(kind: str, trim: float):
    def run(spark, sf_dir):
        s = _study(spark, sf_dir)
        return group_means(s.expr, s.cells, kind, trim)

    run.__name__ = "avg_" + kind.removesuffix("Mean").lower()
    return query(run)


for _kind, _trim in (("triMean", 0.1), ("truncatedMean", 0.1), ("thresholdedMean", 0.8), ("median", 0.1), ("mean", 0.1)):
    _mean_query(_kind, _trim)


@query
def kb_subset(spark, sf_dir):
    return kb.subset_db(_lr(spark)).select("lr_ix", "interaction_name", "annotation")


@query
def kb_order(spark, sf_dir):
    return kb.order_by_annotation(_lr(spark)).select("ord", "interaction_name")


@query
def kb_extract_genes(spark, sf_dir):
    b = adapters.knowledge_base(spark)
    return kb.extract_genes(b["lr"], b["complexes"], b["cofactors"])


@query
def kb_search_pair(spark, sf_dir):
    return kb.search_pair(_lr(spark), ["PC", "PA"]).select("ord", "interaction_name")


@query
def kb_pairs_of_genes(spark, sf_dir):
    b = adapters.knowledge_base(spark)
    return kb.lr_from_genes(b["lr"], b["complexes"], ["Brand#1", "Brand#14"]).select("ord", "interaction_name")


@query
def kb_category(spark, sf_dir):
    b = adapters.knowledge_base(spark)
    return kb.categories(b["lr"], b["complexes"])


@query
def lr_expr(spark, sf_dir):
    s = _study(spark, sf_dir)
    means = group_means(s.expr, s.cells)
    return kernel.role_values(s, means, "ligand", ["grp"]).join(kernel.role_values(s, means, "receptor", ["grp"]), ["lr_ix", "grp"])


def _cofactor_query(name: str, role: str):
    def run(spark, sf_dir):
        s = _study(spark, sf_dir)
        return kernel.cofactor_values(s, group_means(s.expr, s.cells), role, ["grp"]).withColumnRenamed(role, "value")

    run.__name__ = name
    return query(run)


for _name, _role in (("coreceptor_a", "co_a"), ("coreceptor_i", "co_i"), ("agonist", "agonist"), ("antagonist", "antagonist")):
    _cofactor_query(_name, _role)


@query
def commun_prob(spark, sf_dir):
    return _net(spark, sf_dir, nboot=0).select(*PAIRS, "prob")


@query
def commun_prob_population(spark, sf_dir):
    return _net(spark, sf_dir, nboot=0, population=True).select(*PAIRS, "prob")


@query
def commun_pval(spark, sf_dir):
    return _net(spark, sf_dir)


@query
def filter_min_cells(spark, sf_dir):
    s = _study(spark, sf_dir)
    few = s.cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    return net.filter_min_cells(_seen(spark, sf_dir), s.cells, few).select(*PAIRS, "prob")


def _support(spark, sf_dir) -> DataFrame:
    s = _study(spark, sf_dir)
    means = group_means(s.expr, s.cells, "thresholdedMean", 0.8, by=("sample", "grp"))
    own = kernel.lr_values(s, means, ["sample", "grp"], 0.5, 1.0)
    pairs = kernel.pair_strengths(own, 0.5, 1.0, ["sample"]).filter("prob > 0")
    return pairs.groupBy(*PAIRS).agg(F.count(F.lit(1)).alias("n"))


@query
def filter_min_samples(spark, sf_dir):
    return net.filter_min_samples(_seen(spark, sf_dir), _support(spark, sf_dir), 2).select(*PAIRS, "prob")


@query
def aggregate_net(spark, sf_dir):
    return net.aggregate_net(_seen(spark, sf_dir), THRESH)


@query
def aggregate_net_filtered(spark, sf_dir):
    return net.aggregate_net(_seen(spark, sf_dir), THRESH, sources=["BUILDING", "MACHINERY"], lr_ix=[1, 2, 3, 4], remove_isolate=True)


@query
def pathway_prob(spark, sf_dir):
    return _netp(spark, sf_dir)


def _kept(spark, sf_dir) -> DataFrame:
    return net.subset_communication(_seen(spark, sf_dir), _study(spark, sf_dir).lr, THRESH)


@query
def subset_comm(spark, sf_dir):
    return _kept(spark, sf_dir).select("src", "tgt", "ligand", "receptor", "prob", "pval", "interaction_name", "pathway_name", "annotation")


@query
def subset_comm_netp(spark, sf_dir):
    return net.by_pathway(_kept(spark, sf_dir))


@query
def find_enriched(spark, sf_dir):
    return net.find_enriched(_kept(spark, sf_dir), ["Brand#1", "CX1"], ["BUILDING"]).select("src", "tgt", "interaction_name", "prob")


@query
def pairwise_rank(spark, sf_dir):
    return net.pairwise_rank(_seen(spark, sf_dir)).select(*PAIRS, "rnk")


@query
def enriched_interactions(spark, sf_dir):
    return net.enriched(_seen(spark, sf_dir), "BUILDING", "MACHINERY", both=True, thresh=THRESH).select(*PAIRS, "prob", "band")


@query
def enriched_pairs(spark, sf_dir):
    return net.enriched_pairs(_seen(spark, sf_dir), _lr(spark), "PB", THRESH)


@query
def contribution(spark, sf_dir):
    return net.contribution(_seen(spark, sf_dir), _lr(spark), "PA", THRESH)


@query
def rank_net(spark, sf_dir):
    return net.information_flow(_netp(spark, sf_dir))


def _datasets(spark, sf_dir) -> DataFrame:
    """The tensor of each sample on its own, as two datasets."""
    return _kept_for(spark, sf_dir, "datasets", lambda: _by_sample(spark, sf_dir))


def _by_sample(spark, sf_dir) -> DataFrame:
    s, parts = _study(spark, sf_dir), []
    for k in (0, 1):
        cells = s.cells.filter(F.col("sample") == k)
        one = kernel.communicate(s.with_(cells=cells, expr=s.expr.join(cells.select("cell"), "cell", "left_semi")), nboot=0)
        parts.append(one.withColumn("dataset", F.lit(k)))
    return parts[0].unionByName(parts[1])


@query
def rank_net_compare(spark, sf_dir):
    both = _datasets(spark, sf_dir).join(F.broadcast(_lr(spark).select("lr_ix", "pathway_name")), "lr_ix")
    return net.compare_flow(both)


@query
def compare_totals(spark, sf_dir):
    rows = _datasets(spark, sf_dir).groupBy("dataset", "src", "tgt").agg(F.count_if(F.col("prob") > 0).alias("count"), F.sum("prob").alias("weight"))
    return net.compare_totals(rows)


@query
def diff_net(spark, sf_dir):
    both = _datasets(spark, sf_dir)
    one, two = (net.aggregate_net(both.filter(F.col("dataset") == k), 2.0) for k in (0, 1))
    return net.difference(one, two)


@query
def max_weight(spark, sf_dir):
    return _datasets(spark, sf_dir).groupBy("dataset", "src", "tgt").agg(F.sum("prob").alias("weight")).agg(F.max("weight").alias("weight"))


@query
def merge_groups(spark, sf_dir):
    cells = _study(spark, sf_dir).cells
    mapping = cells.select("grp").distinct().withColumn("merged", F.when(F.length("grp") > 9, "long").otherwise("short"))
    return net.merge_groups(net.aggregate_net(_seen(spark, sf_dir), THRESH), mapping)


@query
def bubble(spark, sf_dir):
    return net.bubble(_seen(spark, sf_dir), _lr(spark), THRESH)


@query
def lift(spark, sf_dir):
    groups = _study(spark, sf_dir).cells.select("grp").distinct().union(spark.createDataFrame([("NEW",)], "grp string"))
    return net.lift(_seen(spark, sf_dir).select(*PAIRS, "prob", "pval"), groups)


@query
def score_import(spark, sf_dir):
    seen = _seen(spark, sf_dir).join(_lr(spark).select("lr_ix", "interaction_name"), "lr_ix")
    scores = seen.select("interaction_name", "src", "tgt", (F.col("prob") * 2).alias("prob"), F.lit(1).alias("ix")).unionAll(seen.filter("src = tgt").select("interaction_name", "src", "tgt", "prob", F.lit(2)))
    return net.import_scores(scores, _study(spark, sf_dir).cells.select("grp").distinct(), _lr(spark))


@query
def de_pct_fc(spark, sf_dir):
    s = _study(spark, sf_dir)
    return de.shares(s.expr, s.cells)


@query
def wilcox_w(spark, sf_dir):
    s = _study(spark, sf_dir)
    return de.rank_sums(s.expr, s.cells).drop("tied")


@query
def de_markers(spark, sf_dir):
    s = _study(spark, sf_dir)
    return de.markers(s.expr, s.cells, 25, thresh_p=0.9).select("gene", "grp", "pvalues", "pvalues_adj", "rnk")


@query
def de_expressed(spark, sf_dir):
    return de.expressed(_study(spark, sf_dir).expr, 100)


def _marked(spark, sf_dir) -> DataFrame:
    s = _study(spark, sf_dir)
    return de.shares(s.expr, s.cells).filter("logfc > 0.005")


@query
def lr_overexpressed(spark, sf_dir):
    s = _study(spark, sf_dir)
    return de.over_expressed(s.lr, s.complexes, _marked(spark, sf_dir), s.expr.select("gene").distinct()).select("lr_ix", "interaction_name")


def _mapped(spark, sf_dir) -> DataFrame:
    s = _study(spark, sf_dir)
    return de.map_degs(_kept(spark, sf_dir), de.shares(s.expr, s.cells), s.complexes)


@query
def map_deg(spark, sf_dir):
    return _mapped(spark, sf_dir).select("src", "tgt", "interaction_name", "ligand_logfc", "ligand_pct_1", "receptor_logfc", "receptor_pct_2")


@query
def enrichment(spark, sf_dir):
    # scores are products of small differences: scaled, so that rounding keeps digits
    return de.enrichment(_mapped(spark, sf_dir)).withColumn("score", F.col("score") * 1e6).withColumn("score", F.round("score", 3))


@query
def degree_strength(spark, sf_dir):
    return graph.degrees(_netp(spark, sf_dir))


@query
def signaling_role(spark, sf_dir):
    return graph.signaling_roles(_netp(spark, sf_dir))


@query
def role_scatter(spark, sf_dir):
    return graph.role_scatter(_netp(spark, sf_dir))


@query
def similarity_functional(spark, sf_dir):
    return graph.functional_similarity(_netp(spark, sf_dir))


@query
def knn_topk(spark, sf_dir):
    return spatial.knn(adapters.spatial(spark, sf_dir), 5)


@query
def snn(spark, sf_dir):
    near = spatial.knn(adapters.spatial(spark, sf_dir), 4).select("node", "neighbour")
    return graph.snn(near.union(near.select("node", F.col("node").alias("neighbour")).distinct()), 5)


@query
def cell_distance(spark, sf_dir):
    return spatial.cell_distances(adapters.spatial(spark, sf_dir), 20.0, tol=0.5)


@query
def region_distance(spark, sf_dir):
    return spatial.region_distances(adapters.spatial(spark, sf_dir), 60.0, k_min=3)


@query
def contact_overlap(spark, sf_dir):
    return spatial.contact_overlap(adapters.spatial(spark, sf_dir), 5, 60.0, k_min=2)


@query
def spatial_weight(spark, sf_dir):
    return spatial.weights(spatial.region_distances(adapters.spatial(spark, sf_dir), 60.0, k_min=3))


@query
def commun_prob_contact(spark, sf_dir):
    s, places = _study(spark, sf_dir), adapters.places(spark, sf_dir)
    regions = spatial.region_distances(places, 250.0, k_min=3)
    near = spatial.weights(regions).join(regions.select("src", "tgt", F.col("adjacent").alias("contact")), ["src", "tgt"])
    return kernel.communicate(s, nboot=0, spatial=near).select(*PAIRS, "prob")


def _dataset_pathways(spark, sf_dir) -> DataFrame:
    both = _datasets(spark, sf_dir).join(F.broadcast(_lr(spark).select("lr_ix", "pathway_name")), "lr_ix")
    return both.groupBy("dataset", "pathway_name", "src", "tgt").agg(F.sum("prob").alias("prob"))


@query
def similarity_pairwise(spark, sf_dir):
    return graph.similarity_between(_dataset_pathways(spark, sf_dir))


@query
def rank_similarity(spark, sf_dir):
    places = _dataset_pathways(spark, sf_dir).groupBy("dataset", "pathway_name").agg(F.array(F.sum("prob"), F.max("prob")).alias("dims"))
    return graph.rank_similarity(places)


@query
def rank_net_test(spark, sf_dir):
    return net.signed_rank(_dataset_pathways(spark, sf_dir))


@query
def heatmap(spark, sf_dir):
    return net.heatmap(net.aggregate_net(_seen(spark, sf_dir), THRESH))


@query
def pathway_entropy(spark, sf_dir):
    share = F.col("prob") / F.sum("prob").over(Window.partitionBy("pathway_name"))
    return _netp(spark, sf_dir).withColumn("share", share).groupBy("pathway_name").agg(T.entropy(F.col("share")).alias("entropy"))


@query
def de_fast(spark, sf_dir):
    s = _study(spark, sf_dir)
    return de.quick_markers(s.expr, s.cells, thresh_p=1.1, only_pos=False).select("gene", "grp", "logfc", "pct_1", "pct_2", "z")


@query
def de_datasets(spark, sf_dir):
    s = _study(spark, sf_dir)
    return de.dataset_markers(s.expr, s.cells, 1).select("gene", "grp", "pct_1", "pct_2", "logfc", "z")


@query
def min_max_threshold(spark, sf_dir):
    return merge.min_max_threshold(_raw(spark, sf_dir).expr, 0.5).select("cell", "gene", "value")


def _symbols(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("symbol")).distinct()


@query
def kb_gene_subset(spark, sf_dir):
    names = spark.createDataFrame([("CX1", 1), ("Brand#2", 2), ("CX3", 3), ("Brand#1", 4)], "name string, ord int")
    return kb.gene_subset(names, adapters.knowledge_base(spark)["complexes"], _symbols(spark, sf_dir))


@query
def kb_check_symbols(spark, sf_dir):
    b = adapters.knowledge_base(spark)
    return kb.check_symbols(b["cofactors"].select(F.col("member").alias("gene")), _symbols(spark, sf_dir))


@query
def kb_update(spark, sf_dir):
    more = spark.createDataFrame([("B1_B2", "Brand#5", "Brand#6"), ("NEW", "Brand#20", "Brand#21")], "interaction_name string, ligand string, receptor string")
    return kb.update(_lr(spark), more).select("lr_ix", "interaction_name", "ligand", "pathway_name")


@query
def merge_datasets(spark, sf_dir):
    s = _raw(spark, sf_dir)
    parts = {}
    for k in (0, 1):
        cells = s.cells.filter(F.col("sample") == k)
        parts[f"d{k}"] = s.with_(cells=cells, expr=s.expr.join(cells.select("cell"), "cell", "left_semi"))
    both = merge.merge(parts)
    return both.expr.join(both.cells.select("cell", "grp"), "cell").groupBy("dataset", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query
def window_means(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("grp"), "value")
    out = windowed_means(events, "1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "grp", "n", "nnz", "mean")


@query
def centrality(spark, sf_dir):
    return graph.centrality(_netp(spark, sf_dir))


@query
def similarity_structural(spark, sf_dir):
    return graph.structural_similarity(_netp(spark, sf_dir))


@query
def nmf_patterns(spark, sf_dir):
    return learn.patterns(_netp(spark, sf_dir), 2)


@query
def kmeans(spark, sf_dir):
    rows = learn.role_matrix(_netp(spark, sf_dir)).groupBy(F.col("grp").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pathway_name", "value"))), lambda x: x["value"]).alias("features"))
    return learn.clusters(rows, 2)


@query
def pca(spark, sf_dir):
    return learn.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")), 2)


@query
def smooth(spark, sf_dir):
    edges = _lr(spark).filter("ligand like 'Brand%' and receptor like 'Brand%'").select(F.col("ligand").alias("g1"), F.col("receptor").alias("g2"))
    return learn.smooth(_study(spark, sf_dir).expr, edges)


@query
def chord_edges(spark, sf_dir):
    return net.chord_edges(_seen(spark, sf_dir), _lr(spark), THRESH)


@query
def side_markers(spark, sf_dir):
    s = _study(spark, sf_dir)
    return de.side_markers(_marked(spark, sf_dir).select("gene", "grp"), s.lr, s.complexes)


@query
def filter_rare_kept(spark, sf_dir):
    rare = net.rare_groups(_study(spark, sf_dir).cells, 100)
    return net.filter_min_samples(_seen(spark, sf_dir), _support(spark, sf_dir), 2, rare).select(*PAIRS, "prob")


@query
def role_changes(spark, sf_dir):
    both = _dataset_pathways(spark, sf_dir)
    return graph.role_changes(*(both.filter(F.col("dataset") == k) for k in (0, 1)))


@query
def subset_expression(spark, sf_dir):
    s = _study(spark, sf_dir)
    return kb.subset_expression(s.expr, s.lr, s.complexes, s.cofactors).select("cell", "gene", "value")


@query
def subset_groups(spark, sf_dir):
    some = merge.subset(_raw(spark, sf_dir), groups=["BUILDING", "MACHINERY", "FURNITURE"])
    cells = merge.relabel(some.cells, {"BUILDING": "heavy", "MACHINERY": "heavy"})
    return some.expr.join(cells, "cell").groupBy("grp").agg(F.count_distinct("cell").alias("n"), F.sum("value").alias("total"))


@query
def mean_by_sample(spark, sf_dir):
    s = _study(spark, sf_dir)
    return group_means(s.expr, s.cells, "mean", by=("sample", "grp"))


@query
def max_weights(spark, sf_dir):
    rows = _datasets(spark, sf_dir).groupBy("dataset", "src", "tgt").agg(F.count_if(F.col("prob") > 0).alias("count"), F.sum("prob").alias("weight"))
    return net.max_weights(rows)


@query
def paired_test(spark, sf_dir):
    return net.paired_test(_dataset_pathways(spark, sf_dir))


@query
def unpaired_test(spark, sf_dir):
    return net.unpaired_test(_dataset_pathways(spark, sf_dir))


@query
def select_k(spark, sf_dir):
    return learn.select_k(_netp(spark, sf_dir))


@query
def cluster_pathways(spark, sf_dir):
    return learn.cluster_pathways(learn.laplacian_embedding(graph.similarity_between(_dataset_pathways(spark, sf_dir))))


@cache
def _sql() -> dict[str, str]:
    return {k: v for k, v in oracle.queries().items() if k in QUERIES}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_sql())
