"""Queries of the knowledge base: interactions, complexes, cofactors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import ANNOTATIONS

PROTEIN = ("Secreted Signaling", "ECM-Receptor", "Cell-Cell Contact")


def subset_db(lr: DataFrame, search=None, key="annotation", non_protein: bool = False) -> DataFrame:
    """Rows whose keys are among the wanted values, several keys together."""
    keys = [key] if isinstance(key, str) else list(key)
    if search is None:
        wanted = [ANNOTATIONS if non_protein else PROTEIN]
    else:
        wanted = [search] if isinstance(key, str) else search
        wanted = [[w] if isinstance(w, str) else list(w) for w in wanted]
    unknown = [k for k in keys if k not in lr.columns]
    if unknown:
        raise ValueError(f"no such key: {unknown}")
    return reduce(lambda df, kw: df.filter(F.col(kw[0]).isin(*kw[1])), zip(keys, wanted), lr)


def order_by_annotation(lr: DataFrame) -> DataFrame:
    """Rows with ``ord``, by level of annotation and then by place; unknown levels go."""
    rank = F.array_position(F.array(*map(F.lit, ANNOTATIONS)), F.col("annotation"))
    return lr.withColumn("level", rank).filter("level > 0").withColumn("ord", F.row_number().over(Window.orderBy("level", "lr_ix"))).drop("level")


def expand(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(name, ord) to (gene, ord): members of complexes, in place, or the name itself."""
    return names.join(F.broadcast(parts.filter("member <> ''")), "name", "left").select(F.coalesce("member", "name").alias("gene"), "ord", F.coalesce("pos", F.lit(0)).alias("pos"))


def extract_genes(lr: DataFrame, complexes: DataFrame, cofactors: DataFrame) -> DataFrame:
    """(gene, ord) of all ligands, receptors and cofactors in order of first appearance."""
    cols = ("ligand", "receptor", "agonist", "antagonist", "co_a", "co_i")
    names = lr.select("lr_ix", F.posexplode(F.array(*cols)).alias("role", "name")).filter("name <> ''")
    names = names.select("name", (F.col("role") * 1_000_000 + F.col("lr_ix")).alias("ord"))
    genes = expand(names, complexes.unionByName(cofactors))
    first = genes.groupBy("gene").agg(F.min(F.struct("ord", "pos", "gene")).alias("at"))
    return first.select("gene", F.row_number().over(Window.orderBy("at")).alias("ord"))


def lr_from_genes(lr: DataFrame, complexes: DataFrame, genes) -> DataFrame:
    """Interactions that touch a gene: by ligand first, then by receptor."""
    hit = []
    for place, side in enumerate(("ligand", "receptor")):
        touched = expand(lr.select(F.col(side).alias("name"), F.col("lr_ix").alias("ord")), complexes).filter(F.col("gene").isin(*genes)).select(F.col("ord").alias("lr_ix"), F.lit(place).alias("side"))
        hit.append(touched)
    found = hit[0].unionAll(hit[1]).groupBy("lr_ix").agg(F.min("side").alias("side"))
    return found.join(lr, "lr_ix").withColumn("ord", F.row_number().over(Window.orderBy("side", "lr_ix"))).drop("side")


def gene_subset(names: DataFrame, complexes: DataFrame, official: DataFrame) -> DataFrame:
    """(gene, ord) of (name, ord): official symbols as they come, then the members of the
    other names, all first members before all second ones."""
    symbols = official.select(F.col("symbol").alias("name")).distinct()
    own = names.join(symbols, "name", "left_semi").select(F.col("name").alias("gene"), F.lit(0).alias("k"), F.lit(0).alias("pos"), "ord")
    parts = names.join(symbols, "name", "left_anti").join(F.broadcast(complexes.filter("member <> ''")), "name").select(F.col("member").alias("gene"), F.lit(1).alias("k"), "pos", "ord")
    first = own.unionByName(parts).groupBy("gene").agg(F.min(F.struct("k", "pos", "ord")).alias("at"))
    return first.select("gene", F.row_number().over(Window.orderBy("at")).alias("ord"))


def check_symbols(genes: DataFrame, official: DataFrame) -> DataFrame:
    return genes.join(official.select(F.col("symbol").alias("gene")), "gene", "left_anti")


def search_pair(lr: DataFrame, signaling: list[str], key: str = "pathway_name", exact: bool = True) -> DataFrame:
    """Rows that match one of the wanted names, in their order."""
    found = reduce(DataFrame.unionAll, [lr.filter(F.col(key) == s if exact else F.col(key).rlike(s)).withColumn("k", F.lit(k)) for k, s in enumerate(signaling)])
    return found.groupBy(*lr.columns).agg(F.min("k").alias("k")).withColumn("ord", F.row_number().over(Window.orderBy("k", "lr_ix"))).drop("k")


def categories(lr: DataFrame, complexes: DataFrame) -> DataFrame:
    """(annotation, n, share, n_complex): how many, and how many have a complex."""
    named = complexes.select("name").distinct()
    flagged = lr
    for side in ("ligand", "receptor"):
        flagged = flagged.join(F.broadcast(named.select(F.col("name").alias(side), F.lit(1).alias(f"{side}_c"))), side, "left")
    n = flagged.groupBy("annotation").agg(F.count(F.lit(1)).alias("n"), F.count(F.coalesce("ligand_c", "receptor_c")).alias("n_complex"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def update(lr: DataFrame, more: DataFrame, merged: bool = True) -> DataFrame:
    """User rows with defaults for missing columns, the first of a repeated name; with
    ``merged`` after the built-in rows, which win."""
    for c in lr.columns:
        if c not in more.columns:
            more = more.withColumn(c, F.lit("" if c != "lr_ix" else None))
    both = lr.withColumn("origin", F.lit(0)).unionByName(more.select(*lr.columns).withColumn("origin", F.lit(1))) if merged else more.select(*lr.columns).withColumn("origin", F.lit(1))
    first = Window.partitionBy("interaction_name").orderBy("origin", "lr_ix")
    kept = both.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return kept.withColumn("lr_ix", F.row_number().over(Window.orderBy("origin", "lr_ix", "interaction_name"))).drop("origin")


def subset_expression(expr: DataFrame, lr: DataFrame, complexes: DataFrame, cofactors: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Rows of genes that the knowledge base names, with ``ord``, the gene's place in it by
    level of annotation; or of ``features``, in the order given, each once."""
    if features is None:
        ordered = order_by_annotation(lr)
        wanted = extract_genes(ordered.withColumn("lr_ix", F.col("ord")).drop("ord"), complexes, cofactors)
    else:
        names = list(dict.fromkeys(features))
        wanted = expr.sparkSession.createDataFrame([(g, k) for k, g in enumerate(names, 1)], "gene string, ord int")
    return expr.join(wanted.select("gene", "ord"), "gene").select("cell", "gene", "value", "ord")
