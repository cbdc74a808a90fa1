"""The communication kernel: group means to a tensor of strengths and p-values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.blocks import block_means, cut_points
from ..functions.means import geometric, match_kind, numbered
from ..functions.transforms import hill, normalize, scale_by_max
from ..sources.adapters import Study

#: Strengths that differ by this share are equal when replicates are counted.
EQUAL = 1e-12

DIFFUSIBLE = ("Secreted Signaling", "ECM-Receptor", "Non-protein Signaling")


class MissingMember(ValueError):
    """A ligand or receptor has a part that is not measured."""


def members(study: Study, role: str) -> DataFrame:
    """(lr_ix, gene): the gene of a ligand or receptor, or the parts of its complex."""
    own = study.lr.select("lr_ix", F.col(role).alias("name"))
    parts = study.complexes.filter("member <> ''").select("name", "member")
    return own.join(parts, "name", "left").select("lr_ix", F.coalesce("member", "name").alias("gene"))


def check_members(study: Study, genes: DataFrame) -> None:
    wanted = members(study, "ligand").unionByName(members(study, "receptor"))
    lost = [r.gene for r in wanted.join(genes, "gene", "left_anti").select("gene").distinct().limit(20).collect()]
    if lost:
        raise MissingMember(f"not measured: {', '.join(sorted(lost))}")


def role_values(study: Study, means: DataFrame, role: str, by: list[str]) -> DataFrame:
    """(lr_ix, *by, value): the mean of a gene, the geometric mean of a complex."""
    found = means.join(members(study, role), "gene")
    return found.groupBy("lr_ix", *by).agg(F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(geometric(F.col("value"))).alias(role))


def cofactor_values(study: Study, means: DataFrame, role: str, by: list[str], kh: float = 0.5, n: float = 1.0) -> DataFrame:
    """(lr_ix, *by, value): the product over the measured members of a cofactor."""
    x = F.col("value")
    factor = {"co_a": 1 + x, "co_i": 1 + x, "agonist": 1 + hill(x, kh, n), "antagonist": 1 - hill(x, kh, n)}[role]
    named = study.lr.filter(F.col(role) != "").select("lr_ix", F.col(role).alias("name"))
    genes = named.join(study.cofactors.filter("member <> ''"), "name").select("lr_ix", F.col("member").alias("gene"))
    return means.join(genes, "gene").groupBy("lr_ix", *by).agg(F.product(factor).alias(role))


def lr_values(study: Study, means: DataFrame, by: list[str], kh: float, n: float) -> DataFrame:
    out = role_values(study, means, "ligand", by).join(role_values(study, means, "receptor", by), ["lr_ix", *by])
    for role in ("co_a", "co_i", "agonist", "antagonist"):
        out = out.join(cofactor_values(study, means, role, by, kh, n), ["lr_ix", *by], "left").na.fill(1.0, [role])
    return out.withColumn("receptor", F.col("receptor") * F.col("co_a") / F.col("co_i")).drop("co_a", "co_i")


def pair_strengths(values: DataFrame, kh: float, n: float, more: list[str] = []) -> DataFrame:  # noqa: B006
    """(lr_ix, *more, src, tgt, prob): every source with every target of an interaction.
    The number of groups bounds the pairs of each."""
    keys = ["lr_ix", *more]
    a = values.select(*keys, F.col("grp").alias("src"), "ligand", F.col("agonist").alias("ag_a"), F.col("antagonist").alias("an_a"))
    b = values.select(*keys, F.col("grp").alias("tgt"), "receptor", F.col("agonist").alias("ag_b"), F.col("antagonist").alias("an_b"))
    p1 = hill(F.col("ligand") * F.col("receptor"), kh, n)
    return a.join(b, keys).select(*keys, "src", "tgt", (p1 * (F.col("ag_a") * F.col("ag_b")) * (F.col("an_a") * F.col("an_b"))).alias("prob"))


def contact_weights(lr: DataFrame, spatial: DataFrame, contact_dependent: bool = True, forced: bool = False) -> DataFrame:
    """(lr_ix, src, tgt, weight) of ``spatial`` (src, tgt, weight, contact), as
    ``communicate`` weighs pairs: interactions after the last diffusible one act between
    groups in contact only; with ``forced`` all do, without ``contact_dependent`` none."""
    last = lr.agg(F.max(F.when(F.col("annotation").isin(*DIFFUSIBLE), F.col("lr_ix")))).first()[0] or 0
    touching = F.lit(True) if forced else (F.col("lr_ix") > last) if contact_dependent else F.lit(False)
    every = lr.agg(F.collect_list("lr_ix").alias("ix")).first()["ix"]  # interactions of the knowledge base
    grid = spatial.select("*", F.explode(F.array(*map(F.lit, every)).cast("array<int>")).alias("lr_ix"))
    return grid.select("lr_ix", "src", "tgt", (F.col("weight") * F.when(touching, F.col("contact")).otherwise(1)).alias("weight"))


def replicate_labels(cells: DataFrame, groups: list[tuple], permutations: np.ndarray) -> DataFrame:
    """(cell, dealt) for explicit ``permutations`` [replicates, cells], 0-based over the
    cells in the order of their ids: uint16 group numbers as bytes."""
    rows = [(r["cell"], r["grp"]) for r in cells.select("cell", "grp").orderBy("cell").collect()]
    code = {g[0]: k for k, g in enumerate(groups)}
    own = np.array([code[g] for _, g in rows], "<u2")
    dealt = own[permutations].T
    kind = dict(cells.dtypes)["cell"]
    return cells.sparkSession.createDataFrame([(c, bytearray(d.tobytes())) for (c, _), d in zip(rows, dealt)], f"cell {kind}, dealt binary")


def prepared(study: Study, log: bool = True) -> Study:
    return study.with_(expr=scale_by_max(normalize(study.expr, log=log)))


def check_observed_means(study: Study, kind: str) -> None:
    """A thresholded mean has no answer where a value is missing, in whatever gene."""
    if kind == "thresholdedMean":
        lost = study.expr.filter(F.col("value").isNull() | F.isnan("value")).select("gene").distinct().limit(20).collect()
        if lost:
            raise MissingMember(f"no observed mean: {', '.join(sorted(r.gene for r in lost))}")


ROLES = ("ligand", "receptor", "co_a", "co_i", "agonist", "antagonist")


def _roles(study: Study) -> DataFrame:
    """(lr_ix, role, gene) of everything an interaction reads."""
    out = None
    for role in ROLES[:2]:
        one = members(study, role).withColumn("role", F.lit(role))
        out = one if out is None else out.unionByName(one)
    parts = study.cofactors.filter("member <> ''").select("name", F.col("member").alias("gene"))
    for role in ROLES[2:]:
        named = study.lr.filter(F.col(role) != "").select("lr_ix", F.col(role).alias("name"))
        out = out.unionByName(named.join(parts, "name").select("lr_ix", "gene", F.lit(role).alias("role")))
    return out


def _tensor(groups: list, shape: tuple[int, int], kh: float, n: float, share: np.ndarray, weight: np.ndarray, contact: np.ndarray | None, first_contact: int, group_type: pa.DataType):
    """One interaction's strengths and p-values from the means of its genes."""
    rows, k = shape
    src, tgt = pa.array([g for g in groups for _ in groups], group_type), pa.array([g for _ in groups for g in groups], group_type)

    def hill_of(x):
        x = x**n
        return x / (kh**n + x)

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ix = key[0].as_py()
        found: dict[str, list[np.ndarray]] = {r: [] for r in ROLES}
        order = sorted(zip(t["role"].to_pylist(), t["gene"].to_pylist(), t["means"].to_pylist()), key=lambda r: r[:2])
        for role, _, m in order:
            found[role].append(np.frombuffer(m, "<f8").reshape(rows, k) if m else np.zeros(shape))

        def mean(own):
            if len(own) == 1:
                return own[0]
            with np.errstate(divide="ignore"):
                return np.exp(np.mean(np.log(own), axis=0))

        def product(own, factor):
            return np.prod([factor(x) for x in own], axis=0) if own else np.ones(shape)

        ligand, receptor = mean(found["ligand"]), mean(found["receptor"])
        receptor = receptor * product(found["co_a"], lambda x: 1 + x) / product(found["co_i"], lambda x: 1 + x)
        agonist, antagonist = product(found["agonist"], lambda x: 1 + hill_of(x)), product(found["antagonist"], lambda x: 1 - hill_of(x))
        place = weight * contact if contact is not None and ix >= first_contact else weight

        def strengths(b: int) -> np.ndarray:
            pair = lambda x: x[b][:, None] * x[b][None, :]
            return hill_of(ligand[b][:, None] * receptor[b][None, :]) * pair(agonist) * pair(antagonist) * (share[:, None] * share[None, :]) * place

        seen = strengths(0)
        above = np.zeros((k, k), np.int64)
        if seen.any():
            for b in range(1, rows):
                above += strengths(b) > seen * (1 + EQUAL)
        pval = np.where(seen == 0, 1.0, above / max(1, rows - 1))
        return pa.table({"lr_ix": pa.array([ix] * k * k, pa.int32()), "src": src, "tgt": tgt, "prob": seen.ravel(), "pval": pval.ravel()})

    return one


def communicate(
    study: Study, kind: str = "triMean", trim: float = 0.1, population: bool = False, nboot: int = 100, kh: float = 0.5, n: float = 1.0,
    spatial: DataFrame | None = None, contact_dependent: bool = True, contact_forced: bool = False, seed: int | None = None,
) -> DataFrame:
    """(lr_ix, src, tgt, prob, pval) of a prepared study.

    A replicate deals the groups anew among the cells; the p-value is the share of
    replicates with a larger strength, and 1 where the strength is 0. Strengths within
    rounding (1e-12 of each other) are equal. Without a ``seed`` labels follow hashes of
    the cells' ids (see ``blocks``); with one, the permutations are those that the
    classic generator draws for it, in sequence on the driver.

    ``spatial``: (src, tgt, weight) and, if places in contact matter, (contact); then
    interactions after the last diffusible one act between groups in contact only, all
    of them if ``contact_forced``. Every part of a ligand or receptor must be measured."""
    kind = match_kind(kind)
    genes = study.expr.select("gene").distinct()
    check_members(study, genes)
    check_observed_means(study, kind)
    groups, sizes, labels = numbered(study.cells, ["grp"])
    if any(g == (None,) for g in groups):
        raise ValueError("a cell has no group")
    n_cells, names = sum(sizes), [g[0] for g in groups]
    cuts, dealt = None, 0
    if nboot and seed is not None:
        labels = labels.join(replicate_labels(study.cells, groups, rng.replicates(n_cells, nboot, seed)), "cell")
        dealt = nboot
    elif nboot:
        cuts = cut_points(labels.select("x"), sizes, nboot)
    wanted = _roles(study)
    some = study.expr.join(wanted.select("gene").distinct(), "gene", "left_semi")
    means = block_means(some, labels, sizes, kind, trim, cuts, dealt)
    share = np.array(sizes) / n_cells if population else np.ones(len(sizes))
    weight, contact, first = np.ones((len(names), len(names))), None, 0
    if spatial is not None:
        at = {g: k for k, g in enumerate(names)}
        weight = np.zeros_like(weight)
        touching = "contact" in spatial.columns and (contact_dependent or contact_forced)
        contact = np.zeros_like(weight) if touching else None
        for r in spatial.collect():  # groups by groups
            if r["src"] in at and r["tgt"] in at:
                weight[at[r["src"]], at[r["tgt"]]] = r["weight"] or 0.0
                if touching:
                    contact[at[r["src"]], at[r["tgt"]]] = r["contact"] or 0.0
        if not contact_forced:
            first = 1 + (study.lr.agg(F.max(F.when(F.col("annotation").isin(*DIFFUSIBLE), F.col("lr_ix")))).first()[0] or 0)
    read = wanted.join(genes, "gene").join(means, "gene", "left")
    group_type = dict(study.cells.dtypes)["grp"]
    arrow_type = study.cells.select("grp").limit(0).toArrow().schema.field(0).type
    run = _tensor(names, (1 + nboot, len(names)), kh, n, share, weight, contact, first, arrow_type)
    return read.groupBy("lr_ix").applyInArrow(run, f"lr_ix int, src {group_type}, tgt {group_type}, prob double, pval double")
