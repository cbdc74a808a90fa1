"""A study as one tagged text file with lossless numbers, and results in the same manner.

Blocks follow each other: sizes, names of groups and genes, a line of values for each
gene, names and groups of cells, interactions, and the parameters of the kernel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from .adapters import ANNOTATIONS, LR_COLUMNS, Study

# Fixed names of the format.
PAIR_COLUMNS = ("interaction_name", "ligand", "receptor", "agonist", "antagonist", "co_A_receptor", "co_I_receptor")
PARAMETERS = {"type": str, "trim": float, "population_size": None, "raw_use": None, "nboot": int, "seed": int, "Kh": float, "n": float}


def hex_float(x: float) -> str:
    """Shortest hexadecimal form: no zeros at the end of the mantissa."""
    text = float(x).hex()
    if "p" not in text:
        return text
    mantissa, exponent = text.split("p")
    return f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa else mantissa}p{exponent}"


def plain_float(x: float) -> str:
    return format(float(x), ".17g")


@dataclass
class TextInput:
    groups: list[str]
    genes: list[str]
    cells: list[str]
    cell_group: list[int]
    values: np.ndarray  # genes by cells
    smooth: np.ndarray | None
    pairs: list[tuple[str, ...]]
    config: dict


def _flag(text: str) -> bool:
    known = {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}
    if text.strip().lower() not in known:
        raise ValueError(f"{text!r} is neither true nor false")
    return known[text.strip().lower()]


def parse(text: str) -> TextInput:
    lines = text.split("\n")
    at = 0

    def line() -> str:
        nonlocal at
        if at >= len(lines):
            raise ValueError("the file ends early")
        at += 1
        return lines[at - 1].rstrip("\r")

    def tagged(tag: str) -> str:
        name, _, rest = line().partition("\t")
        if name != tag:
            raise ValueError(f"line {at}: {tag} expected, {name!r} found")
        return rest

    def block(count: int, width: int, read) -> list:
        out = []
        for _ in range(count):
            row = [read(v) for v in line().split()]
            if len(row) != width:
                raise ValueError(f"line {at}: {len(row)} values where {width} belong")
            out.append(row)
        return out

    if tagged("version").strip() != "1":
        raise ValueError("only version 1 is read")
    n = {k: int(tagged(k)) for k in ("groups", "genes", "cells", "lr")}
    if not all(n.values()):
        raise ValueError("a dimension is zero")
    groups, genes = [line() for _ in range(n["groups"])], [line() for _ in range(n["genes"])]
    tagged("values")
    values, smooth = np.array(block(n["genes"], n["cells"], float.fromhex)), None
    if at < len(lines) and lines[at].startswith("values_smooth"):
        tagged("values_smooth")
        smooth = np.array(block(n["genes"], n["cells"], float.fromhex))
    cells = [line() for _ in range(n["cells"])]
    tagged("cell_group")
    own = block(1, n["cells"], int)[0]
    if any(not 0 <= g < n["groups"] for g in own):
        raise ValueError("a cell is in a group that is not there")
    if tuple(tagged("lr_columns").split("\t")) != PAIR_COLUMNS:
        raise ValueError("columns of interactions differ from the format's")
    pairs = []
    for _ in range(n["lr"]):
        row = tuple(f.strip() for f in line().split("\t"))
        if len(row) != len(PAIR_COLUMNS):
            raise ValueError(f"line {at}: {len(row)} fields where {len(PAIR_COLUMNS)} belong")
        pairs.append(row)
    config = {k: (read or _flag)(tagged(k).strip()) for k, read in PARAMETERS.items()}
    if config["raw_use"] == (smooth is not None):
        raise ValueError("smoothed values belong to raw_use false, and to nothing else")
    return TextInput(groups, genes, cells, own, values, smooth, pairs, config)


def to_study(spark: SparkSession, own: TextInput, complexes=(), cofactors=()) -> Study:
    """The values that the kernel is to read, over their largest; cells and groups by
    their numbers, as names need not sort in the file's order. ``complexes`` and
    ``cofactors``: (name, pos, member)."""
    data = own.values if own.config["raw_use"] else own.smooth
    data = data / data.max()
    i, j = np.nonzero(data)
    expr = spark.createDataFrame([(int(c), own.genes[g], float(data[g, c])) for g, c in zip(i, j)], "cell long, gene string, value double")
    every = spark.createDataFrame([(0, g, 0.0) for g in own.genes], "cell long, gene string, value double")  # measured, if only as zero
    cells = spark.createDataFrame([(c, g, 0) for c, g in enumerate(own.cell_group)], "cell long, grp int, sample int")
    rows = [(k + 1, p[0], p[0], p[1], p[2], p[3], p[4], p[5], p[6], ANNOTATIONS[0]) for k, p in enumerate(own.pairs)]
    lr = spark.createDataFrame(rows, "lr_ix int, " + ", ".join(f"{c} string" for c in LR_COLUMNS[1:]))
    part = "name string, pos int, member string"
    return Study(expr.unionByName(every), cells, lr, spark.createDataFrame(list(complexes), part), spark.createDataFrame(list(cofactors), part), dict(own.config))


def result_text(own: TextInput, kind: str, net: list, averages: np.ndarray, kernel_means: np.ndarray, thresh: float = 0.05, lossless: bool = False) -> str:
    """Tensor, means and counts of a run as text; ``net`` has (lr_ix, src, tgt, prob, pval)
    with groups as numbers, means are genes by groups."""
    show = hex_float if lossless else plain_float
    k, m = len(own.groups), len(own.pairs)
    prob, pval = np.zeros((m, k, k)), np.ones((m, k, k))
    for r in net:
        prob[r["lr_ix"] - 1, r["src"], r["tgt"]], pval[r["lr_ix"] - 1, r["src"], r["tgt"]] = r["prob"], r["pval"]
    kept = np.where(pval < thresh, prob, 0)
    lines = ["version\t1", f"groups\t{k}", f"lr\t{m}", f"genes\t{len(own.genes)}", f"cells\t{len(own.cells)}", f"type_mean\t{kind}", f"dim\t{k},{k},{m}"]
    for tag, x in (("prob", prob), ("pval", pval)):
        lines += [tag, *(show(v) for v in x.transpose(0, 2, 1).ravel())]  # the source runs fastest
    for tag, x in (("ave_expr", averages), ("kernel_ave", kernel_means)):
        lines += [tag, *(show(v) for v in x.T.ravel())]
    for tag, x in (("aggregate_count", (kept > 0).sum(axis=0)), ("aggregate_weight", kept.sum(axis=0))):
        lines += [tag, *("\t".join(show(v) for v in row) for row in x)]
    for tag, names in (("dimnames_source", own.groups), ("dimnames_target", own.groups), ("dimnames_interaction", [p[0] for p in own.pairs])):
        lines += [tag, "\t".join(names)]
    return "\n".join(lines) + "\n"
