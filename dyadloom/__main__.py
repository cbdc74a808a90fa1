"""Command line: ``run`` and ``describe`` a study of a text file, ``mean`` of numbers, ``version``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .functions.means import group_means, match_kind
from .functions.scalar import mean_of
from .operators import kernel
from .sources import adapters, textform


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _matrix(means: DataFrame, own: textform.TextInput) -> np.ndarray:
    out, at = np.zeros((len(own.genes), len(own.groups))), {g: k for k, g in enumerate(own.genes)}
    for r in means.collect():  # genes by groups
        out[at[r["gene"]], r["grp"]] = r["value"]
    return out


def run(spark: SparkSession, own: textform.TextInput, complexes=(), cofactors=(), thresh: float = 0.05, lossless: bool = False) -> str:
    study, c = textform.to_study(spark, own, complexes, cofactors), own.config
    kind = match_kind(c["type"])
    net = kernel.communicate(study, kind, c["trim"], c["population_size"], c["nboot"], c["Kh"], c["n"], seed=c["seed"]).collect()
    used = _matrix(group_means(study.expr, study.cells, kind, c["trim"]), own)
    raw = textform.to_study(spark, textform.TextInput(**{**vars(own), "config": {**c, "raw_use": True}, "smooth": None}))
    averages = _matrix(group_means(raw.expr, raw.cells, kind, c["trim"]), own) * own.values.max()
    return textform.result_text(own, kind, net, averages, used, thresh, lossless)


def describe(own: textform.TextInput) -> str:
    sizes = np.bincount(own.cell_group, minlength=len(own.groups))
    lines = [f"groups\t{len(own.groups)}", f"genes\t{len(own.genes)}", f"cells\t{len(own.cells)}", f"lr\t{len(own.pairs)}"]
    lines += [f"{k}\t{str(v).lower() if isinstance(v, bool) else textform.plain_float(v) if isinstance(v, float) else v}" for k, v in own.config.items()]
    return "\n".join(lines + [f"group[{k}]\t{g}\t{n} cells" for k, (g, n) in enumerate(zip(own.groups, sizes))])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="dyadloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "describe"):
        one = sub.add_parser(name)
        one.add_argument("--input", required=True)
        one.add_argument("--db", help="folder of a verified knowledge base")
        one.add_argument("--output")
        one.add_argument("--hex", action="store_true", help="lossless numbers")
        one.add_argument("--thresh", type=float, default=0.05)
    one = sub.add_parser("mean")
    one.add_argument("--kind", required=True)
    one.add_argument("--trim", type=float, default=0.1)
    one.add_argument("values", nargs="*", type=float)
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        text = f"dyadloom {__version__}"
    elif a.command == "mean":
        values = a.values or [float(v) for v in sys.stdin.read().split()]
        if not values:
            p.error("mean needs a value at least")
        text = textform.plain_float(mean_of(values, match_kind(a.kind), a.trim))
    else:
        own = textform.parse(Path(a.input).read_text())
        if a.command == "describe":
            text = describe(own)
            if a.db:
                kb = adapters.load_knowledge_base(_session(), a.db)
                text += "".join(f"\ndb_{k}\t{kb[k].select(c).distinct().count()}" for k, c in (("lr", "lr_ix"), ("complexes", "name"), ("cofactors", "name")))
        else:
            spark = _session()
            parts = {k: [tuple(r) for r in adapters.load_knowledge_base(spark, a.db)[k].collect()] for k in ("complexes", "cofactors")} if a.db else {}
            text = run(spark, own, **parts, thresh=a.thresh, lossless=a.hex).rstrip("\n")
    if getattr(a, "output", None):
        Path(a.output).write_text(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
