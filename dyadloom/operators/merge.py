"""Several datasets as one: union with a dataset column, over what all have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import Study


def merge(studies: dict[str, Study], prefix: bool = False) -> Study:
    """Cells of all, genes that every dataset has. Cells that occur twice are an error
    unless their ids get the dataset's name before them."""

    def tagged(name: str, df: DataFrame) -> DataFrame:
        out = df.withColumn("dataset", F.lit(name))
        return out.withColumn("cell", F.concat_ws("_", F.lit(name), F.col("cell").cast("string"))) if prefix else out

    common = [c for c in next(iter(studies.values())).cells.columns if all(c in s.cells.columns for s in studies.values())]
    cells = reduce(DataFrame.unionByName, [tagged(n, s.cells.select(*common)) for n, s in studies.items()])
    if cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect():
        raise ValueError("cells occur in more than one dataset")
    expr = reduce(DataFrame.unionByName, [tagged(n, s.expr) for n, s in studies.items()])
    shared = expr.select("gene", "dataset").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(studies)).select("gene")
    first = next(iter(studies.values()))
    return first.with_(expr=expr.join(shared, "gene", "left_semi"), cells=cells)


def subset(study: Study, groups=None, cells=None, invert: bool = False) -> Study:
    """A study of some groups or cells."""
    keep = F.lit(True)
    if groups is not None:
        keep = keep & F.col("grp").isin(*groups)
    if cells is not None:
        keep = keep & F.col("cell").isin(*cells)
    kept = study.cells.filter(~keep if invert else keep)
    return study.with_(cells=kept, expr=study.expr.join(kept.select("cell"), "cell", "left_semi"))


def relabel(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    if "0" in names.values():
        raise ValueError('a group cannot be named "0"')
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
    return cells if pairs is None else cells.withColumn("grp", F.coalesce(F.element_at(pairs, F.col("grp")), F.col("grp")))


def min_max_threshold(expr: DataFrame, cutoff: float) -> DataFrame:
    """Values scaled to 0..1 by gene over stored values, those below the cutoff dropped."""
    ends = expr.groupBy("gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = expr.join(F.broadcast(ends), "gene").withColumn("value", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    return scaled.filter(F.col("value") >= cutoff).select(*expr.columns)
