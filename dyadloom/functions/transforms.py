"""Transformations of long expression tables (cell, gene, value) with implicit zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(expr: DataFrame, scale: float = 1e4, log: bool = True) -> DataFrame:
    """value / total of its cell * scale, then log1p."""
    share = F.col("value") / F.sum("value").over(Window.partitionBy("cell")) * F.lit(float(scale))
    return expr.withColumn("value", F.ln(1 + share) if log else share)


def scale_by_max(expr: DataFrame) -> DataFrame:
    """Divide by the largest value of the whole table, a one-row aggregate."""
    top = expr.agg(F.max("value").alias("top"))
    return expr.join(F.broadcast(top)).withColumn("value", F.col("value") / F.col("top")).drop("top")


def zscore(expr: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Per gene over all cells; ``n_cells`` is a one-row frame (n). Only stored values
    are returned; an absent one stands for (0 - mean) / sd."""
    one = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).join(F.broadcast(n_cells))
    stats = one.select("gene", (F.col("s") / F.col("n")).alias("mean"), F.sqrt((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("sd"))
    return expr.join(stats, "gene").select("cell", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))


def l1(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.col(value) / F.sum(F.abs(value)).over(Window.partitionBy(by)))


def hill(x: Column, kh: float, n: float) -> Column:
    return F.pow(x, F.lit(float(n))) / (F.lit(float(kh) ** n) + F.pow(x, F.lit(float(n))))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(x * 100, digits))


def entropy(x: Column) -> Column:
    return F.sum(F.when(x > 0, -x * F.ln(x)))


def scale_matrix(df: DataFrame, how: str, row: str = "row", column: str = "column", value: str = "value") -> DataFrame:
    """A whole matrix of (row, column, value): ``none``, z-scores by ``row`` or ``column``,
    or shares of a row's (``r1``) or column's (``c1``) sum."""
    if how == "none":
        return df
    by = Window.partitionBy({"row": row, "column": column, "r1": row, "c1": column}[how])
    v = F.col(value)
    if how in ("r1", "c1"):
        return df.withColumn(value, v / F.sum(v).over(by))
    return df.withColumn(value, (v - F.avg(v).over(by)) / F.stddev_samp(v).over(by))
