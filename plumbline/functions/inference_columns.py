"""The same statistics as columns, for tables with a test per row."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def erfc(c: Column) -> Column:
    return F.reflect(F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), c).cast("double")


def next_down(c: Column) -> Column:
    """The greatest double below."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextDown"), c).cast("double")


def z_statistic(s0: Column, n0: Column, s1: Column, n1: Column) -> Column:
    diff, pooled = s1 / n1 - s0 / n0, (s0 + s1) / (n0 + n1)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    inf = F.lit(float("inf"))
    return F.when(error > 0, diff / error).otherwise(F.when(diff > 0, inf).when(diff < 0, -inf).otherwise(0.0))


def two_sided(z: Column) -> Column:
    return F.when(F.abs(z) == float("inf"), 0.0).otherwise(F.least(F.lit(1.0), erfc(F.abs(z) / F.sqrt(F.lit(2.0)))))


def difference_error(s0: Column, n0: Column, s1: Column, n1: Column) -> Column:
    p0, p1 = s0 / n0, s1 / n1
    return F.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)


def difference_interval(s0: Column, n0: Column, s1: Column, n1: Column, alpha: float) -> tuple[Column, Column]:
    diff, width = s1 / n1 - s0 / n0, difference_error(s0, n0, s1, n1) * NormalDist().inv_cdf(1 - alpha / 2)
    return F.greatest(F.lit(-1.0), diff - width), F.least(F.lit(1.0), diff + width)


def adjusted(df: DataFrame, p: str, name: str, order: list[str]) -> DataFrame:
    """Benjamini-Hochberg over all rows; ``df`` has a row per hypothesis, few enough for one task."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    ranked = df.withColumns({"__place": F.row_number().over(W.orderBy(p, *order)), "__tests": n})
    rest = W.orderBy(F.col("__place").desc()).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__tests") / F.col("__place")).over(rest))).drop("__place", "__tests")
