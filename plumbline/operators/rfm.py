"""Recency, frequency and monetary scores from 1 to 5 by average rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import average_ranks

#: score: (column, whether small values are good)
SCORES = {"recency_score": ("days_since_last_purchase", True), "frequency_score": ("transactions_count", False), "monetary_score": ("total_spend", False)}


def score(rank: Column, values: Column) -> Column:
    """The rank's place from 1 to 5, ties at one half upwards; a single value is in the middle."""
    return F.when(values <= 1, F.lit(3)).otherwise(F.round((rank - 1) * 4 / (values - 1) + 1)).cast("tinyint")


def add_scores(df: DataFrame, scores: dict[str, tuple[str, bool]] = SCORES) -> DataFrame:
    """``df`` with a score per column (null for null) and ``rfm_segment`` where all three are known.

    The ranks of distinct values are joined back by value.
    """
    ranks = average_ranks(df, [column for column, _ in scores.values()])
    for name, (column, small_is_good) in scores.items():
        rank = F.col("values") + 1 - F.col("rank") if small_is_good else F.col("rank")
        own = ranks.filter(F.col("metric") == column).select(F.col("value").alias("__value"), score(rank, F.col("values")).alias(name))
        df = df.join(own, F.col(column).cast("double") == F.col("__value"), "left").drop("__value")
    r, f, m = (F.col(n) for n in SCORES)
    known = r.isNotNull() & f.isNotNull() & m.isNotNull()
    code = F.concat(F.lit("R"), r.cast("string"), F.lit("F"), f.cast("string"), F.lit("M"), m.cast("string"))
    return df.withColumn("rfm_segment", F.when(known, code))
