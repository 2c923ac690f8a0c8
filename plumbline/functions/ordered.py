"""Running sums and ranks over a total order, without one task that sees all rows.

Rows are range-partitioned by the order and numbered inside each partition; the
sums of the partitions before, as many as there are partitions, are added by a
broadcast join. Equal keys are in one partition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column] | None = None, position: str | None = None) -> DataFrame:
    """``df`` with running sums (over the row itself and those before) and a position from 1."""
    sums = dict(sums or {})
    if position:
        sums[position] = F.lit(1).cast("long")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(parts, *order)
    rows = staged(rows.withColumn("__part", F.spark_partition_id()), "ordered")
    totals = rows.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(f"__{k}").over(inside) for k in sums}).join(F.broadcast(offsets), "__part")
    rows = rows.withColumns({k: F.col(k) + F.col(f"__before_{k}") for k in sums})
    return rows.select(*[f"`{c}`" for c in df.columns if c not in sums], *sums)


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, value, rank, values: per column and distinct value (as a double) that isn't null the average rank
    from the least up, and how many values the column has in all.

    Ranks are found on the distinct values of all columns together, in one
    running sum, so rows with the same value meet as a partial aggregate.
    """
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(each).alias("x")).select("x.*").filter(F.col("value").isNotNull())
    counts = long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("__peers"))
    ranked = staged(running(counts, [F.col("metric"), F.col("value")], {"__upto": F.col("__peers")}), "ranked-values")
    ends = ranked.groupBy("metric").agg(F.min(F.col("__upto") - F.col("__peers")).alias("__start"), F.sum("__peers").alias("values"))
    rank = F.col("__upto") - F.col("__start") - (F.col("__peers") - 1) / 2
    return staged(ranked.join(F.broadcast(ends), "metric").select("metric", "value", rank.alias("rank"), "values"), "ranks")


def values_at(values: DataFrame, places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Per ``column`` of (column, value) the values at some places, from 0, of its sorted values that aren't null.

    ``places`` gives each place from the number of values. Equal values are
    counted first, so no column is sorted or gathered in one task.
    """
    counts = values.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("__n"))
    placed = staged(running(counts, [F.col("column"), F.col("value")], {"__upto": F.col("__n")}), "placed-values")
    ends = placed.groupBy("column").agg(F.min(F.col("__upto") - F.col("__n")).alias("__start"), F.sum("__n").alias("__total"))
    placed = placed.join(F.broadcast(ends), "column").withColumn("__upto", F.col("__upto") - F.col("__start"))
    hit = lambda place: (F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place)
    return placed.groupBy("column").agg(*[F.max(F.when(hit(at(F.col("__total"))), F.col("value"))).alias(name) for name, at in places.items()])


MIDDLE = {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.ceil((n - 1) / 2)}


def middle() -> Column:
    """The median from the values at the places of ``MIDDLE``."""
    return (F.col("__low") + F.col("__high")) / 2
