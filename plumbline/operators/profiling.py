"""Profiles of tables: sizes, nulls, cardinalities, distributions, frequent values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import MIDDLE, middle, values_at
from ..sources.loader import schemas
from ..sources.sinks import write_csv, write_json

NUMERIC = "entity string, column string, mean double, std double, min double, q25 double, median double, q75 double, max double"
FREQUENT = "entity string, column string, value string, count long"


def _quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def _floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def _long(df: DataFrame, columns: list[str], make) -> DataFrame:
    """(column, value) for each of the columns; ``make`` gives the value."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), make(c).alias("value")) for c in columns])).alias("x")).select("x.*")


def column_profile(entity: str, df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: nulls, NaNs and distinct values, null counting as one.

    Exact counts go through one long (column, value digest) table, whose
    distinct rows are pre-aggregated by task; a plain count of many distinct
    columns at once would multiply every row by the number of columns as well,
    and with the values themselves. Approximate counts are sketches.
    """
    spark, floats = df.sparkSession, _floats(df)
    if not df.columns:
        return spark.createDataFrame([], "entity string, column string, dtype string, row_count long, null_count long, null_rate double, nan_count long, unique_count long, unique_rate double, cardinality_is_exact boolean")
    one = [F.count(F.lit(1)).alias("rows")]
    for k, c in enumerate(df.columns):
        one.append(F.count_if(_quoted(c).isNull()).alias(f"null_{k}"))
        one.append((F.count_if(F.isnan(_quoted(c))) if c in floats else F.lit(0).cast("long")).alias(f"nan_{k}"))
        if not exact:
            one.append((F.approx_count_distinct(F.to_json(F.struct(_quoted(c))) if isinstance(df.schema[c].dataType, (T.MapType,)) else _quoted(c)) + F.max(_quoted(c).isNull().cast("int"))).alias(f"unique_{k}"))
    counts = df.agg(*one)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.lit(k).alias("place"), F.col("rows"), F.col(f"null_{k}").alias("null_count"), F.col(f"nan_{k}").alias("nan_count"), (F.lit(None).cast("long") if exact else F.col(f"unique_{k}").cast("long")).alias("unique_count")) for k, (c, t) in enumerate(df.dtypes)]
    out = counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    if exact:
        digest = lambda c: F.coalesce(F.md5(F.to_json(F.struct(_quoted(c).alias("v")), {"ignoreNullFields": "false"})), F.lit(""))
        distinct = _long(df, df.columns, digest).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("found"))
        out = out.join(F.broadcast(distinct), "column", "left").withColumn("unique_count", F.coalesce("found", F.lit(0))).drop("found")
    out = out.withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("long")))
    rate = lambda c: F.when(F.col("rows") > 0, F.col(c) / F.col("rows")).otherwise(F.lit(0.0))
    return out.orderBy("place").select(F.lit(entity).alias("entity"), "column", "dtype", F.col("rows").alias("row_count"), "null_count", rate("null_count").alias("null_rate"), "nan_count", "unique_count", rate("unique_count").alias("unique_rate"), F.lit(exact).alias("cardinality_is_exact"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, and how many of them repeat another one as a whole."""
    groups = df.groupBy(*[_quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def overview(entity: str, df: DataFrame) -> DataFrame:
    """One row: sizes, repeated rows, nulls and NaNs of all columns."""
    floats = _floats(df)
    nulls = sum((F.count_if(_quoted(c).isNull()) for c in df.columns), F.lit(0))
    nans = sum((F.count_if(F.isnan(_quoted(c))) for c in floats), F.lit(0))
    totals = df.agg(nulls.cast("long").alias("total_nulls"), nans.cast("long").alias("total_nans"))
    both = duplicate_rows(df).crossJoin(totals)  # one row each
    rate = F.when(F.col("rows") > 0, F.col("duplicate_rows") / F.col("rows")).otherwise(F.lit(0.0))
    return both.select(F.lit(entity).alias("entity"), F.col("rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"), "duplicate_rows", rate.alias("duplicate_rate"), "total_nulls", "total_nans")


def numeric_summary(entity: str, df: DataFrame) -> DataFrame:
    """Per numeric column mean, deviation, extremes, median and nearest quartiles; NaN counts as null."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return df.sparkSession.createDataFrame([], NUMERIC)
    floats = _floats(df)
    value = lambda c: F.when(~F.isnan(_quoted(c)), _quoted(c)).cast("double") if c in floats else _quoted(c).cast("double")
    values = _long(df, numeric, value)
    moments = values.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    places = {"q25": lambda n: F.round((n - 1) * 0.25), "q75": lambda n: F.round((n - 1) * 0.75), **MIDDLE}
    return moments.join(values_at(values, places).withColumn("median", middle()), "column", "left").select(F.lit(entity).alias("entity"), "column", "mean", "std", "min", "q25", "median", "q75", "max")


def frequent_values(entity: str, df: DataFrame, profile: DataFrame | None = None, most: int = 50, top: int = 10) -> DataFrame:
    """Per text or boolean column of at most ``most`` values the ``top`` frequent ones (equal ones by value)."""
    candidates = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    if not candidates:
        return df.sparkSession.createDataFrame([], FREQUENT)
    counts = _long(df, candidates, lambda c: _quoted(c).cast("string")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    if profile is not None:
        few = profile.filter(F.col("unique_count") <= most).select("column")
    else:
        few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") <= most).select("column")
    order = W.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    ranked = counts.join(F.broadcast(few), "column").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return ranked.select(F.lit(entity).alias("entity"), "column", "value", "count")


def profile_dataset(frames: Mapping[str, DataFrame], folder: str, exact: bool = False, most: int = 50, top: int = 10) -> dict[str, str]:
    """Four CSV tables over all entities and a JSON inventory of their schemas."""
    spark = next(iter(frames.values())).sparkSession
    columns = {e: column_profile(e, f, exact) for e, f in frames.items()}
    parts = {
        "dataset_overview": [overview(e, f) for e, f in frames.items()],
        "column_profile": list(columns.values()),
        "numeric_summary": [numeric_summary(e, f) for e, f in frames.items()],
        "categorical_top_values": [frequent_values(e, f, columns[e], most, top) for e, f in frames.items()],
    }
    out = {}
    for name, each in parts.items():
        table = each[0]
        for x in each[1:]:
            table = table.unionByName(x)
        out[name] = write_csv(table, f"{folder}/{name}.csv")
    out["schema_inventory"] = write_json(spark, schemas(dict(frames)), f"{folder}/schema_inventory.json")
    return out
