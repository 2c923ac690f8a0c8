"""Checks that raise before a wrong input becomes a wrong number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, ExperimentError


def require_columns(df: DataFrame, columns: Sequence[str], what: str, error: type[DataError] = DataError) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise error(f"{what} has no column {', '.join(missing)}")


def require_unique(df: DataFrame, key: str, what: str, error: type[DataError] = DataError) -> None:
    """No null and no repeated key, by aggregates over the key column alone."""
    rows, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    if nulls or df.select(key).distinct().count() != rows:
        raise error(f"{what}.{key} must be filled and unique")


def require_filled(df: DataFrame, columns: Sequence[str], what: str, error: type[DataError] = DataError) -> None:
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    bad = {c: n for c, n in nulls.items() if n}
    if bad:
        raise error(f"{what} has nulls: {bad}")


def require_numeric(df: DataFrame, columns: Sequence[str], what: str, error: type[DataError] = DataError) -> None:
    bad = [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]
    if bad:
        raise error(f"{what} must be numeric: {', '.join(bad)}")


def any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def invalid_binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which a label is null or neither 0 nor 1."""
    return df.filter(reduce(or_, [F.col(c).isNull() | ~F.col(c).isin(0, 1) for c in columns]))


def require_binary(df: DataFrame, columns: Sequence[str], error: type[DataError] = ExperimentError, shown: int = 5) -> None:
    bad = invalid_binary(df, columns).select(*columns).limit(shown).collect()
    if bad:
        raise error(f"{' and '.join(columns)} must be 0 or 1, not {[tuple(r) for r in bad]}")


def is_finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def require_finite(df: DataFrame, columns: Sequence[str], error: type[DataError] = DataError) -> None:
    bad = df.filter(reduce(or_, [~is_finite(F.col(c)) for c in columns])).limit(1).count()
    if bad:
        raise error(f"{', '.join(columns)} must be finite numbers")


def offences(df: DataFrame, unique: Sequence[str] = (), filled: Sequence[str] = (), binary: Sequence[str] = (), finite: Sequence[str] = (), members: dict[str, Sequence] | None = None) -> DataFrame:
    """guard, column, violations: what the checks would find, counted instead of raised.

    Rows are read once, and once more for each unique column. A repeated key counts
    as often as it is there beyond the first time; a null key too, each time.
    """
    rules = {("filled", c): F.col(c).isNull() for c in filled}
    rules |= {("binary", c): F.col(c).isNull() | ~F.col(c).isin(0, 1) for c in binary}
    rules |= {("finite", c): ~is_finite(F.col(c)) for c in finite}
    rules |= {("member", c): F.col(c).isNull() | ~F.col(c).isin(*known) for c, known in (members or {}).items()}
    counts = df.agg(*[F.count_if(bad).alias(f"c{k}") for k, bad in enumerate(rules.values())])
    long = F.array(*[F.struct(F.lit(guard).alias("guard"), F.lit(c).alias("column"), F.col(f"c{k}").alias("violations")) for k, (guard, c) in enumerate(rules)])
    parts = [counts.select(F.explode(long).alias("x")).select("x.*")] if rules else []
    for c in unique:
        own = df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("violations"))
        parts.append(own.select(F.lit("unique").alias("guard"), F.lit(c).alias("column"), "violations"))
    return reduce(DataFrame.unionByName, parts)
