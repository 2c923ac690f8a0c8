"""Cleaning: NaN as null, then whole repeated rows dropped; texts stay as they are."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import nan_to_null, write_atomic, write_json
from .profiling import profile_dataset


@dataclass(frozen=True)
class CleaningConfig:
    nan_to_null: bool = True
    drop_full_duplicates: bool = True


def clean(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    if config.nan_to_null:
        df = nan_to_null(df)
    return df.dropDuplicates() if config.drop_full_duplicates else df


def sizes(df: DataFrame) -> DataFrame:
    """rows, nans (over all float columns), in one pass."""
    floats = [F.count_if(F.isnan(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.agg(F.count(F.lit(1)).alias("rows"), reduce(add, floats, F.lit(0)).cast("long").alias("nans"))


def clean_entity(entity: str, df: DataFrame, path: str, config: CleaningConfig = CleaningConfig()) -> dict:
    """Write the cleaned table; what changed."""
    before = sizes(df).first()
    write_atomic(clean(df, config), path)
    after = sizes(df.sparkSession.read.parquet(path)).first()
    return {"entity": entity, "input_rows": before["rows"], "output_rows": after["rows"], "rows_removed": before["rows"] - after["rows"], "nans_replaced": before["nans"] - after["nans"], "path": path}


def clean_dataset(frames: Mapping[str, DataFrame], folder: str, config: CleaningConfig = CleaningConfig()) -> list[dict]:
    return [clean_entity(e, f, f"{folder}/{e}.parquet", config) for e, f in frames.items()]


def clean_and_profile(frames: Mapping[str, DataFrame], clean_dir: str, report_dir: str, config: CleaningConfig = CleaningConfig(), exact: bool = False) -> list[dict]:
    """Profiles of the raw tables, the cleaned tables, their profiles, and an audit."""
    spark = next(iter(frames.values())).sparkSession
    profile_dataset(frames, f"{report_dir}/raw", exact)
    audit = clean_dataset(frames, clean_dir, config)
    profile_dataset({a["entity"]: spark.read.parquet(a["path"]) for a in audit}, f"{report_dir}/clean", exact)
    write_json(spark, audit, f"{report_dir}/cleaning_audit.json")
    return audit
