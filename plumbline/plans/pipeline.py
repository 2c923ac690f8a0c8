"""The stages from raw files to the warehouse, each handing its tables on as files."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..operators import abtest, cleaning, features, learners, targeting, validation, warehouse
from ..operators.roles import MartConfig, load_config
from ..sources import loader
from ..sources.settings import Settings, session

# The scenario that the whole run is evaluated with.
COST, PROFIT, THRESHOLD = 2.0, 100.0, 0.02


def run_cleaning(spark: SparkSession, raw: str, clean: str, reports: str, keep_duplicates: bool = False, exact: bool = False) -> list[dict]:
    config = cleaning.CleaningConfig(drop_full_duplicates=not keep_duplicates)
    return cleaning.clean_and_profile(loader.scan_all(spark, raw), clean, reports, config, exact)


def run_mart(spark: SparkSession, clean: str, config: MartConfig, processed: str) -> dict:
    return features.materialize_mart(loader.scan_clean(spark, clean, config), config, f"{processed}/customer_feature_mart.parquet")


def _mart(spark: SparkSession, processed: str):
    return spark.read.parquet(f"{processed}/customer_feature_mart.parquet")


def run_experiment(spark: SparkSession, processed: str, **how) -> abtest.ABResult:
    result = abtest.analyse_experiment(_mart(spark, processed), **how)
    abtest.materialize_result(spark, result, f"{processed}/experiment_results.parquet")
    return result


def run_validation(spark: SparkSession, processed: str, **how) -> dict[str, str]:
    return validation.validate_experiment(_mart(spark, processed), processed, **how)


def run_modeling(spark: SparkSession, processed: str, features_used: Sequence[str] | None = None, **how) -> dict[str, str]:
    return learners.materialize(learners.train_and_evaluate(_mart(spark, processed), features_used, **how), f"{processed}/uplift_modeling")


def run_targeting(spark: SparkSession, processed: str, config: targeting.EconomicsConfig, threshold: float, model: str | None = None) -> dict[str, str]:
    folder = f"{processed}/uplift_modeling"
    model = model or targeting.select_model(spark.read.parquet(f"{folder}/uplift_model_comparison.parquet"))
    return targeting.optimize_business(spark.read.parquet(f"{folder}/uplift_customer_scores.parquet"), config, model, threshold, f"{processed}/business_optimization")


def run_warehouse(spark: SparkSession, processed: str, folder: str, name: str, config: MartConfig | None = None, clean: str | None = None) -> warehouse.Loaded:
    tables = loader.scan_clean(spark, clean, config) if config and clean else None
    return warehouse.load_warehouse(spark, folder, _mart(spark, processed), processed, name, config=config, clean=tables)


def run_all(spark: SparkSession, raw: str, clean: str, processed: str, folder: str, config: MartConfig, name: str = "experiment") -> warehouse.Loaded:
    run_cleaning(spark, raw, clean, f"{processed}/reports")
    run_mart(spark, clean, config, processed)
    run_experiment(spark, processed)
    run_validation(spark, processed)
    run_modeling(spark, processed)
    run_targeting(spark, processed, targeting.EconomicsConfig(COST, PROFIT), THRESHOLD)
    return run_warehouse(spark, processed, folder, name, config, clean)


def main(argv: Sequence[str] | None = None) -> None:
    settings = Settings.from_env()
    parser = argparse.ArgumentParser(description="From raw files to the warehouse.")
    parser.add_argument("mapping", help="JSON role mapping")
    parser.add_argument("--raw", default=str(settings.raw_dir))
    parser.add_argument("--clean", default=str(settings.clean_dir))
    parser.add_argument("--processed", default=str(settings.processed_dir))
    parser.add_argument("--warehouse", default=str(settings.data_dir / "warehouse"))
    parser.add_argument("--name", default="experiment")
    a = parser.parse_args(argv)
    done = run_all(session(), a.raw, a.clean, a.processed, a.warehouse, load_config(a.mapping), a.name)
    print(done.row_counts)


if __name__ == "__main__":
    main()
