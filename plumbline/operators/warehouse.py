"""The star schema: dimensions, facts, constraints, views and the load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WarehouseError
from ..sources.loader import read_if_exists
from ..sources.sinks import Tables, loadable
from .features import moment
from .guards import any_null, require_binary, require_columns, require_numeric, require_unique
from .roles import MartConfig
from .targeting import MODELS, PARTS

# The columns of the tables, in their order.
COLUMNS = {
    "dim_customer": (
        "customer_id", "age", "gender", "total_spend", "avg_check", "median_check", "max_check", "transactions_count", "purchase_frequency",
        "days_since_last_purchase", "unique_products", "unique_categories", "favorite_category", "avg_discount", "discounted_purchase_share",
        "recency_score", "frequency_score", "monetary_score", "rfm_segment", "spending_quantile", "purchase_frequency_quantile",
    ),
    "dim_product": ("product_id", "category"),
    "dim_date": (
        "date_key", "full_date", "calendar_year", "calendar_quarter", "calendar_month", "month_name", "day_of_month", "iso_week", "day_of_week",
        "day_name", "is_weekend",
    ),
    "fact_purchases": ("transaction_id", "customer_id", "product_id", "date_key", "purchase_datetime", "amount", "regular_amount"),
    "fact_experiment": ("experiment_key", "customer_id", "treatment", "target"),
    "experiment_results": (
        "experiment_key", "control_size", "treatment_size", "control_conversions", "treatment_conversions", "control_cr", "treatment_cr",
        "absolute_uplift", "relative_uplift", "standard_error", "z_statistic", "p_value", "ci_lower", "ci_upper", "effect_size", "achieved_power",
        "required_total_size", "mde_absolute", "alpha", "statistically_significant",
    ),
    "segment_experiment_results": (
        "experiment_key", "dimension", "segment", "control_size", "treatment_size", "control_cr", "treatment_cr", "absolute_uplift",
        "relative_uplift", "ci_lower", "ci_upper", "p_value", "adjusted_p_value", "significant_adjusted",
    ),
    "uplift_model_results": (
        "experiment_key", "model_name", "train_customers", "holdout_customers", "auuc", "qini_coefficient", "overall_observed_uplift",
        "final_incremental_purchases", "random_state",
    ),
    "uplift_deciles": (
        "experiment_key", "model_name", "decile", "customers", "control_size", "treatment_size", "avg_predicted_uplift", "treatment_cr",
        "control_cr", "observed_uplift", "incremental_purchases", "cumulative_incremental_purchases",
    ),
    "business_scenarios": (
        "experiment_key", "model_name", "scenario_name", "strategy", "customers_total", "customers_targeted", "target_share",
        "targeting_threshold", "communication_cost", "profit_per_conversion", "marketing_cost", "incremental_conversions", "incremental_value",
        "incremental_profit", "roi", "scenario_analysis",
    ),
}


@dataclass(frozen=True)
class Constraints:
    key: Sequence[str]
    required: Sequence[str] = ()
    checks: Sequence[str] = ()
    references: Sequence[tuple[str, str]] = ()  # (column, table); the column has the same name there


EXPERIMENT = (("experiment_key", "dim_experiment"),)
CONSTRAINTS = {
    "dim_customer": Constraints(("customer_id",), checks=("age >= 0", "recency_score BETWEEN 1 AND 5", "frequency_score BETWEEN 1 AND 5", "monetary_score BETWEEN 1 AND 5")),
    "dim_product": Constraints(("product_id",)),
    "dim_date": Constraints(("date_key",), COLUMNS["dim_date"][1:], ("calendar_quarter BETWEEN 1 AND 4", "calendar_month BETWEEN 1 AND 12", "day_of_month BETWEEN 1 AND 31", "iso_week BETWEEN 1 AND 53", "day_of_week BETWEEN 1 AND 7")),
    "dim_experiment": Constraints(("experiment_key",), ("experiment_name",), ("expected_treatment_share > 0 AND expected_treatment_share < 1",)),
    "fact_purchases": Constraints((), ("transaction_id", "customer_id", "date_key", "purchase_datetime", "amount"), references=(("customer_id", "dim_customer"), ("product_id", "dim_product"), ("date_key", "dim_date"))),
    "fact_experiment": Constraints(("experiment_key", "customer_id"), ("treatment", "target"), ("treatment IN (0, 1)", "target IN (0, 1)"), (*EXPERIMENT, ("customer_id", "dim_customer"))),
    "experiment_results": Constraints(("experiment_key",), (), ("control_size > 0", "treatment_size > 0", "control_conversions BETWEEN 0 AND control_size", "treatment_conversions BETWEEN 0 AND treatment_size", "control_cr BETWEEN 0 AND 1", "treatment_cr BETWEEN 0 AND 1", "p_value BETWEEN 0 AND 1", "achieved_power BETWEEN 0 AND 1", "alpha > 0 AND alpha < 1"), EXPERIMENT),
    "experiment_validation_summary": Constraints(("experiment_key",), (), ("srm_p_value BETWEEN 0 AND 1",), EXPERIMENT),
    "segment_experiment_results": Constraints(("experiment_key", "dimension", "segment"), references=EXPERIMENT),
    "uplift_model_results": Constraints(("experiment_key", "model_name"), ("auuc", "qini_coefficient"), references=EXPERIMENT),
    "uplift_predictions": Constraints(("experiment_key", "customer_id", "model_name"), PARTS, ("probability_control BETWEEN 0 AND 1", "probability_treatment BETWEEN 0 AND 1"), (*EXPERIMENT, ("customer_id", "dim_customer"))),
    "uplift_deciles": Constraints(("experiment_key", "model_name", "decile"), ("customers",), ("decile > 0",), EXPERIMENT),
    "business_scenarios": Constraints(("experiment_key", "model_name", "scenario_name"), ("strategy",), references=EXPERIMENT),
}


def customer_dimension(mart: DataFrame) -> DataFrame:
    require_unique(mart, "client_id", "mart", WarehouseError)
    return loadable(mart.withColumn("customer_id", F.col("client_id").cast("string")), COLUMNS["dim_customer"])


def experiment_fact(mart: DataFrame, key: int) -> DataFrame:
    require_columns(mart, ["client_id", "treatment", "target"], "mart", WarehouseError)
    require_binary(mart, ["treatment", "target"], WarehouseError)
    return mart.select(F.lit(key).cast("long").alias("experiment_key"), F.col("client_id").cast("string").alias("customer_id"), F.col("treatment").cast("smallint").alias("treatment"), F.col("target").cast("smallint").alias("target"))


def product_dimension(products: DataFrame, config: MartConfig) -> DataFrame:
    if config.products is None:
        raise WarehouseError("the mapping has no products")
    r = config.products
    require_columns(products, [r.product_id, r.category], "products", WarehouseError)
    out = products.select(F.col(r.product_id).cast("string").alias("product_id"), F.col(r.category).cast("string").alias("category"))
    require_unique(out, "product_id", "products", WarehouseError)
    return out


def derived_products(purchases: DataFrame) -> DataFrame:
    """For mappings without a product table: the ids that were bought."""
    return purchases.filter(F.col("product_id").isNotNull()).select("product_id").distinct().withColumn("category", F.lit(None).cast("string"))


def date_key(c) -> F.Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def purchase_fact(purchases: DataFrame, config: MartConfig) -> DataFrame:
    r = config.purchases
    require_columns(purchases, [c for c in (r.client_id, r.transaction_id, r.transaction_datetime, r.amount, r.product_id, r.regular_amount) if c], "purchases", WarehouseError)
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    amount = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    at = moment(purchases, config)
    fact = purchases.select(
        text(r.transaction_id).alias("transaction_id"), text(r.client_id).alias("customer_id"), text(r.product_id).alias("product_id"), date_key(at).alias("date_key"),
        at.alias("purchase_datetime"), amount(r.amount).alias("amount"), amount(r.regular_amount).alias("regular_amount"),
    )
    if not fact.filter(any_null(CONSTRAINTS["fact_purchases"].required)).limit(1).isEmpty():
        raise WarehouseError("purchases have nulls in required columns")
    return fact


def date_dimension(days: DataFrame, column: str) -> DataFrame:
    """The distinct days of a date or time column, described."""
    d = F.col("full_date")
    weekday = F.weekday(d) + 1
    return days.select(F.col(column).cast("date").alias("full_date")).distinct().select(
        date_key(d).alias("date_key"), "full_date", F.year(d).cast("smallint").alias("calendar_year"), F.quarter(d).cast("smallint").alias("calendar_quarter"),
        F.month(d).cast("smallint").alias("calendar_month"), F.date_format(d, "MMMM").alias("month_name"), F.day(d).cast("smallint").alias("day_of_month"),
        F.weekofyear(d).cast("smallint").alias("iso_week"), weekday.cast("smallint").alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        (weekday >= 6).alias("is_weekend"),
    )


def prediction_fact(scores: DataFrame, key: int) -> DataFrame:
    """Wide scores as a row per customer and model."""
    require_columns(scores, ["client_id", *[f"{m}_{p}" for m in MODELS for p in PARTS]], "customer scores", WarehouseError)
    each = [F.struct(F.lit(m).alias("model_name"), *[F.col(f"{m}_{p}").alias(p) for p in PARTS]) for m in MODELS]
    long = scores.select(F.col("client_id").cast("string").alias("customer_id"), F.explode(F.array(*each)).alias("x"))
    return long.select(F.lit(key).cast("long").alias("experiment_key"), "customer_id", "x.*")


SUMMARY = {
    "srm": {"observed_control": "observed_control", "observed_treatment": "observed_treatment", "expected_control": "expected_control", "expected_treatment": "expected_treatment", "chi_square_statistic": "srm_chi_square", "p_value": "srm_p_value", "srm_detected": "srm_detected"},
    "aa_summary": {"simulations": "aa_simulations", "false_positive_rate": "aa_false_positive_rate", "mean_p_value": "aa_mean_p_value", "ks_uniform_p_value": "aa_ks_uniform_p_value"},
    "bootstrap_summary": {"iterations": "bootstrap_iterations", "observed_uplift": "observed_uplift", "mean_uplift": "bootstrap_mean_uplift", "median_uplift": "bootstrap_median_uplift", "ci_lower": "bootstrap_ci_lower", "ci_upper": "bootstrap_ci_upper"},
}


def validation_summary(tables: dict[str, DataFrame | None], key: int) -> DataFrame | None:
    """Three one-row tables side by side; nothing if one is missing."""
    if any(tables.get(name) is None for name in SUMMARY):
        return None
    parts = [tables[name].select(*[F.col(a).alias(b) for a, b in columns.items()]).limit(1) for name, columns in SUMMARY.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts).select(F.lit(key).cast("long").alias("experiment_key"), "*")


def scenario_rows(scenarios: DataFrame, key: int, name: str) -> DataFrame:
    named = _keyed(scenarios, key, {"selected_model": "model_name"}).withColumn("scenario_name", F.concat_ws(":", F.lit(name), "strategy"))
    return loadable(named, COLUMNS["business_scenarios"])


def threshold_rows(scenarios: DataFrame, key: int) -> DataFrame:
    named = _keyed(scenarios, key, {"selected_model": "model_name"}).withColumn("scenario_name", F.concat_ws(":", F.lit("optimized"), F.col("customers_targeted").cast("string")))
    return loadable(named, COLUMNS["business_scenarios"])


def _keyed(df: DataFrame, key: int, rename: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(rename).withColumn("experiment_key", F.lit(key).cast("long"))


@dataclass
class Loaded:
    experiment_key: int
    row_counts: dict[str, int] = field(default_factory=dict)


def load_warehouse(spark: SparkSession, folder: str, mart: DataFrame, processed: str, experiment_name: str, scenario_name: str = "base", config: MartConfig | None = None, clean: dict[str, DataFrame] | None = None, expected_treatment_share: float = 0.5, description: str | None = None) -> Loaded:
    """All tables that there is something for, in one transaction: a load that fails changes none."""
    store = Tables(spark, folder)
    with store.transaction():
        return _loaded(store, mart, processed, experiment_name, scenario_name, config, clean, expected_treatment_share, description)


def _loaded(store: Tables, mart: DataFrame, processed: str, experiment_name: str, scenario_name: str, config: MartConfig | None, clean: dict[str, DataFrame] | None, expected_treatment_share: float, description: str | None) -> Loaded:
    spark = store.spark
    start = F.lit(config.experiment_start.isoformat(sep=" ") if config else None).cast("timestamp")
    key = store.key_of("dim_experiment", "experiment_key", "experiment_name", experiment_name, experiment_start=start, expected_treatment_share=F.lit(expected_treatment_share), description=F.lit(description).cast("string"))
    out = Loaded(key)
    n = out.row_counts
    n["dim_customer"] = store.upsert("dim_customer", customer_dimension(mart), ["customer_id"])
    n["fact_experiment"] = store.replace("fact_experiment", experiment_fact(mart, key), "experiment_key", key)
    if config is not None:
        if not clean or "purchases" not in clean or (config.products and "products" not in clean):
            raise WarehouseError("a mapping needs the cleaned purchases, and products if it has them")
        fact = purchase_fact(clean["purchases"], config)
        if config.products:
            n["dim_product"] = store.upsert("dim_product", product_dimension(clean["products"], config), ["product_id"])
        elif config.purchases.product_id:
            n["dim_product"] = store.upsert("dim_product", derived_products(fact), ["product_id"])
        n["dim_date"] = store.upsert("dim_date", date_dimension(fact, "purchase_datetime"), ["date_key"])
        n["fact_purchases"] = store.replace("fact_purchases", fact)
    read = lambda path: read_if_exists(spark, f"{processed}/{path}.parquet")
    summary = validation_summary({name: read(f"experiment_validation/{name}") for name in SUMMARY}, key)
    if summary is not None:
        n["experiment_validation_summary"] = store.upsert("experiment_validation_summary", summary, ["experiment_key"])
    for table, path, rename in (
        ("experiment_results", "experiment_results", {}),
        ("segment_experiment_results", "experiment_validation/segment_analysis", {}),
        ("uplift_model_results", "uplift_modeling/uplift_model_comparison", {"model": "model_name"}),
        ("uplift_deciles", "uplift_modeling/uplift_deciles", {"model": "model_name"}),
    ):
        source = read(path)
        if source is not None:
            n[table] = store.upsert(table, loadable(_keyed(source, key, rename), COLUMNS[table]), list(CONSTRAINTS[table].key))
    scores = read("uplift_modeling/uplift_customer_scores")
    if scores is not None:
        n["uplift_predictions"] = store.replace("uplift_predictions", prediction_fact(scores, key), "experiment_key", key)
    for path, made in (("business_scenarios", lambda t: scenario_rows(t, key, scenario_name)), ("threshold_optimization", lambda t: threshold_rows(t, key))):
        source = read(f"business_optimization/{path}")
        if source is not None:
            n["business_scenarios"] = n.get("business_scenarios", 0) + store.upsert("business_scenarios", made(source), list(CONSTRAINTS["business_scenarios"].key))
    return out


def experiment_overview(dim: DataFrame, results: DataFrame, validation: DataFrame) -> DataFrame:
    own = ("control_size", "treatment_size", "control_cr", "treatment_cr", "absolute_uplift", "relative_uplift", "p_value", "ci_lower", "ci_upper", "achieved_power", "mde_absolute", "statistically_significant")
    checks = ("srm_detected", "srm_p_value", "aa_false_positive_rate", "bootstrap_ci_lower", "bootstrap_ci_upper")
    joined = dim.select("experiment_key", "experiment_name", "experiment_start").join(results.select("experiment_key", *own), "experiment_key", "left")
    return joined.join(validation.select("experiment_key", *checks), "experiment_key", "left")


def named_performance(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Rows of a result table with their experiment's name: the segment, model and strategy views."""
    return rows.join(dim.select("experiment_key", "experiment_name"), "experiment_key").select("experiment_name", *rows.columns)


def create_views(store: Tables) -> list[str]:
    """Temporary views for reports; those whose tables are there."""
    t = {name: store.read(name) for name in CONSTRAINTS}
    made = {}
    if t["dim_experiment"] is not None:
        if t["experiment_results"] is not None and t["experiment_validation_summary"] is not None:
            made["vw_experiment_overview"] = experiment_overview(t["dim_experiment"], t["experiment_results"], t["experiment_validation_summary"])
        for view, table in (("vw_segment_performance", "segment_experiment_results"), ("vw_uplift_model_performance", "uplift_model_results"), ("vw_business_strategy_comparison", "business_scenarios")):
            if t[table] is not None:
                made[view] = named_performance(t[table], t["dim_experiment"])
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)


def quality_checks(t: dict[str, DataFrame]) -> DataFrame:
    """Six counts that should be zero; the purchases are read once."""
    found = t["fact_purchases"].select("customer_id", "product_id", "date_key")
    for dimension, key in (("dim_customer", "customer_id"), ("dim_product", "product_id"), ("dim_date", "date_key")):
        found = found.join(t[dimension].select(key, F.lit(True).alias(f"known_{key}")).distinct(), key, "left")
    unknown = lambda key: F.count_if(F.col(f"known_{key}").isNull())
    p0, p1, u = (F.col(c) for c in PARTS)
    parts = (
        found.agg(
            unknown("customer_id").alias("orphan_purchase_customer"),
            F.count_if(F.col("known_product_id").isNull() & F.col("product_id").isNotNull()).alias("orphan_purchase_product"),
            unknown("date_key").alias("orphan_purchase_date"),
        ),
        t["fact_experiment"].agg(F.count_if(~F.col("treatment").isin(0, 1) | ~F.col("target").isin(0, 1)).alias("invalid_experiment_binary")),
        t["uplift_predictions"].agg(F.count_if(F.abs(p1 - p0 - u) > 1e-9).alias("uplift_probability_mismatch")),
        t["business_scenarios"].agg(F.count_if(~F.coalesce("scenario_analysis", F.lit(False))).alias("non_scenario_business_row")),
    )
    long = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("violations")) for c in p.columns])).alias("x")).select("x.*") for p in parts]
    return reduce(DataFrame.unionByName, long)


def constraint_violations(t: dict[str, DataFrame]) -> DataFrame:
    """table_name, constraint_name, violations for every declared constraint of the given tables."""
    out = []

    def add(table: str, name: str, df: DataFrame) -> None:
        out.append(df.select(F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"), F.col("violations").cast("long").alias("violations")))

    for table, rule in CONSTRAINTS.items():
        df = t.get(table)
        if df is None:
            continue
        row_rules = [(f"not null {c}", F.col(c).isNull()) for c in dict.fromkeys([*rule.key, *rule.required])]
        row_rules += [(f"check {c}", ~F.coalesce(F.expr(c), F.lit(True))) for c in rule.checks if c.split()[0] in df.columns]
        if row_rules:
            counts = df.agg(*[F.count_if(bad).alias(f"c{k}") for k, (_, bad) in enumerate(row_rules)])
            long = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"c{k}").alias("violations")) for k, (name, _) in enumerate(row_rules)])).alias("x"))
            out.append(long.select(F.lit(table).alias("table_name"), F.col("x.name").alias("constraint_name"), F.col("x.violations").cast("long").alias("violations")))
        if rule.key:
            repeated = df.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            add(table, f"unique {', '.join(rule.key)}", repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")))
        for column, target in rule.references:
            if t.get(target) is not None:
                missing = df.filter(F.col(column).isNotNull()).join(t[target].select(column), column, "left_anti")
                add(table, f"reference {column}", missing.agg(F.count(F.lit(1)).alias("violations")))
    return reduce(DataFrame.unionByName, out)


def verify_deployment(store: Tables, required: Sequence[str] = ("dim_experiment", "fact_experiment", "experiment_results", "experiment_validation_summary", "segment_experiment_results", "uplift_model_results", "uplift_predictions", "uplift_deciles", "business_scenarios")) -> dict[str, int]:
    """Rows of the required tables, none of which may be empty."""
    counts = {name: (0 if (t := store.read(name)) is None else t.count()) for name in required}
    empty = [name for name, n in counts.items() if not n]
    if empty:
        raise WarehouseError(f"empty tables: {', '.join(empty)}")
    return counts
