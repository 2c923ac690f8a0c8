"""Report measures over the star schema.

A measure is an aggregate in a filter context: filter the tables, group by what
the report is split by, and evaluate. Every function here takes ``by``, the
columns of that split. A ratio with nothing below is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The parameters of the report and their defaults.
COST, PROFIT, THRESHOLD = 2.0, 100.0, 0.02
#: (first, last, steps in one unit): the grids of the what-if parameters.
GRIDS = {"communication_cost": (0, 20, 2), "profit_per_conversion": (0, 1000, 0.1), "targeting_threshold": (-0.20, 0.50, 100)}


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def selected(c: str) -> Column:
    """The only value there is; several give nothing, never an average."""
    return F.when(F.count_distinct(c) == 1, F.max(c))


def experiment_measures(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Users, conversions, rates and uplift of fact_experiment."""
    arm = lambda t, c: F.when(F.col("treatment") == t, F.col(c))
    base = fact.groupBy(*by).agg(
        F.count_distinct("customer_id").alias("users"),
        F.count_distinct(arm(0, "customer_id")).alias("control_users"),
        F.count_distinct(arm(1, "customer_id")).alias("treatment_users"),
        F.sum("target").cast("long").alias("conversions"),
        F.coalesce(F.sum(arm(0, "target")), F.lit(0)).cast("long").alias("control_conversions"),
        F.coalesce(F.sum(arm(1, "target")), F.lit(0)).cast("long").alias("treatment_conversions"),
    )
    c = F.col
    base = base.withColumns({"control_cr": divide(c("control_conversions"), c("control_users")), "treatment_cr": divide(c("treatment_conversions"), c("treatment_users")), "conversion_rate": divide(c("conversions"), c("users"))})
    base = base.withColumn("absolute_uplift", c("treatment_cr") - c("control_cr"))
    return base.withColumns({"relative_uplift": divide(c("absolute_uplift"), c("control_cr")), "incremental_conversions": c("absolute_uplift") * c("treatment_users")})


RESULTS = {"p_value": "p_value", "ci_lower": "ci_lower", "ci_upper": "ci_upper", "achieved_power": "achieved_power", "mde_absolute": "mde"}
CHECKS = {"srm_p_value": "srm_p_value", "aa_false_positive_rate": "aa_fpr", "bootstrap_mean_uplift": "bootstrap_mean", "bootstrap_ci_lower": "bootstrap_ci_lower", "bootstrap_ci_upper": "bootstrap_ci_upper"}


def result_measures(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """p-value, interval, power and detectable effect of the selected experiment."""
    return results.groupBy(*by).agg(*[selected(c).alias(name) for c, name in RESULTS.items()])


def check_measures(validation: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return validation.groupBy(*by).agg(*[selected(c).alias(name) for c, name in CHECKS.items()])


def significance(p: Column, significant: Column) -> Column:
    return F.when(p.isNotNull(), F.when(significant, "yes").otherwise("no"))


def status(p: Column, srm_detected: Column, significant: Column, uplift: Column) -> Column:
    """A broken randomisation outweighs what the test says."""
    return (
        F.when(p.isNull(), "not calculated")
        .when(srm_detected, "randomization error")
        .when(significant & (uplift > 0), "significant positive effect")
        .when(significant & (uplift < 0), "significant negative effect")
        .otherwise("no significant effect")
    )


def segment_measures(segments: DataFrame, by: Sequence[str] = ("dimension", "segment")) -> DataFrame:
    return segments.groupBy(*by).agg(F.max("absolute_uplift").alias("segment_uplift"), F.sum(F.col("control_size") + F.col("treatment_size")).alias("segment_users"))


def model_measures(results: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    return results.groupBy(*by).agg(F.max("auuc").alias("model_auuc"), F.max("qini_coefficient").alias("qini_coefficient"), F.max("holdout_customers").alias("holdout_customers"))


def score_measures(predictions: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    return predictions.groupBy(*by).agg(F.count_distinct("customer_id").alias("scored_customers"), F.avg("predicted_uplift").alias("average_predicted_uplift"))


def decile_measures(deciles: DataFrame, by: Sequence[str] = ("model_name", "decile")) -> DataFrame:
    return deciles.groupBy(*by).agg(F.max("observed_uplift").alias("observed_decile_uplift"), F.max("avg_predicted_uplift").alias("predicted_decile_uplift"), F.max("cumulative_incremental_purchases").alias("cumulative_incremental"))


def qini_baseline(deciles: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """The straight line from nothing to the last decile's gain."""
    every = W.partitionBy(*by)
    final = F.max_by("cumulative_incremental_purchases", "decile").over(every)
    return deciles.select(*by, "decile", "cumulative_incremental_purchases", (final * F.col("decile") / F.max("decile").over(every)).alias("qini_random_baseline"))


def target_measures(predictions: DataFrame, cost: float = COST, profit: float = PROFIT, threshold: float = THRESHOLD, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """The chosen audience, everyone, and what the choice gains and saves."""
    u = F.col("predicted_uplift")
    hit = u > threshold
    base = predictions.groupBy(*by).agg(
        F.count_distinct(F.when(hit, F.col("customer_id"))).alias("customers_targeted"),
        F.count_distinct("customer_id").alias("all_customers"),
        F.coalesce(F.sum(F.when(hit, u)), F.lit(0.0)).alias("expected_incremental_conversions"),
        F.sum(u).alias("all_conversions"),
    )
    c = F.col
    base = base.withColumns({
        "target_share": divide(c("customers_targeted"), c("all_customers")), "campaign_cost": c("customers_targeted") * F.lit(float(cost)), "incremental_value": c("expected_incremental_conversions") * F.lit(float(profit)),
        "all_cost": c("all_customers") * F.lit(float(cost)), "all_profit": c("all_conversions") * F.lit(float(profit)) - c("all_customers") * F.lit(float(cost)),
    })
    base = base.withColumn("incremental_profit", c("incremental_value") - c("campaign_cost"))
    return base.withColumns({"roi": divide(c("incremental_profit"), c("campaign_cost")), "all_roi": divide(c("all_profit"), c("all_cost")), "profit_delta": c("incremental_profit") - c("all_profit"), "cost_saving": c("all_cost") - c("campaign_cost")})


def scenario_measures(scenarios: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    return scenarios.groupBy(*by).agg(F.max("incremental_profit").alias("scenario_profit"), F.max("marketing_cost").alias("scenario_cost"))


def model_dimension(tables: Sequence[DataFrame]) -> DataFrame:
    """The distinct model names of several tables."""
    out = tables[0].select("model_name")
    for t in tables[1:]:
        out = out.union(t.select("model_name"))
    return out.distinct()


def grid(spark: SparkSession, name: str) -> DataFrame:
    """A what-if parameter: whole steps, then scaled, so that values don't drift."""
    first, last, per_unit = GRIDS[name]
    if per_unit >= 1:
        return spark.range(round(first * per_unit), round(last * per_unit) + 1).select((F.col("id") / F.lit(float(per_unit))).alias(name))
    step = round(1 / per_unit)
    return spark.range(round(first / step), round(last / step) + 1).select((F.col("id") * step).cast("double").alias(name))


def what_if(predictions: DataFrame, thresholds: DataFrame, cost: float = COST, profit: float = PROFIT) -> DataFrame:
    """Per threshold of a disconnected grid the audience and its profit.

    Each score is placed between two thresholds first; thresholds then sum the
    places above them, so scores are read once and not multiplied by the grid.
    """
    marks = [r[0] for r in thresholds.orderBy("targeting_threshold").collect()]  # a report's grid
    u = F.col("predicted_uplift")
    passed = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: u > m))
    places = predictions.groupBy(passed.alias("passed")).agg(F.count(F.lit(1)).alias("n"), F.sum(u).alias("s"))
    grid_rows = predictions.sparkSession.createDataFrame(list(enumerate(marks)), "place int, targeting_threshold double")
    joined = grid_rows.join(F.broadcast(places), F.col("passed") > F.col("place"), "left")
    summed = joined.groupBy("targeting_threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("customers_targeted"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("expected_incremental_conversions"))
    return summed.withColumn("incremental_profit", F.col("expected_incremental_conversions") * F.lit(float(profit)) - F.col("customers_targeted") * F.lit(float(cost)))


def calendar(dates: DataFrame, column: str) -> DataFrame:
    """Every day of the years that a date column touches."""
    years = dates.agg(F.min(F.year(column)).alias("first"), F.max(F.year(column)).alias("last")).filter(F.col("first").isNotNull())
    days = years.select(F.explode(F.sequence(F.make_date("first", F.lit(1), F.lit(1)), F.make_date("last", F.lit(12), F.lit(31)))).alias("date"))
    d = F.col("date")
    return days.select("date", F.year(d).alias("year"), F.month(d).alias("month_no"), F.date_format(d, "MMMM").alias("month"), F.quarter(d).alias("quarter_no"), F.concat(F.lit("Qtr "), F.quarter(d).cast("string")).alias("quarter"), F.day(d).alias("day"))
