"""From predicted effects to who is addressed, and what that is worth."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EconomicsError, UpliftError
from ..functions.inference_columns import next_down
from ..functions.ordered import running
from ..sources.sinks import write_atomic
from .guards import is_finite, require_columns, require_finite

MODELS = ("s_learner", "t_learner")
PARTS = ("probability_control", "probability_treatment", "predicted_uplift")
TOLERANCE = 1e-9


@dataclass(frozen=True)
class EconomicsConfig:
    communication_cost: float
    profit_per_conversion: float

    def __post_init__(self):
        for v in (self.communication_cost, self.profit_per_conversion):
            if not math.isfinite(v) or v < 0:
                raise EconomicsError("cost and profit must be finite and not negative")


def contradictions(scores: DataFrame) -> DataFrame:
    """Rows whose probabilities aren't, or whose uplift isn't their difference."""
    p0, p1, u = (F.col(c) for c in PARTS)
    good = is_finite(p0) & is_finite(p1) & is_finite(u) & p0.between(0, 1) & p1.between(0, 1) & (F.abs(p1 - p0 - u) <= TOLERANCE)
    return scores.filter(~good)


def require_probabilities(scores: DataFrame) -> None:
    require_columns(scores, PARTS, "scores", UpliftError)
    if not contradictions(scores).limit(1).isEmpty():
        raise UpliftError("probabilities must be in [0, 1] and uplift their difference")


def customer_type(effect: float = 0.05, outcome: float = 0.5) -> Column:
    u, likely = F.col("predicted_uplift"), (F.col("probability_control") + F.col("probability_treatment")) / 2
    return F.when(u > effect, "Persuadables").when(u < -effect, "Sleeping Dogs").when(likely >= outcome, "Sure Things").otherwise("Lost Causes")


def assign_types(scores: DataFrame, effect: float = 0.05, outcome: float = 0.5) -> DataFrame:
    if not math.isfinite(effect) or effect < 0 or not 0 <= outcome <= 1:
        raise UpliftError("the effect must not be negative and the outcome be a probability")
    require_probabilities(scores)
    return scores.withColumns({"modeled_customer_type": customer_type(effect, outcome), "customer_type_is_model_interpretation": F.lit(True)})


def apply_rule(scores: DataFrame, threshold: float, column: str = "predicted_uplift", output: str = "is_targeted") -> DataFrame:
    """Strictly more uplift than the threshold."""
    require_columns(scores, [column], "scores", UpliftError)
    if not math.isfinite(threshold):
        raise UpliftError("the threshold must be finite")
    require_finite(scores, [column], UpliftError)
    return scores.withColumns({output: F.col(column) > threshold, "targeting_threshold": F.lit(float(threshold))})


ECONOMICS = ("strategy", "customers_total", "customers_targeted", "target_share", "targeting_threshold", "communication_cost", "profit_per_conversion", "marketing_cost", "incremental_conversions", "incremental_value", "incremental_profit", "roi", "scenario_analysis")


def economics(totals: DataFrame, config: EconomicsConfig) -> DataFrame:
    """From strategy, customers_total, customers_targeted, targeting_threshold, incremental_conversions."""
    cost, worth = F.col("customers_targeted") * F.lit(float(config.communication_cost)), F.col("incremental_conversions") * F.lit(float(config.profit_per_conversion))
    out = totals.withColumns({
        "target_share": F.col("customers_targeted") / F.col("customers_total"), "communication_cost": F.lit(float(config.communication_cost)),
        "profit_per_conversion": F.lit(float(config.profit_per_conversion)), "marketing_cost": cost, "incremental_value": worth,
        "incremental_profit": worth - cost, "roi": F.when(cost > 0, (worth - cost) / cost), "scenario_analysis": F.lit(True),
    })
    rest = [c for c in totals.columns if c not in ECONOMICS]
    return out.select(*ECONOMICS, *rest)


def _checked(scores: DataFrame, column: str) -> None:
    require_columns(scores, [column], "scores", EconomicsError)
    if scores.isEmpty():
        raise EconomicsError("there are no scores")
    require_finite(scores, [column], EconomicsError)


def strategy_totals(scores: DataFrame, strategies: Sequence[tuple[str, float | None]], column: str = "predicted_uplift") -> DataFrame:
    """All strategies from one pass: per strategy a conditional count and sum. A threshold of None takes everyone."""
    u = F.col(column)
    hit = [F.lit(True) if t is None else u > F.lit(float(t)) for _, t in strategies]
    aggs = [F.count(F.lit(1)).alias("total")]
    for k, h in enumerate(hit):
        aggs += [F.count_if(h).alias(f"n{k}"), F.coalesce(F.sum(F.when(h, u)), F.lit(0.0)).alias(f"s{k}")]
    rows = [F.struct(F.lit(name).alias("strategy"), F.col("total").alias("customers_total"), F.col(f"n{k}").alias("customers_targeted"), F.lit(t).cast("double").alias("targeting_threshold"), F.col(f"s{k}").cast("double").alias("incremental_conversions")) for k, (name, t) in enumerate(strategies)]
    return scores.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def compare_strategies(scores: DataFrame, config: EconomicsConfig, threshold: float, column: str = "predicted_uplift") -> DataFrame:
    _checked(scores, column)
    if not math.isfinite(threshold):
        raise EconomicsError("the threshold must be finite")
    return economics(strategy_totals(scores, [("target_all", None), ("uplift_targeting", threshold)], column), config)


def target_all(scores: DataFrame, config: EconomicsConfig, column: str = "predicted_uplift") -> DataFrame:
    _checked(scores, column)
    return economics(strategy_totals(scores, [("target_all", None)], column), config)


def target_by_uplift(scores: DataFrame, config: EconomicsConfig, threshold: float, column: str = "predicted_uplift") -> DataFrame:
    _checked(scores, column)
    return economics(strategy_totals(scores, [("uplift_targeting", threshold)], column), config)


def evaluate_thresholds(scores: DataFrame, config: EconomicsConfig, thresholds: Sequence[float], column: str = "predicted_uplift") -> DataFrame:
    """A row per threshold of a given grid, in one pass over the scores."""
    if not thresholds or not all(math.isfinite(t) for t in thresholds):
        raise EconomicsError("thresholds must be finite, and at least one")
    _checked(scores, column)
    return economics(strategy_totals(scores, [("uplift_targeting", t) for t in sorted(thresholds)], column), config).orderBy("targeting_threshold")


def reachable_audiences(scores: DataFrame, column: str = "predicted_uplift") -> DataFrame:
    """Every audience that some threshold gives: the empty one, and one per distinct score.

    Scores are counted first, then summed from the greatest down in a
    distributed running sum.
    """
    counts = scores.groupBy(F.col(column).cast("double").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    upto = running(counts, [F.col("u").desc()], {"customers_targeted": F.col("n"), "incremental_conversions": F.col("u") * F.col("n")})
    total = counts.agg(F.sum("n").alias("customers_total"), F.max("u").alias("top"))
    each = upto.select(next_down(F.col("u")).alias("targeting_threshold"), "customers_targeted", "incremental_conversions").crossJoin(F.broadcast(total.select("customers_total")))
    none = total.select(F.col("top").alias("targeting_threshold"), F.lit(0).cast("long").alias("customers_targeted"), F.lit(0.0).alias("incremental_conversions"), "customers_total")
    return each.unionByName(none).withColumn("strategy", F.lit("uplift_targeting"))


def optimize_threshold(scores: DataFrame, config: EconomicsConfig, column: str = "predicted_uplift") -> DataFrame:
    """All reachable audiences by falling profit, then by size; the first row is the best.

    Profits are compared to six places, so that the order of summation can't
    decide between equal ones.
    """
    _checked(scores, column)
    return economics(reachable_audiences(scores, column), config).orderBy(F.round("incremental_profit", 6).desc(), "customers_targeted")


def select_model(comparison: DataFrame) -> str:
    """The supported model with the greatest finite Qini coefficient, the first by name of equal ones."""
    require_columns(comparison, ["model", "qini_coefficient"], "model comparison")
    best = comparison.filter(F.col("model").isin(*MODELS) & is_finite(F.col("qini_coefficient"))).orderBy(F.col("qini_coefficient").desc(), "model").first()
    if not best:
        raise UpliftError("no supported model has a finite Qini coefficient")
    return best["model"]


def model_scores(scores: DataFrame, model: str) -> DataFrame:
    """One model's columns under their common names."""
    if model not in MODELS:
        raise UpliftError(f"no model {model!r}")
    require_columns(scores, [f"{model}_{p}" for p in PARTS], "customer scores", UpliftError)
    identity = [c for c in ("client_id", "source_row_id") if c in scores.columns]
    if not identity:
        raise UpliftError("customer scores have no id")
    return scores.select(*identity, *[F.col(f"{model}_{p}").alias(p) for p in PARTS], F.lit(model).alias("selected_model"))


def optimize_business(scores: DataFrame, config: EconomicsConfig, model: str, threshold: float, folder: str, effect: float = 0.05, outcome: float = 0.5) -> dict[str, str]:
    """Types and decisions by customer, the comparison and the search, each written as a table."""
    own = model_scores(scores, model)
    tables = {
        "customer_targeting": (apply_rule(assign_types(own, effect, outcome), threshold), False),
        "business_scenarios": (compare_strategies(own, config, threshold).withColumn("selected_model", F.lit(model)), True),
        "threshold_optimization": (optimize_threshold(own, config).withColumn("selected_model", F.lit(model)), False),
    }
    return {name: write_atomic(t, f"{folder}/{name}.parquet", small) for name, (t, small) in tables.items()}
