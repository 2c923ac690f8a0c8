"""Is the experiment sound: sample ratio, A/A and bootstrap distributions, segments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExperimentError
from ..functions import inference as stats
from ..functions import inference_columns as columns
from ..sources.sinks import write_atomic
from ..sources.staging import staged
from .abtest import analyse_experiment, checked_arms, materialize_result, one_row
from .guards import require_binary, require_columns

UNKNOWN = "unknown"
SEGMENTS = ("age_group", "gender", "rfm_segment", "spending_quantile", "purchase_frequency_quantile", "recency_group")
# Upper bounds (exclusive) of the age groups and least scores of the recency groups, with their labels.
AGE_GROUPS = [(25, "under 25"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64")]
OLDEST_GROUP = "65+"
RECENCY_GROUPS = [(4, "recent"), (2, "middle")]
LEAST_RECENT = "old"


@dataclass(frozen=True)
class SRMResult:
    observed_control: int
    observed_treatment: int
    expected_control: float
    expected_treatment: float
    expected_control_share: float
    expected_treatment_share: float
    chi_square_statistic: float
    p_value: float
    alpha: float
    srm_detected: bool


def check_srm(control: int, treatment: int, expected_treatment_share: float = 0.5, alpha: float = 0.05) -> SRMResult:
    stats.check_share(expected_treatment_share, "expected share")
    stats.check_share(alpha, "alpha")
    for n in (control, treatment):
        if isinstance(n, bool) or not isinstance(n, (int, np.integer)) or n < 0:
            raise ExperimentError(f"a group's size can't be {n!r}")
    total = control + treatment
    if not total:
        raise ExperimentError("there are no customers")
    e0, e1 = total * (1 - expected_treatment_share), total * expected_treatment_share
    chi = (control - e0) ** 2 / e0 + (treatment - e1) ** 2 / e1
    p = stats.chi_square_tail(chi)
    return SRMResult(control, treatment, e0, e1, 1 - expected_treatment_share, expected_treatment_share, chi, p, alpha, p < alpha)


def check_srm_frame(df: DataFrame, treatment: str = "treatment", **how) -> SRMResult:
    require_columns(df, [treatment], "experiment", ExperimentError)
    require_binary(df, [treatment])
    n0, n1 = df.agg(F.count_if(F.col(treatment) == 0), F.count_if(F.col(treatment) == 1)).first()
    return check_srm(n0, n1, **how)


@dataclass(frozen=True)
class AASummary:
    simulations: int
    sample_size: int
    split_a_size: int
    split_b_size: int
    alpha: float
    false_positives: int
    false_positive_rate: float
    mean_p_value: float
    median_p_value: float
    ks_uniform_statistic: float
    ks_uniform_p_value: float
    random_state: int | None


def simulate_aa(successes: int, total: int, simulations: int = 1000, alpha: float = 0.05, random_state: int | None = 42) -> tuple[AASummary, np.ndarray]:
    """Splits of one group in halves (the second gets the odd one), each tested.

    A random half's conversions are hypergeometric, so only two counts of the
    group are needed. The array has (conversions a, conversions b, z, p) by row.
    """
    stats.check_counts(successes, total)
    stats.check_share(alpha, "alpha")
    if total < 2:
        raise ExperimentError("a group must have two customers to be split")
    if isinstance(simulations, bool) or not isinstance(simulations, int) or simulations < 1:
        raise ExperimentError("simulations must be a positive whole number")
    a_size = total // 2
    b_size = total - a_size
    a = np.random.default_rng(random_state).hypergeometric(successes, total - successes, a_size, simulations)
    rows = np.array([(x, successes - x, *stats.z_test(int(x), a_size, int(successes - x), b_size)[:2]) for x in a.tolist()], float)
    p = rows[:, 3]
    false = int((p < alpha).sum())
    return AASummary(simulations, total, a_size, b_size, alpha, false, false / simulations, float(p.mean()), float(np.median(p)), *stats.ks_uniform(p), random_state), rows


def aa_table(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    made = [(k + 1, int(a), int(b), float(z), float(p)) for k, (a, b, z, p) in enumerate(rows.tolist())]
    return spark.createDataFrame(made, "simulation long, successes_a long, successes_b long, z_statistic double, p_value double")


def simulate_aa_frame(df: DataFrame, treatment: str = "treatment", target: str = "target", **how) -> tuple[AASummary, DataFrame]:
    """Over the control arm."""
    s0, n0, _, _ = checked_arms(df, treatment, target)
    summary, rows = simulate_aa(s0, n0, **how)
    return summary, aa_table(df.sparkSession, rows)


@dataclass(frozen=True)
class BootstrapSummary:
    iterations: int
    control_size: int
    treatment_size: int
    observed_uplift: float
    mean_uplift: float
    median_uplift: float
    ci_lower: float
    ci_upper: float
    confidence_level: float
    random_state: int | None


def bootstrap(s0: int, n0: int, s1: int, n1: int, iterations: int = 10_000, level: float = 0.95, random_state: int | None = 42) -> tuple[BootstrapSummary, np.ndarray]:
    """Resampled differences of the rates: a resample's conversions are binomial."""
    p0, p1 = stats.rate(s0, n0), stats.rate(s1, n1)
    stats.check_share(level, "confidence level")
    if isinstance(iterations, bool) or not isinstance(iterations, int) or iterations < 1:
        raise ExperimentError("iterations must be a positive whole number")
    rng = np.random.default_rng(random_state)
    draws = rng.binomial(n1, p1, iterations) / n1 - rng.binomial(n0, p0, iterations) / n0
    low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return BootstrapSummary(iterations, n0, n1, p1 - p0, float(draws.mean()), float(np.median(draws)), float(low), float(high), level, random_state), draws


def bootstrap_frame(df: DataFrame, treatment: str = "treatment", target: str = "target", **how) -> tuple[BootstrapSummary, DataFrame]:
    summary, draws = bootstrap(*checked_arms(df, treatment, target), **how)
    return summary, df.sparkSession.createDataFrame([(k + 1, x) for k, x in enumerate(draws.tolist())], "iteration long, uplift double")


def add_segments(df: DataFrame) -> DataFrame:
    """``df`` with age_group and recency_group."""
    require_columns(df, ["age", "gender", "rfm_segment", "spending_quantile", "purchase_frequency_quantile", "recency_score"], "mart", ExperimentError)
    age, recency = F.when(F.col("age").isNull(), UNKNOWN), F.when(F.col("recency_score").isNull(), UNKNOWN)
    for bound, label in AGE_GROUPS:
        age = age.when(F.col("age") < bound, label)
    for least, label in RECENCY_GROUPS:
        recency = recency.when(F.col("recency_score") >= least, label)
    return df.withColumns({"age_group": age.otherwise(OLDEST_GROUP), "recency_group": recency.otherwise(LEAST_RECENT)})


def segment_totals(df: DataFrame, dimensions: Sequence[str], treatment: str = "treatment", target: str = "target") -> DataFrame:
    """Per dimension and segment the arms' sizes and conversions: all dimensions in one aggregate."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    long = df.select(F.col(treatment).alias("t"), F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), label(c).alias("segment")) for c in dimensions])).alias("x"))
    return long.groupBy("x.dimension", "x.segment").agg(
        F.count_if(F.col("t") == 0).alias("control_size"),
        F.count_if(F.col("t") == 1).alias("treatment_size"),
        F.count_if((F.col("t") == 0) & (F.col("y") == 1)).alias("control_conversions"),
        F.count_if((F.col("t") == 1) & (F.col("y") == 1)).alias("treatment_conversions"),
    )


def segment_effects(df: DataFrame, dimensions: Sequence[str] = SEGMENTS, alpha: float = 0.05, treatment: str = "treatment", target: str = "target") -> DataFrame:
    """The effect in every segment with both arms; p-values adjusted over all dimensions together."""
    both = segment_totals(df, dimensions, treatment, target).filter("control_size > 0 AND treatment_size > 0")
    s0, n0, s1, n1 = (F.col(c).cast("double") for c in ("control_conversions", "control_size", "treatment_conversions", "treatment_size"))
    p0, p1 = s0 / n0, s1 / n1
    lower, upper = columns.difference_interval(s0, n0, s1, n1, alpha)
    tested = both.withColumns({
        "control_cr": p0, "treatment_cr": p1, "absolute_uplift": p1 - p0, "relative_uplift": F.when(p0 > 0, (p1 - p0) / p0),
        "ci_lower": lower, "ci_upper": upper, "p_value": columns.two_sided(columns.z_statistic(s0, n0, s1, n1)),
    })
    tested = tested.withColumns({"confidence_interval": F.format_string("[%.6f, %.6f]", "ci_lower", "ci_upper"), "significant_raw": F.col("p_value") < alpha})
    tested = columns.adjusted(tested, "p_value", "adjusted_p_value", ["dimension", "segment"])
    return tested.withColumn("significant_adjusted", F.col("adjusted_p_value") <= alpha)


def analyse_segments(df: DataFrame, dimensions: Sequence[str] = SEGMENTS, alpha: float = 0.05, treatment: str = "treatment", target: str = "target", add_default_groups: bool = True) -> DataFrame:
    if add_default_groups:
        df = add_segments(df)
    require_columns(df, [*dimensions, treatment, target], "mart", ExperimentError)
    require_binary(df, [treatment, target])
    found = staged(segment_effects(df, dimensions, alpha, treatment, target), "segments")
    if found.isEmpty():
        raise ExperimentError("no segment has both arms")
    return found.orderBy("dimension", "segment")


def validate_experiment(df: DataFrame, folder: str, expected_treatment_share: float = 0.5, alpha: float = 0.05, simulations: int = 1000, iterations: int = 10_000, random_state: int = 42) -> dict[str, str]:
    """All checks, each written as a table."""
    spark = df.sparkSession
    result = analyse_experiment(df, alpha=alpha)
    srm = check_srm_frame(df, expected_treatment_share=expected_treatment_share, alpha=alpha)
    aa, aa_rows = simulate_aa_frame(df, simulations=simulations, alpha=alpha, random_state=random_state)
    boot, boot_rows = bootstrap_frame(df, iterations=iterations, level=1 - alpha, random_state=random_state)
    materialize_result(spark, result, f"{folder}/experiment_results.parquet")
    tables = {
        "srm": one_row(spark, srm), "aa_summary": one_row(spark, aa), "aa_simulations": aa_rows, "bootstrap_summary": one_row(spark, boot),
        "bootstrap_distribution": boot_rows, "segment_analysis": analyse_segments(df, alpha=alpha),
    }
    return {name: write_atomic(t, f"{folder}/experiment_validation/{name}.parquet", small=True) for name, t in tables.items()}
