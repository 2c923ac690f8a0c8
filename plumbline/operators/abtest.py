"""Inference on a two-armed experiment with a binary outcome."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExperimentError, PowerError
from ..functions import inference as stats
from ..sources.sinks import write_atomic
from .guards import require_binary, require_columns


@dataclass(frozen=True)
class ABResult:
    control_size: int
    treatment_size: int
    control_conversions: int
    treatment_conversions: int
    control_cr: float
    treatment_cr: float
    absolute_uplift: float
    relative_uplift: float | None
    standard_error: float
    null_standard_error: float
    z_statistic: float
    p_value: float
    ci_lower: float
    ci_upper: float
    control_ci_lower: float
    control_ci_upper: float
    treatment_ci_lower: float
    treatment_ci_upper: float
    effect_size: float
    achieved_power: float
    required_control_size: int | None
    required_treatment_size: int | None
    required_total_size: int | None
    mde_absolute: float | None
    alpha: float
    target_power: float
    alternative: str
    statistically_significant: bool
    warnings: tuple[str, ...]


DDL = {int: "long", float: "double", str: "string", bool: "boolean"}


def one_row(spark: SparkSession, record) -> DataFrame:
    """A dataclass as a table of one row, typed by its fields; tuples as JSON."""
    types = {"int": "long", "float": "double", "str": "string", "bool": "boolean", "tuple": "string"}
    columns, values = [], []
    for f in fields(record):
        kind = str(f.type).split(" ")[0].split("[")[0]
        value = getattr(record, f.name)
        columns.append(f"{f.name} {types[kind]}")
        values.append(json.dumps(list(value), ensure_ascii=False) if kind == "tuple" else float(value) if kind == "float" and value is not None else value)
    return spark.createDataFrame([tuple(values)], ", ".join(columns))


def run_ab_test(control_conversions: int, control_size: int, treatment_conversions: int, treatment_size: int, alpha: float = 0.05, target_power: float = 0.8, alternative: str = "two-sided") -> ABResult:
    s0, n0, s1, n1 = control_conversions, control_size, treatment_conversions, treatment_size
    p0, p1 = stats.rate(s0, n0), stats.rate(s1, n1)
    stats.check_share(target_power, "target power")
    z, p, pooled_error = stats.z_test(s0, n0, s1, n1, alternative)
    interval = stats.difference_interval(s0, n0, s1, n1, alpha, alternative)
    own0, own1 = stats.wilson_interval(s0, n0, alpha), stats.wilson_interval(s1, n1, alpha)
    warnings, size, mde = [], None, None
    if p0 == 0:
        warnings.append("relative uplift is undefined for a control rate of 0")
    if p0 == p1:
        warnings.append("required sample size is undefined for no effect")
    else:
        try:
            size = stats.required_sample_size(p0, p1, target_power, alpha, n1 / n0, alternative)
        except PowerError as e:
            warnings.append(f"required sample size: {e}")
    try:
        mde = stats.minimum_detectable_effect(p0, n0, n1, target_power, alpha, alternative)
    except PowerError as e:
        warnings.append(f"minimum detectable effect: {e}")
    return ABResult(
        n0, n1, s0, s1, p0, p1, p1 - p0, stats.relative(p0, p1), stats.difference_error(s0, n0, s1, n1), pooled_error, z, p,
        interval.lower, interval.upper, own0.lower, own0.upper, own1.lower, own1.upper, stats.cohens_h(p0, p1),
        stats.achieved_power(p0, p1, n0, n1, alpha, alternative), size and size.control_size, size and size.treatment_size, size and size.total_size,
        mde, alpha, target_power, alternative, p < alpha, tuple(warnings),
    )


def arm_totals(df: DataFrame, treatment: str = "treatment", target: str = "target") -> DataFrame:
    """One row: sizes and conversions of both arms."""
    t, y = F.col(treatment), F.col(target)
    return df.agg(
        F.count_if(t == 0).alias("control_size"),
        F.count_if((t == 0) & (y == 1)).alias("control_conversions"),
        F.count_if(t == 1).alias("treatment_size"),
        F.count_if((t == 1) & (y == 1)).alias("treatment_conversions"),
    )


def checked_arms(df: DataFrame, treatment: str = "treatment", target: str = "target") -> tuple[int, int, int, int]:
    """Conversions and size of control and treatment, which must both be there."""
    require_columns(df, [treatment, target], "experiment", ExperimentError)
    require_binary(df, [treatment, target])
    t = arm_totals(df, treatment, target).first()
    if not t["control_size"] or not t["treatment_size"]:
        raise ExperimentError("both arms must have customers")
    return t["control_conversions"], t["control_size"], t["treatment_conversions"], t["treatment_size"]


def analyse_experiment(df: DataFrame, treatment: str = "treatment", target: str = "target", **how) -> ABResult:
    return run_ab_test(*checked_arms(df, treatment, target), **how)


def materialize_result(spark: SparkSession, result: ABResult, path: str) -> str:
    return write_atomic(one_row(spark, result), path, small=True)


def record(result) -> dict:
    return asdict(result)
