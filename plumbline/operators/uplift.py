"""Holdout split and ranking metrics of uplift scores.

Order is total: by falling score, equal scores by an id. Curves and deciles are
distributed running counts; gains come from two whole numbers, so they are the
same however the rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import UpliftError
from ..functions.ordered import running
from ..sources.staging import staged
from .guards import require_binary, require_columns, require_finite

RESERVED = "__row_id__"


def infer_features(df: DataFrame, ids: Sequence[str] = ("client_id",), treatment: str = "treatment", target: str = "target") -> list[str]:
    found = [c for c in df.columns if c not in (*ids, treatment, target)]
    if not found:
        raise UpliftError("there are no features")
    return found


def require_modelable(df: DataFrame, features: Sequence[str], treatment: str = "treatment", target: str = "target") -> None:
    if not features or len(set(features)) != len(features):
        raise UpliftError("features must be given, each once")
    if {treatment, target} & set(features):
        raise UpliftError("a label can't be a feature")
    require_columns(df, [*features, treatment, target], "mart", UpliftError)
    if df.isEmpty():
        raise UpliftError("there are no customers")
    require_binary(df, [treatment, target], UpliftError)


def split(df: DataFrame, id_col: str = "client_id", share: float = 0.3, seed: int = 42, treatment: str = "treatment", target: str = "target") -> DataFrame:
    """``df`` with ``is_holdout``: of each treatment x target stratum its part of the share, by the order of md5(id:seed).

    The holdout has ceil(n share) rows; strata get whole numbers in proportion,
    what is left goes to the greatest fractions.
    """
    if not 0 < share < 1:
        raise UpliftError("the share must be between 0 and 1")
    if RESERVED in df.columns:
        raise UpliftError(f"{RESERVED} is reserved")
    require_binary(df, [treatment, target], UpliftError)
    stratum = (F.col(treatment) * 2 + F.col(target)).cast("int")
    keyed = df.withColumns({"__stratum": stratum, "__key": F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))})
    sizes = {r["__stratum"]: r["count"] for r in keyed.groupBy("__stratum").count().collect()}
    if len(sizes) < 4 or min(sizes.values()) < 2:
        raise UpliftError("each combination of treatment and target needs two customers")
    total = sum(sizes.values())
    wanted = math.ceil(total * share)
    parts = {s: wanted * n // total for s, n in sizes.items()}
    for s in sorted(sizes, key=lambda s: (-(wanted * sizes[s] % total), s))[: wanted - sum(parts.values())]:
        parts[s] += 1
    order = [F.col("__stratum"), F.col("__key"), F.col(id_col)]
    placed = running(keyed, order, position="__place")
    ahead, last = F.lit(0), F.lit(0)
    for s in sorted(sizes):
        ahead = F.when(F.col("__stratum") == s, sum(sizes[x] for x in sizes if x < s)).otherwise(ahead)
        last = F.when(F.col("__stratum") == s, parts[s]).otherwise(last)
    return placed.withColumn("is_holdout", F.col("__place") - ahead <= last).drop("__place", "__stratum", "__key")


@dataclass(frozen=True)
class Evaluation:
    summary: DataFrame
    curve: DataFrame
    deciles: DataFrame


def ranked(df: DataFrame, id_col: str = "client_id", score: str = "predicted_uplift", treatment: str = "treatment", target: str = "target") -> tuple[DataFrame, int, float]:
    """Rows with their rank and running counts of both arms' conversions; how many rows; the treated share."""
    require_columns(df, [id_col, score, treatment, target], "scores", UpliftError)
    require_binary(df, [treatment, target], UpliftError)
    require_finite(df, [score], UpliftError)
    n, treated = df.agg(F.count(F.lit(1)), F.sum(F.col(treatment).cast("long"))).first()
    if not n or treated in (0, n):
        raise UpliftError("both arms must have customers")
    t, y = F.col(treatment).cast("long"), F.col(target).cast("long")
    rows = df.select(F.col(id_col).alias("id"), F.col(score).cast("double").alias("score"), t.alias("t"), y.alias("y"))
    rows = running(rows, [F.col("score").desc(), F.col("id")], {"won": F.col("t") * F.col("y"), "lost": (1 - F.col("t")) * F.col("y")}, position="rank")
    return staged(rows, "ranked"), n, treated / n


def curve_of(rows: DataFrame, n: int, share: float) -> DataFrame:
    gain = F.col("won") / F.lit(share) - F.col("lost") / F.lit(1 - share)
    points = rows.select("rank", F.col("rank").alias("customers"), (F.col("rank") / F.lit(n)).alias("targeted_fraction"), F.col("score").alias("predicted_uplift"), gain.alias("cumulative_incremental_purchases"))
    ends = rows.agg(F.max("score").alias("predicted_uplift"), F.max("won").alias("won"), F.max("lost").alias("lost"))
    final = ends.select(gain.alias("__final"))
    origin = ends.select(F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("customers"), F.lit(0.0).alias("targeted_fraction"), "predicted_uplift", F.lit(0.0).alias("cumulative_incremental_purchases"))
    every = points.unionByName(origin).crossJoin(F.broadcast(final))
    return every.select(
        "rank", "customers", "targeted_fraction", "predicted_uplift", "cumulative_incremental_purchases",
        F.when(F.col("rank") > 0, F.col("cumulative_incremental_purchases") / F.col("rank")).otherwise(0.0).alias("cumulative_uplift"),
        (F.col("targeted_fraction") * F.col("__final")).alias("qini_random_baseline"),
    )


def deciles_of(rows: DataFrame, n: int, bins: int = 10) -> DataFrame:
    if isinstance(bins, bool) or not isinstance(bins, int) or bins <= 0:
        raise UpliftError("bins must be a positive whole number")
    bins = min(bins, n)
    t, y = F.col("t"), F.col("y")
    groups = rows.withColumn("decile", (F.floor((F.col("rank") - 1) * bins / F.lit(n)) + 1).cast("int")).groupBy("decile").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(t == 0).alias("control_size"),
        F.count_if(t == 1).alias("treatment_size"),
        F.avg("score").alias("avg_predicted_uplift"),
        F.avg(F.when(t == 1, y)).alias("treatment_cr"),
        F.avg(F.when(t == 0, y)).alias("control_cr"),
    )
    effect = F.col("treatment_cr") - F.col("control_cr")
    groups = groups.withColumns({"observed_uplift": effect, "incremental_purchases": F.col("customers") * effect})
    upto = W.orderBy("decile").rowsBetween(W.unboundedPreceding, 0)  # as many rows as bins
    known = F.count_if(F.col("incremental_purchases").isNull()).over(upto) == 0
    return groups.withColumn("cumulative_incremental_purchases", F.when(known, F.sum("incremental_purchases").over(upto)))


def summary_of(rows: DataFrame, n: int, share: float) -> DataFrame:
    """Areas by the trapezoid rule; ranks are evenly spaced, so they are sums over all rows."""
    gain = F.col("won") / F.lit(share) - F.col("lost") / F.lit(1 - share)
    t, y = F.col("t"), F.col("y")
    sums = rows.agg(
        F.sum(gain / F.col("rank")).alias("uplifts"),
        F.sum(gain).alias("gains"),
        (F.max("won") / F.lit(share) - F.max("lost") / F.lit(1 - share)).alias("final"),
        (F.avg(F.when(t == 1, y)) - F.avg(F.when(t == 0, y))).alias("overall"),
    )
    auuc = (F.col("uplifts") - F.col("final") / n / 2) / n
    above = F.col("gains") - F.col("final") * ((n + 1) / 2)  # the baseline at rank k is final k / n
    return sums.select(auuc.alias("auuc"), (above / n).alias("qini_coefficient"), F.col("overall").alias("overall_observed_uplift"), F.col("final").alias("final_incremental_purchases"))


def evaluate(df: DataFrame, id_col: str = "client_id", score: str = "predicted_uplift", bins: int = 10, treatment: str = "treatment", target: str = "target") -> Evaluation:
    rows, n, share = ranked(df, id_col, score, treatment, target)
    return Evaluation(summary_of(rows, n, share), curve_of(rows, n, share), deciles_of(rows, n, bins))
