import math

import pytest
from pyspark.sql import functions as F

from plumbline.errors import EconomicsError, UpliftError
from plumbline.operators import semantic, targeting

CONFIG = targeting.EconomicsConfig(2, 100)


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(k, u) for k, u in enumerate([0.2, 0.1, -0.05, 0.0])], "client_id long, predicted_uplift double")


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(k, p0, p1) for k, (p0, p1) in enumerate([(0.2, 0.5), (0.8, 0.82), (0.6, 0.3), (0.1, 0.12)])]
    df = spark.createDataFrame(rows, "client_id long, p0 double, p1 double")
    return df.select("client_id", *[c for m in targeting.MODELS for c in (F.col("p0").alias(f"{m}_probability_control"), F.col("p1").alias(f"{m}_probability_treatment"), (F.col("p1") - F.col("p0")).alias(f"{m}_predicted_uplift"))])


def test_strategies(scores):
    all_, chosen = targeting.compare_strategies(scores, CONFIG, 0.05).orderBy("strategy").collect()
    assert (all_["strategy"], all_["customers_targeted"], all_["marketing_cost"], all_["targeting_threshold"]) == ("target_all", 4, 8, None)
    assert math.isclose(all_["incremental_conversions"], 0.25) and math.isclose(all_["incremental_profit"], 17) and math.isclose(all_["roi"], 2.125)
    assert chosen["customers_targeted"] == 2 and math.isclose(chosen["incremental_conversions"], 0.3)
    assert math.isclose(chosen["incremental_profit"], 26) and math.isclose(chosen["roi"], 6.5) and chosen["target_share"] == 0.5
    free = targeting.target_all(scores, targeting.EconomicsConfig(0, 120)).first()
    assert free["roi"] is None and math.isclose(free["incremental_profit"], 30)
    assert targeting.target_by_uplift(scores, CONFIG, 0.05).first()["customers_targeted"] == 2


def test_published_economics():
    assert round(232652 / 400078, 3) == 0.582 and round(343582 / 242334, 3) == 1.418


def test_threshold_search(scores):
    rows = targeting.optimize_threshold(scores, CONFIG).collect()
    assert len(rows) == 5 and math.isclose(rows[0]["incremental_profit"], 26) and rows[0]["customers_targeted"] == 2
    assert sorted(r["customers_targeted"] for r in rows) == [0, 1, 2, 3, 4]
    for r in rows:
        assert scores.filter(F.col("predicted_uplift") > r["targeting_threshold"]).count() == r["customers_targeted"]
    assert rows[0]["targeting_threshold"] == math.nextafter(0.1, -math.inf)


def test_equal_scores_go_together(spark):
    df = spark.createDataFrame([(0.1,)] * 3 + [(0.2,)], "predicted_uplift double")
    assert sorted(r["customers_targeted"] for r in targeting.optimize_threshold(df, CONFIG).collect()) == [0, 1, 4]


def test_grid(scores):
    rows = targeting.evaluate_thresholds(scores, CONFIG, [0.1, -1.0, 0.0]).collect()
    assert [(r["targeting_threshold"], r["customers_targeted"]) for r in rows] == [(-1.0, 4), (0.0, 2), (0.1, 1)]


def test_types_and_rule(wide):
    typed = targeting.assign_types(targeting.model_scores(wide, "t_learner")).orderBy("client_id")
    assert [r["modeled_customer_type"] for r in typed.collect()] == ["Persuadables", "Sure Things", "Sleeping Dogs", "Lost Causes"]
    assert targeting.apply_rule(typed, 0.05).filter("is_targeted").count() == 1
    assert [r["is_targeted"] for r in targeting.apply_rule(typed.limit(1).withColumn("predicted_uplift", F.lit(0.05)), 0.05).collect()] == [False]


def test_model_choice(spark):
    make = lambda *rows: spark.createDataFrame(rows, "model string, qini_coefficient double")
    assert targeting.select_model(make(("s_learner", -2.45), ("t_learner", 98.82), ("other", 500.0))) == "t_learner"
    assert targeting.select_model(make(("t_learner", 1.0), ("s_learner", 1.0))) == "s_learner"
    with pytest.raises(UpliftError):
        targeting.select_model(make(("s_learner", float("nan")), ("t_learner", None)))


def test_outputs_are_written(spark, wide, tmp_path):
    paths = targeting.optimize_business(wide, CONFIG, "s_learner", 0.05, str(tmp_path))
    assert {n: spark.read.parquet(p).count() for n, p in paths.items()} == {"customer_targeting": 4, "business_scenarios": 2, "threshold_optimization": 5}


def test_wrong_inputs(spark, scores, wide):
    nan = scores.withColumn("predicted_uplift", F.lit(float("nan")))
    own = targeting.model_scores(wide, "s_learner")
    for error, bad in (
        (EconomicsError, lambda: targeting.EconomicsConfig(-1, 2)),
        (EconomicsError, lambda: targeting.EconomicsConfig(1, math.inf)),
        (EconomicsError, lambda: targeting.target_all(scores.limit(0), CONFIG)),
        (EconomicsError, lambda: targeting.target_all(nan, CONFIG)),
        (EconomicsError, lambda: targeting.evaluate_thresholds(scores, CONFIG, [])),
        (UpliftError, lambda: targeting.apply_rule(nan, 0.1)),
        (UpliftError, lambda: targeting.apply_rule(scores, math.nan)),
        (UpliftError, lambda: targeting.assign_types(own.withColumn("probability_control", F.lit(1.5)))),
        (UpliftError, lambda: targeting.assign_types(own.withColumn("predicted_uplift", F.lit(0.9)))),
        (UpliftError, lambda: targeting.assign_types(own, effect=-1)),
        (UpliftError, lambda: targeting.model_scores(wide, "x_learner")),
        (UpliftError, lambda: targeting.model_scores(wide.drop("client_id"), "s_learner")),
    ):
        with pytest.raises(error):
            bad()


def test_measures(spark):
    fact = spark.createDataFrame([(1, str(k), k % 2, int(k in (1, 3, 4))) for k in range(8)], "experiment_key long, customer_id string, treatment int, target int")
    row = semantic.experiment_measures(fact).first()
    assert (row["users"], row["control_users"], row["conversions"], row["control_cr"], row["treatment_cr"]) == (8, 4, 3, 0.25, 0.5)
    assert (row["absolute_uplift"], row["relative_uplift"], row["incremental_conversions"]) == (0.25, 1.0, 1.0)
    assert semantic.experiment_measures(fact, ["treatment"]).filter("treatment = 0").first()["treatment_cr"] is None
    results = spark.createDataFrame([(1, 0.5), (2, 0.7)], "experiment_key long, p_value double").withColumns({c: F.lit(0.1) for c in ("ci_lower", "ci_upper", "achieved_power", "mde_absolute")})
    assert semantic.result_measures(results).first()["p_value"] is None
    assert semantic.result_measures(results.filter("experiment_key = 2")).first()["p_value"] == 0.7


def test_status_and_grids(spark):
    rows = [(None, False, False, 0.1), (0.01, True, True, 0.1), (0.01, False, True, 0.1), (0.01, False, True, -0.1), (0.5, False, False, 0.1)]
    df = spark.createDataFrame(rows, "p double, srm boolean, s boolean, u double")
    got = [r[0] for r in df.select(semantic.status(*(F.col(c) for c in ("p", "srm", "s", "u")))).collect()]
    assert got == ["not calculated", "randomization error", "significant positive effect", "significant negative effect", "no significant effect"]
    assert [semantic.grid(spark, g).count() for g in semantic.GRIDS] == [41, 101, 71]


def test_what_if_counts_each_threshold(spark, scores):
    grid = spark.createDataFrame([(-0.05,), (0.0,), (0.15,), (0.9,)], "targeting_threshold double")
    got = {r["targeting_threshold"]: r["customers_targeted"] for r in semantic.what_if(scores, grid).collect()}
    assert got == {-0.05: 3, 0.0: 2, 0.15: 1, 0.9: 0}
