import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.errors import UpliftError
from plumbline.operators import learners, uplift


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(600):
        x, c, t = float(rng.normal()), ["a", "b", None][k % 3], int(rng.random() < 0.5)
        p = 1 / (1 + math.exp(-(-0.5 + 0.8 * x + 0.9 * t * (c == "a"))))
        rows.append((k, x if k % 50 else None, c, t, int(rng.random() < p)))
    return spark.createDataFrame(rows, "client_id long, numeric_feature double, category_feature string, treatment int, target int")


@pytest.fixture(scope="module")
def ranking(spark):
    """The first hundred have a high effect: all treated ones convert, no control does; the others the same in both arms."""
    rows = [(k, k % 2, k % 2 if k < 100 else k // 2 % 2, 1.0 if k < 100 else 0.0) for k in range(200)]
    return spark.createDataFrame(rows, "client_id long, treatment int, target int, predicted_uplift double")


def brute(rows, bins=10):
    rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    n, e = len(rows), sum(r[1] for r in rows) / len(rows)
    gains = np.cumsum([y * t / e - y * (1 - t) / (1 - e) for _, t, y, _ in rows])
    fraction = np.arange(n + 1) / n
    gains = np.concatenate([[0], gains])
    uplifts = np.concatenate([[0], gains[1:] / np.arange(1, n + 1)])
    return gains, np.trapezoid(uplifts, fraction), np.trapezoid(gains - fraction * gains[-1], fraction), [math.floor(i * bins / n) + 1 for i in range(n)]


def test_curve_deciles_and_areas(ranking):
    found = uplift.evaluate(ranking)
    rows = [tuple(r) for r in ranking.collect()]
    gains, auuc, qini, bins = brute(rows)
    curve = found.curve.orderBy("rank").collect()
    assert len(curve) == 201 and np.allclose([r["cumulative_incremental_purchases"] for r in curve], gains)
    assert (curve[0]["predicted_uplift"], curve[0]["cumulative_uplift"]) == (1.0, 0.0)
    summary = found.summary.first()
    assert math.isclose(summary["auuc"], auuc) and math.isclose(summary["qini_coefficient"], qini)
    assert math.isclose(summary["final_incremental_purchases"], 100.0) and math.isclose(summary["overall_observed_uplift"], 0.5)
    deciles = found.deciles.orderBy("decile").collect()
    assert [r["customers"] for r in deciles] == [20] * 10 == [bins.count(k) for k in range(1, 11)]
    assert deciles[0]["observed_uplift"] == 1 and math.isclose(deciles[4]["cumulative_incremental_purchases"], 100)
    backwards = uplift.evaluate(ranking.withColumn("predicted_uplift", -F.col("predicted_uplift"))).summary.first()
    assert summary["qini_coefficient"] > 0 > backwards["qini_coefficient"]


def test_uneven_bins_and_missing_arms(spark):
    rows = [(k, int(k > 0), k % 2, float(-k)) for k in range(13)]
    found = uplift.evaluate(spark.createDataFrame(rows, "client_id long, treatment int, target int, predicted_uplift double")).deciles.orderBy("decile").collect()
    assert [r["customers"] for r in found] == [2, 1, 1, 2, 1, 1, 2, 1, 1, 1]
    assert found[0]["observed_uplift"] is not None and found[1]["observed_uplift"] is None
    assert found[0]["cumulative_incremental_purchases"] is not None and all(r["cumulative_incremental_purchases"] is None for r in found[1:])


def test_split_is_stratified_and_reproducible(customers):
    parts = uplift.split(customers, seed=3)
    held = {r["client_id"] for r in parts.filter("is_holdout").collect()}
    assert held == {r["client_id"] for r in uplift.split(customers.orderBy(F.rand()), seed=3).filter("is_holdout").collect()}
    assert len(held) == math.ceil(600 * 0.3) and held != {r["client_id"] for r in uplift.split(customers, seed=4).filter("is_holdout").collect()}
    shares = parts.groupBy("treatment", "target").agg(F.avg(F.col("is_holdout").cast("int")).alias("share")).collect()
    assert all(abs(r["share"] - 0.3) < 0.01 for r in shares)


def test_learners_recover_the_effect(customers):
    found = learners.train_and_evaluate(customers)
    scores = found.customer_scores
    assert scores.count() == 600 and found.predictions.count() == 180
    for name in learners.LEARNERS:
        p0, p1, u = (F.col(f"{name}_{c}") for c in ("probability_control", "probability_treatment", "predicted_uplift"))
        assert scores.filter((F.abs(p1 - p0 - u) > 1e-9) | ~p0.between(0, 1) | ~p1.between(0, 1)).count() == 0
        assert scores.agg(F.avg(u)).first()[0] > 0
    by = {r["category_feature"]: r["u"] for r in scores.join(customers, "client_id").groupBy("category_feature").agg(F.avg("t_learner_predicted_uplift").alias("u")).collect()}
    assert by["a"] > by["b"] + 0.05
    rows = {r["model"]: r for r in found.comparison.collect()}
    assert rows.keys() == learners.LEARNERS.keys() and {(r["train_customers"], r["holdout_customers"]) for r in rows.values()} == {(420, 180)}
    assert found.deciles.count() == 20 and found.curves.count() == 2 * 181


def test_model_matches_a_newton_solution(customers):
    df = customers.filter("numeric_feature IS NOT NULL")
    s = learners.SLearner().fit(df, ["numeric_feature"])
    rows = df.select("numeric_feature", "treatment", "target").collect()
    x = np.array([(r[0], r[1]) for r in rows], float)
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    y, w = np.array([r[2] for r in rows], float), np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    assert np.allclose(s.model.coefficients.toArray(), w[:2], atol=1e-5) and math.isclose(s.model.intercept, w[2], abs_tol=1e-5)


def test_medians_in_either_way(customers, monkeypatch):
    rows = customers.select(F.col("numeric_feature").alias("x"), F.col("client_id").cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    want = learners._medians(rows, ["x", "y", "z"])
    monkeypatch.setattr(learners, "GATHERED", 0)
    assert learners._medians(rows, ["x", "y", "z"]) == want and want["z"] is None


def test_unseen_categories_and_all_kinds_of_features(spark, customers):
    kinds = customers.withColumns({"flag": F.col("client_id") % 2 == 0, "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("client_id").cast("int")), "at": F.timestamp_seconds("client_id"), "nothing": F.lit(None).cast("double")})
    t = learners.TLearner().fit(kinds, ["numeric_feature", "category_feature", "flag", "day", "at", "nothing"])
    new = kinds.limit(3).withColumn("category_feature", F.lit("never seen"))
    assert t.predict(new).filter("probability_control BETWEEN 0 AND 1").count() == 3
    spec = learners.feature_spec(kinds, ["numeric_feature", "flag", "day"])
    assert spec == learners.FeatureSpec(("numeric_feature",), ("flag",), ("day",))
    with pytest.raises(UpliftError):
        learners.feature_spec(kinds.withColumn("list", F.array(F.lit(1))), ["list"])


def test_wrong_inputs(spark, customers):
    for bad in (
        lambda: uplift.require_modelable(customers, ["target"]),
        lambda: uplift.require_modelable(customers, ["numeric_feature"] * 2),
        lambda: uplift.require_modelable(customers.limit(0), ["numeric_feature"]),
        lambda: uplift.split(customers.filter("NOT (treatment = 1 AND target = 1)")),
        lambda: uplift.split(customers.withColumn(uplift.RESERVED, F.lit(1))),
        lambda: uplift.evaluate(customers.filter("treatment = 1").withColumn("predicted_uplift", F.lit(0.1))),
        lambda: uplift.evaluate(customers.withColumn("predicted_uplift", F.lit(float("nan")))),
        lambda: learners.SLearner().fit(customers.withColumn(learners.TREATMENT, F.lit(1)), ["numeric_feature"]),
        lambda: learners.TLearner().fit(customers.filter("NOT (treatment = 1 AND target = 1)"), ["numeric_feature"]),
        lambda: uplift.infer_features(customers.select("client_id", "treatment", "target")),
    ):
        with pytest.raises(UpliftError):
            bad()
