import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.errors import ExperimentError, PowerError
from plumbline.functions import inference as stats
from plumbline.functions import inference_columns
from plumbline.operators import abtest, validation


def arms(spark, s0, n0, s1, n1):
    rows = [(t, int(k < s)) for t, s, n in ((0, s0, n0), (1, s1, n1)) for k in range(n)]
    return spark.createDataFrame(rows, "treatment int, target int")


def test_ab_counts():
    r = abtest.run_ab_test(100, 1000, 130, 1000)
    assert (r.control_cr, r.treatment_cr) == (0.1, 0.13)
    assert math.isclose(r.absolute_uplift, 0.03) and math.isclose(r.relative_uplift, 0.3)
    pooled = 0.115
    z = 0.03 / math.sqrt(pooled * (1 - pooled) * 2 / 1000)
    assert math.isclose(r.z_statistic, z, rel_tol=1e-12) and math.isclose(r.p_value, math.erfc(z / math.sqrt(2)), rel_tol=1e-12)
    swapped = abtest.run_ab_test(130, 1000, 100, 1000)
    assert math.isclose(swapped.absolute_uplift, -r.absolute_uplift) and math.isclose(swapped.p_value, r.p_value)
    larger, smaller = (abtest.run_ab_test(100, 1000, 130, 1000, alternative=a) for a in ("larger", "smaller"))
    assert math.isclose(larger.p_value + smaller.p_value, 1) and larger.ci_upper == 1 and smaller.ci_lower == -1


def test_published_figures():
    s0, s1 = round(0.6033 * 100058), round(0.6365 * 99981)
    r = abtest.run_ab_test(s0, 100058, s1, 99981)
    assert round(r.ci_lower, 3) == 0.029 and round(r.ci_upper, 3) == 0.037
    assert round(validation.check_srm(100058, 99981).p_value, 3) == 0.863


def test_without_conversions():
    r = abtest.run_ab_test(0, 100, 0, 100)
    assert (r.z_statistic, r.p_value, r.relative_uplift, r.statistically_significant) == (0, 1, None, False)
    assert len(r.warnings) >= 2 and r.required_total_size is None


def test_frames_and_their_errors(spark, tmp_path):
    r = abtest.analyse_experiment(arms(spark, 10, 100, 15, 100))
    assert math.isclose(r.absolute_uplift, 0.05)
    path = abtest.materialize_result(spark, r, f"{tmp_path}/r.parquet")
    row = spark.read.parquet(path).first()
    assert row["control_size"] == 100 and json.loads(row["warnings"]) == list(r.warnings)
    for rows in ([(0, 2), (1, 0)], [(None, 1), (1, 0)], [(1, 1), (1, 0)]):
        with pytest.raises(ExperimentError):
            abtest.analyse_experiment(spark.createDataFrame(rows, "treatment int, target int"))
    with pytest.raises(ExperimentError):
        stats.rate(True, 10)
    with pytest.raises(ExperimentError):
        stats.rate(11, 10)


def test_power():
    n = stats.required_sample_size(0.10, 0.13)
    assert stats.achieved_power(0.10, 0.13, n.control_size, n.treatment_size) >= 0.8 > stats.achieved_power(0.10, 0.13, n.control_size - 1, n.treatment_size - 1)
    assert stats.achieved_power(0.1, 0.1, 100, 100) == 0.05
    assert stats.achieved_power(0.1, 0.13, 2000, 2000) > stats.achieved_power(0.1, 0.13, 1000, 1000)
    assert stats.required_sample_size(0.1, 0.13, target_power=0.9).total_size > n.total_size
    uneven = stats.required_sample_size(0.1, 0.13, allocation_ratio=2)
    assert uneven.treatment_size == math.ceil(2 * uneven.control_size)
    mde = stats.minimum_detectable_effect(0.1, 1000, 1000)
    assert math.isclose(stats.achieved_power(0.1, 0.1 + mde, 1000, 1000), 0.8, abs_tol=1e-9)
    assert stats.minimum_detectable_effect(0.1, 4000, 4000) < mde
    for bad in (lambda: stats.required_sample_size(0.1, 0.1), lambda: stats.minimum_detectable_effect(1.0, 10, 10), lambda: stats.minimum_detectable_effect(0.99, 5, 5)):
        with pytest.raises(PowerError):
            bad()


def test_sample_ratio(spark):
    assert not validation.check_srm(480, 520).srm_detected and validation.check_srm(300, 700).srm_detected
    assert validation.check_srm(750, 250, 0.25).p_value == 1
    one_sided = spark.createDataFrame([(1,)] * 30, "treatment int")
    assert validation.check_srm_frame(one_sided).observed_control == 0
    for bad in ((-1, 5), (True, 5), (0, 0)):
        with pytest.raises(ExperimentError):
            validation.check_srm(*bad)


def test_kolmogorov_smirnov():
    d, p = stats.ks_uniform([0.1, 0.3, 0.5, 0.7, 0.9])
    assert math.isclose(d, 0.1) and p > 0.99
    assert math.isclose(stats.ks_tail(0.274, 10), 1 - 0.6284796154, abs_tol=1e-6)  # Marsaglia, Tsang and Wang's example
    rng = np.random.default_rng(1)
    share = np.mean([stats.ks_uniform(rng.random(200))[1] < 0.05 for _ in range(400)])
    assert 0.02 < share < 0.09


def test_aa(spark):
    summary, rows = validation.simulate_aa(100, 200, simulations=300)
    again, same = validation.simulate_aa(100, 200, simulations=300)
    assert summary == again and (rows == same).all() and summary.split_b_size == 100
    assert 0.02 <= validation.simulate_aa(400, 2000)[0].false_positive_rate <= 0.08
    assert set(validation.simulate_aa(0, 21, simulations=20)[1][:, 3]) == {1.0}
    assert validation.simulate_aa(3, 21, simulations=5)[0].split_a_size == 10
    table = validation.simulate_aa_frame(arms(spark, 10, 40, 20, 40), simulations=7)[1]
    assert table.count() == 7 and table.filter("successes_a + successes_b <> 10").count() == 0


def test_bootstrap():
    summary, draws = validation.bootstrap(20, 100, 30, 100, iterations=2000)
    assert summary == validation.bootstrap(20, 100, 30, 100, iterations=2000)[0] and len(draws) == 2000
    assert math.isclose(summary.observed_uplift, 0.1) and summary.ci_lower < 0.1 < summary.ci_upper
    fixed = validation.bootstrap(0, 10, 10, 10, iterations=50)[0]
    assert (fixed.ci_lower, fixed.ci_upper) == (1, 1)


def test_benjamini_hochberg(spark):
    adjusted, rejected = stats.benjamini_hochberg([0.001, 0.01, 0.03, 0.2])
    assert np.allclose(adjusted, [0.004, 0.02, 0.04, 0.2]) and rejected == [True, True, True, False]
    assert stats.benjamini_hochberg([]) == ([], [])
    with pytest.raises(ExperimentError):
        stats.benjamini_hochberg([1.2])
    p = np.random.default_rng(2).random(50).round(2)
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)], "k int, p double")
    got = {r["k"]: r["q"] for r in inference_columns.adjusted(df, "p", "q", ["k"]).collect()}
    assert np.allclose([got[k] for k in range(50)], stats.benjamini_hochberg(p)[0])


def test_segments(spark):
    rows = [(g, t, int(k < n)) for g, t, n in (("A", 0, 10), ("A", 1, 20), ("B", 0, 20), ("B", 1, 20)) for k in range(100)]
    df = spark.createDataFrame([*rows, (None, 1, 0)], "segment string, treatment int, target int")
    found = {r["segment"]: r for r in validation.analyse_segments(df, ["segment"], add_default_groups=False).collect()}
    assert found.keys() == {"A", "B"}  # the unknown one has a single arm
    assert math.isclose(found["A"]["absolute_uplift"], 0.1) and found["B"]["p_value"] == 1
    z, p, _ = stats.z_test(10, 100, 20, 100)
    assert math.isclose(found["A"]["p_value"], p, rel_tol=1e-9)
    interval = stats.difference_interval(10, 100, 20, 100)
    assert found["A"]["confidence_interval"] == f"[{interval.lower:.6f}, {interval.upper:.6f}]"


def test_segment_bounds(spark):
    df = spark.createDataFrame([(24.0, 1), (25.0, 2), (65.0, 4), (None, None)], "age double, recency_score int")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("gender", "rfm_segment", "spending_quantile", "purchase_frequency_quantile")})
    rows = validation.add_segments(df).collect()
    assert [(r["age_group"], r["recency_group"]) for r in rows] == [("under 25", "old"), ("25-34", "middle"), ("65+", "recent"), ("unknown", "unknown")]


def test_validation_writes_all(spark, tmp_path):
    rows = [(20.0 + k % 50, "F" if k % 2 else "M", "R1F1M1", k % 5 + 1, k % 5 + 1, k % 5 + 1, k % 2, k // 2 % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "age double, gender string, rfm_segment string, spending_quantile int, purchase_frequency_quantile int, recency_score int, treatment int, target int")
    paths = validation.validate_experiment(df, str(tmp_path), simulations=20, iterations=50)
    assert len(paths) == 6 and all(spark.read.parquet(p).count() for p in paths.values())
