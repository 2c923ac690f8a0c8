import json
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.errors import ConfigError, DataError
from plumbline.functions.ordered import average_ranks, running
from plumbline.operators import features, rfm
from plumbline.operators.roles import config_from

MAPPING = {
    "experiment_start": "2024-01-01T00:00:00+00:00",
    "lookback_days": 365,
    "clients": {"client_id": "customer_key", "age": "age_years", "gender": "sex"},
    "purchases": {"client_id": "customer_key", "transaction_id": "receipt_key", "transaction_datetime": "purchased_at", "amount": "paid_amount", "regular_amount": "regular_amount", "product_id": "sku_key"},
    "products": {"product_id": "sku_key", "category": "category_name"},
    "experiment": {"client_id": "customer_key", "treatment": "is_treatment", "target": "converted"},
}
CONFIG = config_from(MAPPING)


def at(*ymd):
    return datetime(*ymd, tzinfo=UTC)


@pytest.fixture(scope="module")
def frames(spark):
    return {
        "clients": spark.createDataFrame([(1, 30, "F"), (2, 40, "M")], "customer_key long, age_years long, sex string"),
        "purchases": spark.createDataFrame(
            [
                (1, "t1", at(2023, 12, 20), 10.0, 20.0, "p1"),
                (1, "t1", at(2023, 12, 20), 20.0, 20.0, "p2"),
                (1, "t2", at(2023, 11, 15), 30.0, 40.0, "p1"),
                (1, "post", at(2024, 1, 2), 100.0, 100.0, "p2"),
                (2, "old", at(2022, 12, 1), 50.0, 50.0, "p1"),
            ],
            "customer_key long, receipt_key string, purchased_at timestamp, paid_amount double, regular_amount double, sku_key string",
        ),
        "products": spark.createDataFrame([("p1", "A"), ("p2", "B")], "sku_key string, category_name string"),
        "uplift_train": spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "customer_key long, is_treatment long, converted long"),
    }


def test_every_feature(frames):
    rows = {r["client_id"]: r.asDict() for r in features.build_mart(frames, CONFIG).collect()}
    one, two = rows[1], rows[2]
    assert {k: one[k] for k in ("total_spend", "transactions_count", "avg_check", "median_check", "max_check", "days_since_last_purchase", "unique_products", "unique_categories", "favorite_category")} == {
        "total_spend": 60, "transactions_count": 2, "avg_check": 30, "median_check": 30, "max_check": 30, "days_since_last_purchase": 12, "unique_products": 2, "unique_categories": 2, "favorite_category": "A",
    }
    assert [one[f"purchases_{d}d"] for d in (30, 60, 90)] == [1, 2, 2]
    assert one["avg_discount"] == 0.25 and abs(one["discounted_purchase_share"] - 2 / 3) < 1e-12
    assert (two["total_spend"], two["transactions_count"], two["days_since_last_purchase"], two["rfm_segment"], two["avg_check"]) == (0, 0, None, None, None)
    assert (one["treatment"], two["target"]) == (1, 0)
    assert one["spending_quantile"] == one["monetary_score"]
    assert features.build_mart(frames, CONFIG).columns[-2:] == ["treatment", "target"]


def test_materialised_with_metadata(spark, frames, tmp_path):
    meta = features.materialize_mart(frames, CONFIG, f"{tmp_path}/mart.parquet")
    assert (meta["purchases_eligible"], meta["purchases_excluded"], meta["rows"]) == (3, 2, 2)
    assert json.loads((tmp_path / "mart.parquet.metadata.json").read_text())["lookback_days"] == 365


def test_impossible_ages(spark):
    df = spark.createDataFrame([(1, -945, "F"), (2, 121, "F"), (3, 120, "M")], "customer_key long, age_years long, sex string")
    assert [r["age"] for r in features.prepare_clients(df, CONFIG).orderBy("client_id").collect()] == [None, None, 120]


def test_age_from_birth_date(spark):
    config = config_from(MAPPING | {"clients": {"client_id": "customer_key", "birth_date": "born"}})
    df = spark.createDataFrame([(1, date(1989, 12, 31)), (2, date(1990, 1, 1))], "customer_key long, born date")
    assert [r["age"] for r in features.prepare_clients(df, config).orderBy("client_id").collect()] == [34, 33]
    assert features.prepare_clients(df.withColumn("born", F.col("born").cast("string")), config).count() == 2
    with pytest.raises(DataError):
        features.prepare_clients(df.withColumn("born", F.lit(1)), config)


def test_links_keys_and_zones_are_checked(spark, frames):
    stranger = spark.createDataFrame([(9, "t9", at(2023, 12, 1), 1.0, 1.0, "p1")], frames["purchases"].schema)
    with pytest.raises(DataError, match="client_id"):
        features.build_mart(frames | {"purchases": frames["purchases"].union(stranger)}, CONFIG)
    unknown = spark.createDataFrame([(1, "t9", at(2023, 12, 1), 1.0, 1.0, "p9")], frames["purchases"].schema)
    with pytest.raises(DataError, match="product_id"):
        features.build_mart(frames | {"purchases": frames["purchases"].union(unknown)}, CONFIG)
    loose = config_from(MAPPING | {"strict_referential_integrity": False})
    assert features.build_mart(frames | {"purchases": frames["purchases"].union(unknown)}, loose).count() == 2
    with pytest.raises(DataError, match="unique"):
        features.build_mart(frames | {"clients": frames["clients"].union(frames["clients"])}, CONFIG)
    naive = config_from(MAPPING | {"experiment_start": "2024-01-01T00:00:00"})
    with pytest.raises(ConfigError, match="zone"):
        features.build_mart(frames, naive)


def test_whole_days_are_elapsed_ones(spark):
    df = spark.sql("SELECT timestamp_ntz'2023-12-31 23:00:00' AS a, timestamp_ntz'2024-01-01 01:00:00' AS b")
    assert df.select(features.whole_days(F.col("a"), F.col("b"))).first()[0] == 0


def test_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 10, 100.0), (2, 10.0, 1, 10.0), (3, None, 0, 0.0)], "client_id long, days_since_last_purchase double, transactions_count long, total_spend double")
    rows = rfm.add_scores(df).orderBy("client_id").collect()
    assert rows[0]["rfm_segment"] == "R5F5M5"
    assert [rows[1][c] for c in rfm.SCORES] == [1, 3, 3]
    assert (rows[2]["recency_score"], rows[2]["rfm_segment"]) == (None, None)


def test_average_ranks_and_running_sums(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 5, 3, 5, None, 1)], "v long")
    both = df.withColumn("w", -F.col("v"))
    ranks = {(r["metric"], r["value"]): (r["rank"], r["values"]) for r in average_ranks(both, ["v", "w"]).collect()}
    assert ranks == {("v", 1): (1.5, 6), ("v", 3): (3, 6), ("v", 5): (5, 6), ("w", -5): (2, 6), ("w", -3): (4, 6), ("w", -1): (5.5, 6)}
    rows = running(spark.range(1000), [F.col("id").desc()], {"s": F.col("id")}, position="p").orderBy("p").collect()
    assert [r["p"] for r in rows] == list(range(1, 1001)) and rows[2]["s"] == 999 + 998 + 997
    assert running(spark.range(0), [F.col("id")], position="p").count() == 0
