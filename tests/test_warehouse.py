import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plumbline.errors import WarehouseError
from plumbline.operators import warehouse
from plumbline.operators.roles import config_from
from plumbline.plans import catalog, oracles, pipeline
from plumbline.sources import retail, sinks

MAPPING = {
    "experiment_start": "2024-01-01T00:00:00",
    "clients": {"client_id": "c"},
    "purchases": {"client_id": "client", "transaction_id": "transaction", "transaction_datetime": "purchased_at", "amount": "amount_raw", "regular_amount": "regular_raw", "product_id": "sku"},
    "products": {"product_id": "sku", "category": "kind"},
}
CONFIG = config_from(MAPPING)


@pytest.fixture(scope="module")
def purchases(spark):
    rows = [(1, "t1", "2024-01-05 10:00:00", "10.5", 12.0, "p1"), (2, "t2", "2024-01-06 11:00:00", "20", 20.0, None)]
    return spark.createDataFrame(rows, "client long, transaction string, purchased_at string, amount_raw string, regular_raw double, sku string")


def test_purchases_and_dates(purchases):
    fact = warehouse.purchase_fact(purchases, CONFIG)
    assert [(r["date_key"], r["amount"], r["customer_id"]) for r in fact.orderBy("date_key").collect()] == [(20240105, 10.5, "1"), (20240106, 20.0, "2")]
    days = warehouse.date_dimension(fact, "purchase_datetime").orderBy("date_key").collect()
    assert [(r["date_key"], r["day_of_week"], r["is_weekend"], r["iso_week"], r["month_name"], r["day_name"]) for r in days] == [
        (20240105, 5, False, 1, "January", "Friday"),
        (20240106, 6, True, 1, "January", "Saturday"),
    ]
    assert [r["product_id"] for r in warehouse.derived_products(fact).collect()] == ["p1"]
    with pytest.raises(WarehouseError):
        warehouse.purchase_fact(purchases.withColumn("client", F.lit(None).cast("long")), CONFIG)
    with pytest.raises(WarehouseError):
        warehouse.product_dimension(purchases.select("sku", F.lit("k").alias("kind")), CONFIG)


def test_long_predictions(spark):
    wide = spark.createDataFrame([(1,), (2,)], "client_id long").select("client_id", *[F.lit(0.1).alias(f"{m}_{p}") for m in warehouse.MODELS for p in warehouse.PARTS])
    rows = warehouse.prediction_fact(wide, 3).collect()
    assert len(rows) == 4 and {r["model_name"] for r in rows} == set(warehouse.MODELS) and {r["experiment_key"] for r in rows} == {3}
    with pytest.raises(WarehouseError):
        warehouse.prediction_fact(wide.drop("s_learner_predicted_uplift"), 3)


def test_whole_run_from_raw_files(spark, tmp_path):
    """Every stage, files in between, at the smallest scale."""
    raw, clean, processed, folder = (str(tmp_path / x) for x in ("raw", "clean", "processed", "warehouse"))
    for name, df in retail.frames(spark, "/root/testdata/sf0.001").items():
        df.write.parquet(f"{raw}/{name}.parquet")
    done = pipeline.run_all(spark, raw, clean, processed, folder, retail.CONFIG, "orders")
    n = done.row_counts
    assert done.experiment_key == 1 and n["dim_customer"] == n["fact_experiment"] == 150 and n["uplift_predictions"] == 300
    assert n["fact_purchases"] == 6000 and n["dim_product"] == 200 and n["experiment_results"] == 1 and n["uplift_deciles"] == 20
    store = sinks.Tables(spark, folder)
    assert warehouse.verify_deployment(store)["business_scenarios"] == n["business_scenarios"]
    tables = {name: t for name in warehouse.CONSTRAINTS if (t := store.read(name)) is not None}
    assert warehouse.constraint_violations(tables).filter("violations > 0").count() == 0
    assert warehouse.quality_checks(tables).filter("violations > 0").count() == 0
    assert warehouse.create_views(store) == ["vw_experiment_overview", "vw_segment_performance", "vw_uplift_model_performance", "vw_business_strategy_comparison"]
    assert spark.sql("SELECT control_size FROM vw_experiment_overview").first()[0] + spark.sql("SELECT treatment_size FROM vw_experiment_overview").first()[0] == 150
    assert spark.sql("SELECT count(*) FROM vw_business_strategy_comparison WHERE experiment_name = 'orders'").first()[0] == n["business_scenarios"]
    again = pipeline.run_warehouse(spark, processed, folder, "orders", retail.CONFIG, clean)
    assert again.experiment_key == 1 and store.read("dim_customer").count() == 150
    with pytest.raises(WarehouseError, match="empty"):
        warehouse.verify_deployment(store, ["uplift_deciles", "nothing"])
    with pytest.raises(WarehouseError):
        warehouse.load_warehouse(spark, folder, spark.read.parquet(f"{processed}/customer_feature_mart.parquet"), processed, "orders", config=retail.CONFIG)


def test_checks_find_what_is_wrong(spark):
    found = {r["check_name"]: r["violations"] for r in catalog.quality_checks(spark, "/root/testdata/sf0.001").collect()}
    assert found["orphan_purchase_customer"] > 0 and found["uplift_probability_mismatch"] > 0 and found["invalid_experiment_binary"] == 0


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    df = catalog.QUERIES[name](spark, folder)
    out = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([plain(v) for v in r] for r in out.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 150
    assert set(oracles.ORACLES) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_validation_summary_has_the_interval_of_the_bootstrap(spark):
    folder = "/root/testdata/sf0.001"
    row = catalog.QUERIES["validation_summary_row"](spark, folder).first()
    own = catalog.QUERIES["bootstrap_summary"](spark, folder).first()
    assert row["bootstrap_iterations"] == own["iterations"] == 10_000
    assert (row["bootstrap_ci_lower"], row["bootstrap_ci_upper"]) == (own["ci_lower"], own["ci_upper"])
