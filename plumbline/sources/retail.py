"""The order tables as the four entities of an experiment.

Clients are customers, purchases are order lines, products are parts; arms are
assigned by the customer number, the outcome is an order in the half year after
the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.roles import MartConfig, config_from

START, END = "2000-01-01 00:00:00", "2000-07-01 00:00:00"
CONFIG: MartConfig = config_from({
    "experiment_start": "2000-01-01T00:00:00",
    "lookback_days": 365,
    "clients": {"client_id": "client_id", "age": "age", "gender": "gender"},
    "purchases": {"client_id": "client_id", "transaction_id": "transaction_id", "transaction_datetime": "purchased_at", "amount": "amount", "regular_amount": "regular_amount", "product_id": "product_id"},
    "products": {"product_id": "product_id", "category": "category"},
    "experiment": {"client_id": "client_id", "treatment": "treatment", "target": "target"},
})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("client_id"), (F.lit(18) + F.col("c_custkey") * 7 % 60).cast("double").alias("age"), F.col("c_mktsegment").alias("gender"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts are decimals, so their sums don't depend on order."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    paid = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(20,4)")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").alias("purchased_at"),
        paid.alias("amount"), F.col("l_extendedprice").cast("decimal(20,4)").alias("regular_amount"), F.col("l_partkey").alias("product_id"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    buyers = o.filter((at >= F.lit(START).cast("timestamp_ntz")) & (at < F.lit(END).cast("timestamp_ntz"))).select(F.col("o_custkey").alias("client_id")).distinct().withColumn("target", F.lit(1))
    arms = c.select(F.col("c_custkey").alias("client_id"), (F.col("c_custkey") % 2).cast("int").alias("treatment"))
    return arms.join(buyers, "client_id", "left").select("client_id", "treatment", F.coalesce("target", F.lit(0)).alias("target"))


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"clients": clients(spark, sf_dir), "purchases": purchases(spark, sf_dir), "products": products(spark, sf_dir), "uplift_train": assignment(spark, sf_dir)}


def surrogate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two models that are arithmetic of the customer number, for queries whose answer must be known."""
    c = F.col("client_id")
    out = clients(spark, sf_dir).select("client_id")
    for model, a, b in (("s_learner", 37, 53), ("t_learner", 59, 43)):
        p0, u = (c * a % 101) / F.lit(200.0) + F.lit(0.1), (c * b % 41 - 20) / F.lit(200.0)
        out = out.withColumns({f"{model}_probability_control": p0, f"{model}_probability_treatment": p0 + u, f"{model}_predicted_uplift": u})
    return out
