"""The queries over the driver tables, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import inference as stats
from ..operators import abtest, cleaning, features, guards, learners, profiling, rfm, semantic, targeting, uplift, validation, warehouse
from ..operators.roles import config_from
from ..sources import loader, retail, sinks
from ..sources.staging import shared_folder, staged

CONFIG = retail.CONFIG
ECONOMICS = targeting.EconomicsConfig(semantic.COST, semantic.PROFIT)
THRESHOLD = semantic.THRESHOLD
KEY = 1
PLACES = 8


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles rounded, decimals as doubles, small whole numbers as int: what two engines agree on."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # adding zero turns -0.0 into 0.0
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType)):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.prepare_purchases(retail.purchases(spark, sf_dir), CONFIG)[1]


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_mart(retail.frames(spark, sf_dir), CONFIG)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targeting.model_scores(retail.surrogate_scores(spark, sf_dir), "s_learner")


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).join(retail.assignment(spark, sf_dir), "client_id")


def label_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("treatment"), F.col("toxic").alias("target"))


AB = (
    "control_size", "treatment_size", "control_conversions", "treatment_conversions", "control_cr", "treatment_cr", "absolute_uplift", "relative_uplift",
    "standard_error", "null_standard_error", "z_statistic", "p_value", "ci_lower", "ci_upper", "control_ci_lower", "control_ci_upper",
    "treatment_ci_lower", "treatment_ci_upper", "effect_size", "achieved_power", "statistically_significant",
)


def ab_overview(spark, sf_dir):
    return rounded(abtest.one_row(spark, abtest.analyse_experiment(retail.assignment(spark, sf_dir))).select(*AB))


def ab_labels(spark, sf_dir):
    return rounded(abtest.one_row(spark, abtest.analyse_experiment(label_arms(spark, sf_dir))).select(*AB))


def power_plan(spark, sf_dir):
    """Sample sizes and detectable effects, and the power that they have."""
    r = abtest.analyse_experiment(retail.assignment(spark, sf_dir))
    at_mde = stats.achieved_power(r.control_cr, r.control_cr + r.mde_absolute, r.control_size, r.treatment_size) if r.mde_absolute else None
    at_size = stats.achieved_power(r.control_cr, r.treatment_cr, r.required_control_size, r.required_treatment_size) if r.required_total_size else None
    row = abtest.one_row(spark, r).select("required_control_size", "required_treatment_size", "required_total_size", "mde_absolute", "target_power", "alternative", "warnings")
    row = rounded(row, 6)
    return row.select("*", F.round(F.lit(at_mde).cast("double"), 6).alias("power_at_mde"), F.round(F.lit(at_size).cast("double"), 6).alias("power_at_size"))


def srm_check(spark, sf_dir):
    return rounded(abtest.one_row(spark, validation.check_srm_frame(retail.assignment(spark, sf_dir))))


def aa_simulation(spark, sf_dir):
    return abtest.one_row(spark, validation.simulate_aa_frame(retail.assignment(spark, sf_dir))[0])


def bootstrap_summary(spark, sf_dir):
    return abtest.one_row(spark, validation.bootstrap_frame(retail.assignment(spark, sf_dir))[0])


def segment_uplift(spark, sf_dir):
    return rounded(validation.analyse_segments(staged(mart(spark, sf_dir), "mart"))).drop("confidence_interval")


PROFILED = ("customer", "part", "labels")


def _profiled(spark, sf_dir, make):
    parts = [make(name, table(spark, sf_dir, name)) for name in PROFILED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 6)


def profile_overview(spark, sf_dir):
    return _profiled(spark, sf_dir, profiling.overview)


def profile_columns(spark, sf_dir):
    return _profiled(spark, sf_dir, lambda n, df: profiling.column_profile(n, df, exact=True).drop("dtype"))


def profile_columns_approx(spark, sf_dir):
    return _profiled(spark, sf_dir, profiling.column_profile)


def profile_numeric(spark, sf_dir):
    return _profiled(spark, sf_dir, profiling.numeric_summary)


def profile_top_values(spark, sf_dir):
    return _profiled(spark, sf_dir, profiling.frequent_values)


def clean_rows(spark, sf_dir):
    """Order lines without their keys, one tax rate being NaN."""
    lines = table(spark, sf_dir, "lineitem")
    tax = F.when(F.col("l_tax") == 0.05, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return cleaning.clean(lines.select("l_returnflag", "l_linestatus", "l_discount", tax.alias("l_tax")))


def clean_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    tax = F.when(F.col("l_tax") == 0.05, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    dirty = lines.select("l_returnflag", "l_linestatus", "l_discount", tax.alias("l_tax"))
    before, after = cleaning.sizes(dirty), cleaning.sizes(cleaning.clean(dirty))
    return before.select(F.col("rows").alias("input_rows"), F.col("nans").alias("input_nans")).crossJoin(after.select(F.col("rows").alias("output_rows"), F.col("nans").alias("output_nans")))


def receipt_spend(spark, sf_dir):
    return rounded(features.receipts(eligible(spark, sf_dir)), 4)


def client_transaction_features(spark, sf_dir):
    return rounded(features.transaction_features(eligible(spark, sf_dir), CONFIG), 6)


def client_product_features(spark, sf_dir):
    return features.product_features(eligible(spark, sf_dir), retail.products(spark, sf_dir), CONFIG)


def client_discount_features(spark, sf_dir):
    return rounded(features.discount_features(eligible(spark, sf_dir), CONFIG))


def _links(spark, sf_dir, known, key):
    """All purchases against the odd part of a dimension, so that there are orphans."""
    every = features.prepare_purchases(retail.purchases(spark, sf_dir), CONFIG)[0]
    return features.orphans(every, known.filter(F.col(key) % 2 == 1), key)


def orphan_clients(spark, sf_dir):
    return _links(spark, sf_dir, retail.clients(spark, sf_dir), "client_id")


def orphan_products(spark, sf_dir):
    return _links(spark, sf_dir, retail.products(spark, sf_dir), "product_id")


def rfm_scores(spark, sf_dir):
    base = retail.clients(spark, sf_dir).select("client_id").join(features.transaction_features(eligible(spark, sf_dir), CONFIG), "client_id", "left")
    base = base.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("transactions_count", "total_spend")})
    return rounded(rfm.add_scores(base).select("client_id", *rfm.SCORES, "rfm_segment"))


def rfm_segment_counts(spark, sf_dir):
    return rfm_scores(spark, sf_dir).groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"))


def feature_mart(spark, sf_dir):
    return rounded(mart(spark, sf_dir), 6)


def stratified_split(spark, sf_dir):
    return uplift.split(retail.assignment(spark, sf_dir))


def uplift_curve(spark, sf_dir):
    return rounded(uplift.evaluate(labelled_scores(spark, sf_dir)).curve)


def uplift_deciles(spark, sf_dir):
    return rounded(uplift.evaluate(labelled_scores(spark, sf_dir)).deciles)


def uplift_summary(spark, sf_dir):
    return rounded(uplift.evaluate(labelled_scores(spark, sf_dir)).summary, 6)


def _modeling(spark, sf_dir):
    rows = staged(mart(spark, sf_dir), "mart")
    wanted = ["age", "gender", "total_spend", "transactions_count", "days_since_last_purchase", "favorite_category", "avg_discount", "rfm_segment"]
    return learners.train_and_evaluate(rows, wanted)


def learner_scores(spark, sf_dir):
    return _modeling(spark, sf_dir).customer_scores


def model_comparison(spark, sf_dir):
    return _modeling(spark, sf_dir).comparison


def customer_types(spark, sf_dir):
    return rounded(targeting.assign_types(scores(spark, sf_dir)))


def customer_type_shares(spark, sf_dir):
    typed = targeting.apply_rule(targeting.assign_types(scores(spark, sf_dir)), THRESHOLD)
    shares = typed.groupBy("modeled_customer_type").agg(F.count(F.lit(1)).alias("customers"), F.avg(F.col("is_targeted").cast("double")).alias("target_share"))
    return rounded(shares.orderBy(F.col("customers").desc()))


def targeted_customers(spark, sf_dir):
    return rounded(targeting.apply_rule(scores(spark, sf_dir), THRESHOLD).select("client_id", "predicted_uplift", "is_targeted", "targeting_threshold"))


def strategy_comparison(spark, sf_dir):
    return rounded(targeting.compare_strategies(scores(spark, sf_dir), ECONOMICS, THRESHOLD), 6)


def threshold_grid(spark, sf_dir):
    return rounded(targeting.evaluate_thresholds(scores(spark, sf_dir), ECONOMICS, [k / 100 for k in range(-10, 11, 2)]), 6)


def threshold_search(spark, sf_dir):
    found = targeting.optimize_threshold(scores(spark, sf_dir), ECONOMICS)
    # the thresholds lie one step of a double below the scores
    return rounded(found.withColumn("below_score", F.col("targeting_threshold") < F.round("targeting_threshold", 6)), 6)


def threshold_optimum(spark, sf_dir):
    return rounded(targeting.optimize_threshold(scores(spark, sf_dir), ECONOMICS).limit(1), 6)


def model_selection(spark, sf_dir):
    both = retail.surrogate_scores(spark, sf_dir).join(retail.assignment(spark, sf_dir), "client_id")
    rows = [uplift.evaluate(both, score=f"{m}_predicted_uplift").summary.select(F.lit(m).alias("model"), "qini_coefficient") for m in targeting.MODELS]
    compared = staged(rows[0].unionByName(rows[1]), "models")
    return rounded(compared.withColumn("selected", F.col("model") == targeting.select_model(compared)), 6)


def dim_customer(spark, sf_dir):
    return rounded(warehouse.customer_dimension(mart(spark, sf_dir)), 6)


def dim_product(spark, sf_dir):
    return warehouse.product_dimension(retail.products(spark, sf_dir), CONFIG)


def dim_product_derived(spark, sf_dir):
    return warehouse.derived_products(fact_purchases(spark, sf_dir))


def fact_purchases(spark, sf_dir):
    return rounded(warehouse.purchase_fact(retail.purchases(spark, sf_dir), CONFIG), 4)


def dim_date(spark, sf_dir):
    return rounded(warehouse.date_dimension(warehouse.purchase_fact(retail.purchases(spark, sf_dir), CONFIG), "purchase_datetime"))


def fact_experiment(spark, sf_dir):
    return rounded(warehouse.experiment_fact(retail.assignment(spark, sf_dir), KEY))


def uplift_predictions_long(spark, sf_dir):
    return rounded(warehouse.prediction_fact(retail.surrogate_scores(spark, sf_dir), KEY))


def _checks(spark, sf_dir):
    rows = retail.assignment(spark, sf_dir)
    return {
        "srm": abtest.one_row(spark, validation.check_srm_frame(rows)),
        "aa_summary": abtest.one_row(spark, validation.simulate_aa_frame(rows)[0]),
        "bootstrap_summary": abtest.one_row(spark, validation.bootstrap_frame(rows)[0]),
    }


def validation_summary_row(spark, sf_dir):
    return warehouse.validation_summary(_checks(spark, sf_dir), KEY)


def business_scenarios(spark, sf_dir):
    compared = targeting.compare_strategies(scores(spark, sf_dir), ECONOMICS, THRESHOLD).withColumn("selected_model", F.lit("s_learner"))
    searched = targeting.optimize_threshold(scores(spark, sf_dir), ECONOMICS).withColumn("selected_model", F.lit("s_learner"))
    rows = warehouse.scenario_rows(compared, KEY, "base").unionByName(warehouse.threshold_rows(searched, KEY))
    return rounded(rows.drop("targeting_threshold"), 6)


def _dim_experiment(spark):
    return spark.range(1).select(F.lit(KEY).cast("long").alias("experiment_key"), F.lit("orders").alias("experiment_name"), F.lit(retail.START).cast("timestamp").alias("experiment_start"), F.lit(0.5).alias("expected_treatment_share"))


def _results(spark, sf_dir):
    result = abtest.analyse_experiment(retail.assignment(spark, sf_dir))
    return abtest.one_row(spark, result).withColumn("experiment_key", F.lit(KEY).cast("long"))


def view_experiment_overview(spark, sf_dir):
    """The overview view; what simulations give is left out, so that the rest can be compared."""
    checks = warehouse.validation_summary(_checks(spark, sf_dir), KEY)
    view = warehouse.experiment_overview(_dim_experiment(spark), _results(spark, sf_dir), checks)
    return rounded(view.drop("experiment_start", "mde_absolute", "aa_false_positive_rate", "bootstrap_ci_lower", "bootstrap_ci_upper"))


def view_segment_performance(spark, sf_dir):
    rows = segment_uplift(spark, sf_dir).withColumn("experiment_key", F.lit(KEY).cast("long"))
    return warehouse.named_performance(warehouse.loadable(rows, warehouse.COLUMNS["segment_experiment_results"]), _dim_experiment(spark))


def _star(spark, sf_dir):
    """The tables with some parts taken out, so that checks have something to find."""
    fact = warehouse.purchase_fact(retail.purchases(spark, sf_dir), CONFIG)
    customers = warehouse.loadable(retail.clients(spark, sf_dir).withColumn("customer_id", F.col("client_id").cast("string")), warehouse.COLUMNS["dim_customer"])
    return {
        "dim_experiment": _dim_experiment(spark),
        "dim_customer": customers.filter(F.col("customer_id").cast("long") % 10 != 3),
        "dim_product": dim_product(spark, sf_dir).filter(F.col("product_id").cast("long") % 10 != 4),
        "dim_date": warehouse.date_dimension(fact, "purchase_datetime").filter("day_of_month <> 13"),
        "fact_purchases": fact,
        "fact_experiment": warehouse.experiment_fact(retail.assignment(spark, sf_dir), KEY),
        "uplift_predictions": warehouse.prediction_fact(retail.surrogate_scores(spark, sf_dir), KEY).withColumn("probability_treatment", F.when(F.col("customer_id").cast("long") % 100 == 7, 1.5).otherwise(F.col("probability_treatment"))),
        "business_scenarios": business_scenarios(spark, sf_dir).withColumn("scenario_analysis", F.when(F.col("customers_targeted") % 3 > 0, F.col("customers_targeted") % 3 == 1)),
    }


def quality_checks(spark, sf_dir):
    return warehouse.quality_checks(_star(spark, sf_dir))


def constraint_violations(spark, sf_dir):
    star = _star(spark, sf_dir)
    return warehouse.constraint_violations({k: star[k] for k in ("dim_experiment", "dim_customer", "dim_product", "dim_date", "fact_purchases", "fact_experiment", "uplift_predictions")})


def bi_experiment_kpis(spark, sf_dir):
    return rounded(semantic.experiment_measures(warehouse.experiment_fact(retail.assignment(spark, sf_dir), KEY), ["experiment_key"]))


def bi_conversion_by_arm(spark, sf_dir):
    fact = warehouse.experiment_fact(retail.assignment(spark, sf_dir), KEY)
    return rounded(semantic.experiment_measures(fact, ["treatment"]).select("treatment", "users", "conversions", "conversion_rate"))


def bi_result_kpis(spark, sf_dir):
    """Passed-on results, significance and status; with two experiments selected the numbers are blank."""
    results = _results(spark, sf_dir)
    checks = abtest.one_row(spark, validation.check_srm_frame(retail.assignment(spark, sf_dir)))
    row = semantic.result_measures(results, ["experiment_key"]).drop("mde").join(results.select("experiment_key", "absolute_uplift", "statistically_significant"), "experiment_key")
    row = row.crossJoin(checks.select(F.col("p_value").alias("srm_p_value"), "srm_detected"))
    row = row.withColumns({"significance": semantic.significance(F.col("p_value"), F.col("statistically_significant")), "status": semantic.status(F.col("p_value"), F.col("srm_detected"), F.col("statistically_significant"), F.col("absolute_uplift"))})
    two = results.unionByName(results.withColumns({"experiment_key": F.lit(2).cast("long"), "p_value": F.col("p_value") / 2}))
    blank = semantic.result_measures(two).select(F.col("p_value").isNull().alias("blank_if_many"))
    return rounded(row.crossJoin(blank))


def bi_segment_kpis(spark, sf_dir):
    return semantic.segment_measures(segment_uplift(spark, sf_dir)).filter(F.col("dimension") == "gender")


def bi_model_scores(spark, sf_dir):
    return rounded(semantic.score_measures(warehouse.prediction_fact(retail.surrogate_scores(spark, sf_dir), KEY)))


def bi_target_kpis(spark, sf_dir):
    return rounded(semantic.target_measures(warehouse.prediction_fact(retail.surrogate_scores(spark, sf_dir), KEY)), 6)


def bi_decile_kpis(spark, sf_dir):
    rows = uplift.evaluate(labelled_scores(spark, sf_dir)).deciles.withColumn("model_name", F.lit("s_learner"))
    return rounded(semantic.decile_measures(rows))


def bi_qini_baseline(spark, sf_dir):
    rows = staged(uplift.evaluate(labelled_scores(spark, sf_dir)).deciles.withColumn("model_name", F.lit("s_learner")), "deciles")
    return rounded(semantic.qini_baseline(rows))


def bi_scenarios(spark, sf_dir):
    return semantic.scenario_measures(business_scenarios(spark, sf_dir).filter("scenario_name LIKE 'base:%'"))


def bi_models(spark, sf_dir):
    long = warehouse.prediction_fact(retail.surrogate_scores(spark, sf_dir), KEY)
    return semantic.model_dimension([long, business_scenarios(spark, sf_dir)])


def bi_grids(spark, sf_dir):
    parts = [semantic.grid(spark, g).select(F.lit(g).alias("parameter"), F.col(g).alias("value")) for g in semantic.GRIDS]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def bi_what_if(spark, sf_dir):
    own = warehouse.prediction_fact(retail.surrogate_scores(spark, sf_dir), KEY).filter("model_name = 't_learner'")
    grid = semantic.grid(spark, "targeting_threshold").withColumn("targeting_threshold", F.col("targeting_threshold") + 0.001)
    return rounded(semantic.what_if(own, grid), 6)


def bi_calendar(spark, sf_dir):
    return semantic.calendar(table(spark, sf_dir, "orders"), "o_orderdate")


def csv_scan(spark, sf_dir):
    """Customers after a round trip through CSV and packed CSV, types inferred."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer")
    out = []
    for packed, suffix in ((False, "csv"), (True, "csv.gz")):
        path = f"{folder}/customer.{suffix}"
        rows.write.csv(path, header=True, compression="gzip" if packed else "none")
        found = loader.scan(spark, path).withColumn("packed", F.lit(packed))
        out.append(found.withColumns({f.name: F.col(f.name).cast("long") for f in found.schema if f.dataType == T.IntegerType()}))
    return rounded(out[0].unionByName(out[1]), 6)


def table_upserts(spark, sf_dir):
    """Balances by customer: loaded, a third overridden (some by what is no number), a nation's replaced, in one transaction."""
    store = sinks.Tables(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("balance"))
    key = F.col("customer_id")
    spoiled = F.when(key % 2 == 0, F.lit(float("nan"))).when(key % 9 == 0, F.lit(float("-inf"))).otherwise(-F.col("balance"))
    with store.transaction():
        number = store.key_of("loads", "load_key", "load_name", "balances")
        store.upsert("balances", rows, ["customer_id"])
        store.upsert("balances", rows.filter(key % 3 == 0).withColumn("balance", spoiled), ["customer_id"])
        store.replace("balances", rows.filter("nation = 3").withColumn("balance", F.lit(0.0)), "nation", 3)
    return rounded(store.read("balances").withColumn("load_key", F.lit(number).cast("long")), 4)


def guard_counts(spark, sf_dir):
    """What the guards find in a spoiled customer table."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(key % 7 > 0, F.floor(key / 2)).alias("client_id"),
        F.when(key % 11 > 0, key % 4).alias("treatment"),
        F.when(key % 5 == 0, F.lit(float("nan"))).when(key % 5 == 1, F.lit(float("inf"))).when(key % 5 > 2, F.col("c_acctbal")).alias("score"),
        "c_mktsegment",
    )
    return guards.offences(rows, ["client_id"], ["client_id", "treatment"], ["treatment"], ["score"], {"c_mktsegment": ("BUILDING", "MACHINERY")})


def client_ages(spark, sf_dir):
    """Ages from birth dates as texts and as dates, and given ages of which only those from 0 to 120 count."""
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1925-03-01").cast("date"), (key * 37 % 27000).cast("int"))
    rows = table(spark, sf_dir, "customer").select(key.alias("c"), born.alias("d"), F.date_format(born, "dd.MM.yyyy").alias("s"), (key % 200 - 40).alias("a"))
    roles = {"by_text": {"birth_date": "s", "birth_date_format": "dd.MM.yyyy"}, "by_date": {"birth_date": "d"}, "by_age": {"age": "a"}}
    out = rows.select(F.col("c").alias("client_id"))
    for name, own in roles.items():
        config = config_from({"experiment_start": "2000-01-01T00:00:00", "clients": {"client_id": "c", **own}, "purchases": {"client_id": "c", "transaction_id": "t", "transaction_datetime": "d", "amount": "a"}})
        out = out.join(features.prepare_clients(rows, config).select("client_id", F.col("age").cast("int").alias(name)), "client_id")
    return out


def purchase_moments(spark, sf_dir):
    """Seconds since 1970 of the orders' times, from texts with a zone and from texts in a format of their own without one."""
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    texts = orders.select("o_orderkey", F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+03:00")).alias("zoned"), F.date_format(at, "dd.MM.yyyy HH:mm").alias("plain"))
    roles = lambda start, column, **more: config_from({"experiment_start": start, "clients": {"client_id": "c"}, "purchases": {"client_id": "c", "transaction_id": "t", "transaction_datetime": column, "amount": "a", **more}})
    zoned = features.moment(texts, roles("2000-01-01T00:00:00+00:00", "zoned"))
    plain = features.moment(texts, roles("2000-01-01T00:00:00", "plain", transaction_datetime_format="dd.MM.yyyy HH:mm"))
    return texts.select("o_orderkey", F.unix_seconds(zoned).alias("zoned"), F.unix_seconds(plain.cast("timestamp")).alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (
        ab_overview, ab_labels, power_plan, srm_check, aa_simulation, bootstrap_summary, segment_uplift,
        profile_overview, profile_columns, profile_columns_approx, profile_numeric, profile_top_values, clean_rows, clean_audit,
        receipt_spend, client_transaction_features, client_product_features, client_discount_features, orphan_clients, orphan_products,
        rfm_scores, rfm_segment_counts, feature_mart,
        stratified_split, uplift_curve, uplift_deciles, uplift_summary, learner_scores, model_comparison,
        customer_types, customer_type_shares, targeted_customers, strategy_comparison, threshold_grid, threshold_search, threshold_optimum, model_selection,
        dim_customer, dim_product, dim_product_derived, dim_date, fact_purchases, fact_experiment, uplift_predictions_long, validation_summary_row, business_scenarios,
        view_experiment_overview, view_segment_performance, quality_checks, constraint_violations,
        bi_experiment_kpis, bi_conversion_by_arm, bi_result_kpis, bi_segment_kpis, bi_model_scores, bi_target_kpis, bi_decile_kpis, bi_qini_baseline,
        bi_scenarios, bi_models, bi_grids, bi_what_if, bi_calendar,
        csv_scan, table_upserts, guard_counts, client_ages, purchase_moments,
    )
}
