import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.errors import ConfigError, DataError, FormatError, MissingDataError, WarehouseError
from plumbline.operators import cleaning, guards, profiling, roles
from plumbline.plans import pipeline
from plumbline.sources import loader, settings, sinks

NAN = float("nan")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(1, 10.0, "a"), (1, 10.0, "a"), (2, NAN, None)], "id long, value double, segment string")


def test_loader_finds_and_reads(spark, tmp_path):
    for name in ("raw_CLIENTS.csv", "products.parquet", "all_purchases.csv", "uplift_train.csv"):
        path = tmp_path / name
        if name.endswith("parquet"):
            spark.createDataFrame([(1, "x")], "product_id long, category string").write.parquet(str(path))
        else:
            path.write_text("client_id,value,day\n1,2.5,2024-01-05\n2,3.5,2024-01-06\n")
    (tmp_path / "purchases_notes.txt").write_text("not a table")
    frames = loader.scan_all(spark, str(tmp_path))
    assert set(frames) == set(loader.ENTITIES)
    assert loader.schemas(frames)["clients"] == {"client_id": "int", "value": "double", "day": "date"}
    (tmp_path / "purchases_2.csv").write_text("a\n1\n")
    (tmp_path / "raw_CLIENTS.csv").unlink()
    with pytest.raises(DataError, match="ambiguous"):
        loader.discover(spark, str(tmp_path))
    (tmp_path / "purchases_2.csv").unlink()
    with pytest.raises(MissingDataError, match="clients"):
        loader.discover(spark, str(tmp_path))


def test_packed_csv_unknown_suffix_and_optional_read(spark, tmp_path):
    path = tmp_path / "clients.csv.gz"
    path.write_bytes(gzip.compress(b"client_id,value\n1,10\n2,20\n"))
    frame = loader.scan(spark, str(path))
    assert (frame.count(), len(frame.columns)) == (2, 2)
    with pytest.raises(FormatError):
        loader.scan(spark, str(tmp_path / "clients.xlsx"))
    assert loader.read_if_exists(spark, str(tmp_path / "none.parquet")) is None


def test_settings():
    s = settings.Settings.from_env({"PLUMBLINE_DATA_DIR": "/d", "PLUMBLINE_RANDOM_STATE": "7"})
    assert (str(s.clean_dir), s.random_state, s.log_level) == ("/d/interim", 7, "INFO")


def test_profile(sample):
    over = profiling.overview("x", sample).first()
    assert (over["row_count"], over["duplicate_rows"], over["total_nulls"], over["total_nans"]) == (3, 1, 1, 1)
    for exact in (True, False):
        columns = {r["column"]: r for r in profiling.column_profile("x", sample, exact).collect()}
        assert {c: r["unique_count"] for c, r in columns.items()} == {"id": 2, "value": 2, "segment": 2}
        assert (columns["value"]["nan_count"], columns["segment"]["null_count"], columns["id"]["cardinality_is_exact"]) == (1, 1, exact)
    numbers = {r["column"]: r for r in profiling.numeric_summary("x", sample).collect()}
    assert math.isclose(numbers["id"]["mean"], 4 / 3) and numbers["value"]["mean"] == 10
    top = profiling.frequent_values("x", sample, profiling.column_profile("x", sample)).collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 2), (None, 1)]


def test_profile_of_empty_and_textless_tables(spark, sample):
    over = profiling.overview("x", sample.limit(0)).first()
    assert (over["row_count"], over["duplicate_rate"]) == (0, 0.0)
    assert {r["null_rate"] for r in profiling.column_profile("x", sample.limit(0), True).collect()} == {0.0}
    assert profiling.numeric_summary("x", sample.select("segment")).count() == 0
    assert profiling.frequent_values("x", sample.select("id")).count() == 0


def test_nearest_quartiles(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 12)] + [(None,)], "v double")
    row = profiling.numeric_summary("x", df).first()
    assert (row["q25"], row["median"], row["q75"]) == (4.0, 6.0, 9.0)  # places round(2.5) = 3 and round(7.5) = 8 from 0


def test_cleaning(spark, tmp_path):
    dirty = spark.createDataFrame([(1, NAN, " x "), (1, NAN, " x "), (2, 5.0, "y")], "id long, value double, label string")
    rows = cleaning.clean(dirty).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, None, " x "), (2, 5.0, "y")]
    kept = cleaning.clean(dirty, cleaning.CleaningConfig(False, False))
    assert (kept.count(), kept.filter(F.isnan("value")).count()) == (3, 2)
    audit = cleaning.clean_entity("x", dirty, f"{tmp_path}/x.parquet")
    assert (audit["input_rows"], audit["output_rows"], audit["rows_removed"], audit["nans_replaced"]) == (3, 2, 1, 2)


def test_clean_stage_writes_everything(spark, tmp_path):
    raw, clean, reports = (tmp_path / x for x in ("raw", "clean", "reports"))
    raw.mkdir()
    for e in loader.ENTITIES:
        (raw / f"{e}.csv").write_text("entity_id,value,segment\n1,1.5,a\n1,1.5,a\n2,2.5,b\n")
    audit = pipeline.run_cleaning(spark, str(raw), str(clean), str(reports))
    assert [a["output_rows"] for a in audit] == [2] * 4
    for part in ("raw", "clean"):
        assert json.loads((reports / part / "schema_inventory.json").read_text()).keys() == set(loader.ENTITIES)
        for name in ("dataset_overview", "column_profile", "numeric_summary", "categorical_top_values"):
            assert spark.read.csv(f"{reports}/{part}/{name}.csv", header=True).count()
    assert len(json.loads((reports / "cleaning_audit.json").read_text())) == 4


def test_guards(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, NAN), (None, None, None)], "k long, t int, x double")
    for check in (
        lambda: guards.require_columns(df, ["k", "missing"], "t"),
        lambda: guards.require_unique(df, "k", "t"),
        lambda: guards.require_filled(df, ["k"], "t"),
        lambda: guards.require_numeric(df.withColumn("s", F.lit("a")), ["s"], "t"),
        lambda: guards.require_binary(df, ["t"]),
        lambda: guards.require_finite(df, ["x"]),
    ):
        with pytest.raises(DataError):
            check()
    assert guards.invalid_binary(df, ["t"]).count() == 2


def test_atomic_write_replaces_and_cleans_up(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    sinks.write_atomic(spark.range(3), path)
    sinks.write_atomic(spark.range(5), path, small=True)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]
    with pytest.raises(Exception, match="."):
        sinks.write_atomic(spark.range(2).select(F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_tables(spark, tmp_path):
    store = sinks.Tables(spark, str(tmp_path))
    make = lambda *rows: spark.createDataFrame(rows, "k long, scope long, x double")
    assert store.upsert("t", make((1, 1, 1.0), (2, 1, float("inf"))), ["k"]) == 2
    assert store.upsert("t", make((2, 2, 5.0), (3, 2, NAN)), ["k"]) == 2
    assert store.upsert("t", make().limit(0), ["k"]) == 0
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, 1, 1.0), (2, 2, 5.0), (3, 2, None)]
    assert store.replace("t", make((9, 2, 0.0)), "scope", 2) == 1
    assert sorted(r["k"] for r in store.read("t").collect()) == [1, 9]
    assert store.replace("t", make((5, 5, 5.0))) == 1 and store.read("t").count() == 1
    assert [store.key_of("d", "key", "name", n) for n in ("a", "b", "a")] == [1, 2, 1]
    with pytest.raises(WarehouseError):
        store.read("t; DROP TABLE x")
    store.views()
    assert [r[0] for r in sinks.run_script(spark, "SELECT 1; SELECT count(*) FROM t;")[1].collect()] == [1]


MAPPING = {"experiment_start": "2024-01-01T00:00:00+00:00", "clients": {"client_id": "c"}, "purchases": {"client_id": "c", "transaction_id": "t", "transaction_datetime": "d", "amount": "a"}}


@pytest.mark.parametrize(
    "change",
    [
        {"experiment_start": "yesterday"},
        {"lookback_days": 30},
        {"clients": {"client_id": "c", "age": "a", "birth_date": "b"}},
        {"clients": {"client_id": " "}},
        {"clients": None},
        {"products": {"product_id": "p", "category": "g"}},
    ],
)
def test_mapping_errors(change, tmp_path):
    with pytest.raises(ConfigError):
        roles.config_from(MAPPING | change)
    path = tmp_path / "m.json"
    path.write_text(json.dumps(MAPPING))
    config = roles.load_config(str(path))
    assert (config.lookback_days, config.strict_referential_integrity) == (365, True)
    with pytest.raises(ConfigError):
        roles.load_config(str(tmp_path / "none.json"))
