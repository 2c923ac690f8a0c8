import gzip

import pytest
from pyspark.sql import functions as F

from plumbline.errors import ConfigError, DataError, WarehouseError
from plumbline.sources import database, download, loader, sinks, staging

URL = "jdbc:derby:memory:plumbline;create=true"


@pytest.fixture
def store(spark, tmp_path):
    return sinks.Tables(spark, str(tmp_path / "store"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, scope long, x double")


def found(store, table="t"):
    return sorted(tuple(r) for r in store.read(table).collect())


def test_a_transaction_publishes_all_tables_or_none(spark, store, tmp_path):
    store.upsert("t", rows(spark, (1, 1, 1.0)), ["k"])
    with store.transaction():
        store.upsert("t", rows(spark, (1, 1, 2.0), (2, 1, 2.0)), ["k"])
        store.replace("u", rows(spark, (7, 7, 7.0)))
        other = sinks.Tables(spark, store.folder)
        assert found(other) == [(1, 1, 1.0)] and other.read("u") is None
        assert len(found(store)) == 2  # the writer sees its own
    assert len(found(other)) == 2 and found(other, "u") == [(7, 7, 7.0)]
    before = sorted(str(p) for p in tmp_path.rglob("*.parquet"))
    with pytest.raises(Exception, match="no"), store.transaction():
        store.replace("u", rows(spark, (8, 8, 8.0)))
        store.upsert("t", rows(spark, (1, 1, 1.0)).withColumn("x", F.raise_error(F.lit("no")).cast("double")), ["k"])
    assert len(found(other)) == 2 and found(other, "u") == [(7, 7, 7.0)]
    assert sorted(str(p) for p in tmp_path.rglob("*.parquet")) == before


def test_of_two_writers_the_second_fails(spark, store):
    store.replace("t", rows(spark, (1, 1, 1.0)))
    other = sinks.Tables(spark, store.folder)
    with pytest.raises(WarehouseError, match="claim"), store.transaction():
        store.replace("t", rows(spark, (2, 2, 2.0)))
        other.replace("t", rows(spark, (3, 3, 3.0)))
    assert found(store) == [(3, 3, 3.0)]


def test_a_scope_is_replaced_without_the_others(spark, store, tmp_path):
    store.replace("t", rows(spark, (1, 1, 1.0)), "scope", 1)
    first = {str(p) for p in tmp_path.rglob("*.parquet")}
    store.replace("t", rows(spark, (2, 2, 2.0)), "scope", 2)
    store.replace("t", rows(spark, (2, 2, 3.0), (3, 2, 3.0)), "scope", 2)
    parts = store._state()["t"]
    assert found(store) == [(1, 1, 1.0), (2, 2, 3.0), (3, 2, 3.0)] and [p["scope"] for p in parts] == [["scope", "1"], ["scope", "2"]]
    assert first <= {str(p) for p in tmp_path.rglob("*.parquet")}
    with pytest.raises(WarehouseError):
        store.replace("t", rows(spark, (2, 2, 3.0)), "scope", 1)
    assert store.vacuum() == 1 and len(found(store)) == 3


def test_many_upserts_keep_few_parts(spark, store, monkeypatch):
    monkeypatch.setattr(sinks.Tables, "MOST_PARTS", 3)
    for k in range(7):
        store.upsert("t", rows(spark, (k, k, 1.0)), ["k"])
    assert len(found(store)) == 7 and len(store._state()["t"]) <= 5


def test_csv_types_from_the_first_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(loader, "INFERRED", 3)
    text = "id,at,name,x\n" + "".join(f'{k},2024-01-0{k + 1},"a, b",{k}.5\n' for k in range(5))
    (tmp_path / "t.csv").write_text(text)
    with gzip.open(tmp_path / "u.csv.gz", "wt") as f:
        f.write(text)
    for name in ("t.csv", "u.csv.gz"):
        frame = loader.scan(spark, str(tmp_path / name))
        assert dict(frame.dtypes) == {"id": "int", "at": "date", "name": "string", "x": "double"}
        assert frame.agg(F.sum("id"), F.sum("x"), F.count_distinct("name")).first() == (10, 12.5, 1)
    (tmp_path / "v.csv").write_text(text + "no number,2024-01-01,c,1\n")
    with pytest.raises(Exception, match="(?i)malformed|cannot|parse"):
        loader.scan(spark, str(tmp_path / "v.csv")).collect()


def test_staged_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "_STAGED", {})
    staging.staged(spark.range(3), "some")
    assert staging.remove_staged(spark) == 1 and staging.remove_staged(spark) == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        conf = type("", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(ConfigError):
        staging.shared_folder(Session)


def test_download(tmp_path):
    (tmp_path / "source").write_bytes(b"x" * 1000)
    url = (tmp_path / "source").as_uri()
    got = download.fetch_all({"a.csv": (url, 1000), "b.csv": (url, None)}, tmp_path / "raw")
    assert [p.stat().st_size for p in got.values()] == [1000, 1000]
    (tmp_path / "raw/a.csv").write_bytes(b"cut")
    assert download.fetch(url, tmp_path / "raw/a.csv", 1000).stat().st_size == 1000  # not whole, so fetched again
    (tmp_path / "source").write_bytes(b"y" * 1000)
    assert download.fetch(url, tmp_path / "raw/a.csv", 1000).read_bytes()[:1] == b"x"  # whole, so used again
    with pytest.raises(DataError):
        download.fetch(url, tmp_path / "raw/c.csv", 999)
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["a.csv", "b.csv"]


def test_database_changes_are_one_transaction(spark):
    connection = database.connected(spark, URL)
    for table in ("facts", "other"):
        database.executed(connection, f'CREATE TABLE {table} ("k" BIGINT NOT NULL PRIMARY KEY, "scope" BIGINT, "x" DOUBLE)')
    read = lambda table: sorted(tuple(r) for r in database.read_jdbc(spark, URL, table).collect())
    assert database.wait_until_reachable(spark, URL, "(SELECT 1 AS one FROM sysibm.sysdummy1) probe") == 1
    done = database.apply(spark, URL, [database.Change("facts", rows(spark, (1, 1, 1.0), (2, 2, float("inf"))), ["k"]), database.Change("other", rows(spark, (5, 5, 5.0)))])
    assert done == {"facts": 2, "other": 1} and read("facts") == [(1, 1, 1.0), (2, 2, None)]
    database.apply(spark, URL, [database.Change("facts", rows(spark, (2, 2, 2.0), (3, 2, 3.0)), ["k"])])
    database.apply(spark, URL, [database.Change("facts", rows(spark, (9, 2, 9.0)), scope=("scope", 2))])
    assert read("facts") == [(1, 1, 1.0), (9, 2, 9.0)]
    twice = rows(spark, (4, 4, 4.0), (4, 4, 4.0))
    with pytest.raises(WarehouseError, match="nothing was loaded"):
        database.apply(spark, URL, [database.Change("other", rows(spark, (6, 6, 6.0))), database.Change("facts", twice)])
    assert read("facts") == [(1, 1, 1.0), (9, 2, 9.0)] and read("other") == [(5, 5, 5.0)]
    with pytest.raises(WarehouseError):
        database.apply(spark, URL, [database.Change("facts; DROP TABLE other", twice)])
    connection.close()


def test_no_answer(spark):
    with pytest.raises(WarehouseError, match="2 attempts"):
        database.wait_until_reachable(spark, "jdbc:derby:memory:nothing", attempts=2, wait=0.01)
