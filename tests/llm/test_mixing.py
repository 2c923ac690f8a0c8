import math

import duckdb
import pytest
from test_pipeline import brute_mix

from plumbline.llm import mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def skewed(spark, documents):
    """One source with most of the tokens, some small ones."""
    rows = [(k, "word " * (1 + k % 9), None, "big" if k % 3 else f"s{k % 7}") for k in range(900)]
    return documents(rows)


def taken(spark, docs, **how):
    rows, sources = mixing.plan(docs, **how)
    return {r["doc_id"]: r["n"] for r in mixing.mixed(docs, **how).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}, {r["source"]: r for r in sources.collect()}


def test_matches_a_plain_version(spark, skewed, monkeypatch):
    monkeypatch.setattr(mixing, "IN_RANGE", 1)  # ranges inside ranges
    got, _ = taken(spark, skewed)
    want = brute_mix([r.asDict() for r in skewed.collect()])
    assert got == {i: n for i, n in want.items() if n}


def test_weights_meet_entropy_or_repetition(spark, skewed):
    _, sources = taken(spark, skewed)
    w = [r["weight"] for r in sources.values()]
    entropy = -sum(x * math.log(x) for x in w) / math.log(len(w))
    tokens = {r["source"]: r["t"] for r in mixing.plan(skewed)[0].groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    most = max(sources[s]["weight"] * sum(tokens.values()) / t for s, t in tokens.items())
    assert math.isclose(sum(w), 1, abs_tol=1e-6) and most <= 2 + 1e-4
    assert math.isclose(most, 2, abs_tol=1e-3) or math.isclose(entropy, 0.95, abs_tol=1e-4)
    _, flat = taken(spark, skewed, repeats=1000.0, entropy=0.999)
    w = [r["weight"] for r in flat.values()]
    assert math.isclose(-sum(x * math.log(x) for x in w) / math.log(len(w)), 0.999, abs_tol=1e-5)


def test_budget_is_kept(spark, skewed):
    for budget in (0.3, 1.0, 1.7):
        _, sources = taken(spark, skewed, budget=budget, repeats=50.0)
        rows = mixing.mixed(skewed, budget=budget, repeats=50.0).withColumn("n", mixing.n_tokens("text"))
        spent = {r["source"]: r["n"] for r in rows.groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
        for s, r in sources.items():
            assert 0 <= r["quota"] - spent.get(s, 0) < 9  # less than a document is left


def test_whole_table_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, source, n_tokens, weight, copies, schedule FROM ({mixing.OP4_SQL}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in mixing.op4_mixing(spark, SF).orderBy("doc_id").collect()]
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(math.isclose(a[3], b[3], abs_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_defined_cases(spark, documents):
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mixed(documents([(1, None, None, "a"), (2, " ", None, None)])).count() == 0
    docs = documents([(1, "a b c", None, None), (1, "a b c", None, None), (None, "d e f", None, None)]).selectExpr("*", "1 AS id", "2 AS copies", "3 AS cut", "4 AS weight", "5 AS row")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 3 and mixing.mixed(docs).columns == docs.columns  # one source: all of it once


def test_rows_come_in_blocks(spark, skewed):
    """Each block of a source has its documents once, in an order of its own, and blocks follow each other."""
    rows = mixing.scheduled(skewed, repeats=50.0).select("row.doc_id", "row.source", "block", "place").collect()
    by = {}
    for r in rows:
        by.setdefault((r["source"], r["block"]), []).append((r["place"], r["doc_id"]))
    orders = {}
    for (source, block), found in by.items():
        ids = [i for _, i in sorted(found)]
        assert len(set(ids)) == len(ids)
        orders.setdefault(source, {})[block] = ids
    repeated = [o for o in orders.values() if len(o) > 1]
    assert repeated
    for o in repeated:
        assert sorted(o) == list(range(len(o)))
        assert set(o[0]) >= set(o[len(o) - 1]) and (len(o[0]) < 3 or [i for i in o[0] if i in o[1]] != o[1])
    at = {(r["doc_id"], r["block"]): (r["block"], r["place"]) for r in rows}
    seen, order = {}, []
    for r in mixing.mixed(skewed, repeats=50.0).collect():
        order.append(at[r["doc_id"], seen.get(r["doc_id"], 0)])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert order == sorted(order) and len(order) == len(rows)


def test_null_ids_have_places_of_their_own(spark, documents):
    docs = documents([(None, f"text number {k}", None, "a") for k in range(50)] + [(1, "b b b", None, "b")])
    assert mixing.plan(docs)[0].select("key").distinct().count() == 51
