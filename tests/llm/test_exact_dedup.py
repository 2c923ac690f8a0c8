import hashlib

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup
from plumbline.llm.common import SPACES

SF = "/root/testdata/sf0.01"
GONE = dict.fromkeys(map(ord, SPACES))


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(GONE), []).append((-len(text or ""), i is None, i))
    out = {}
    for key, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


def test_whole_table_matches_brute_force_and_sql(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.op7_exact_dedup(spark, SF).collect()}
    assert got == brute(zip(t["doc_id"], t["text"], strict=True))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert {r[0]: r[1:] for r in con.execute(f"SELECT {', '.join(names)} FROM ({exact_dedup.OP7_SQL})").fetchall()} == got


ROWS = [(5, "a b"), (3, "ab"), (9, " a\tb\n"), (4, "a b"), (1, None), (2, ""), (7, " \x0b\x0c\r "), (8, "x"), (None, "x"), (6, "y"), (None, "zz")]


def test_spaces_longest_and_smallest(spark, documents):
    found = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_classes(documents([r for r in ROWS if r[0] or r[1] == "zz"])).collect()}
    assert found[5] == (9, 3, False) and found[9] == (9, 3, True) and found[4] == (4, 1, True)
    assert found[1] == (7, 3, False) and found[7] == (7, 3, True)
    assert found[8] == (8, 1, True) and found[None] == (None, 1, True)
    both = {r["id"]: r["keep_id"] for r in exact_dedup.exact_classes(documents([(8, "x"), (None, "x")])).collect()}
    assert both == {8: 8, None: 8}


def test_colliding_hashes_are_told_apart(spark, documents):
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 2), 2, "0"))
    rows = [(k, "t" * (k % 7) + " " * (k % 3)) for k in range(60)]
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_classes(documents(rows), digest=weak).collect()}
    assert got == brute(rows)


def test_dropping_keeps_columns_and_one_row(spark, documents):
    docs = documents([(1, "a b"), (2, "ab"), (2, "ab"), (3, "c"), (3, "c"), (None, None), (None, None)]).selectExpr("*", "1 AS h", "2 AS id", "3 AS variant", "4 AS norm", "5 AS row")
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert exact_dedup.drop_exact(documents([])).count() == exact_dedup.exact_classes(documents([])).count() == 0


def test_more_repeated_hashes_than_are_sent(spark, documents, monkeypatch):
    """Often repeated texts, seldom repeated ones and single ones, beyond what is sent; one digest for all of a kind, so that bytes decide."""
    rows = [(k, ["", "often the same", f"pair {k // 2}", f"alone {k}"][k % 4 if k < 80 else 2]) for k in range(120)] + [(500, "x " * 300_000), (501, "x" * 300_000)]
    want = sorted(map(str, exact_dedup.exact_classes(documents(rows)).collect()))
    monkeypatch.setattr(exact_dedup, "MOST_SENT", 5)
    monkeypatch.setattr(exact_dedup, "OFTEN", 10)
    assert sorted(map(str, exact_dedup.exact_classes(documents(rows)).collect())) == want
    merged = exact_dedup.exact_classes(documents(rows), digest=lambda c: exact_dedup.md5_128(exact_dedup.F.substring(c, 1, 1))).drop("h", "variant")
    assert sorted(map(str, merged.collect())) == sorted(map(str, exact_dedup.exact_classes(documents(rows)).drop("h", "variant").collect()))
