import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.llm import minhash

SF = "/root/testdata/sf0.01"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """id: (size of the set, least id of the component), comparing all that share a shingle."""
    sets = {i: brute_set(t) for i, t in rows}
    of = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            of[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    done = set()
    for ids in of.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(found, rows):
    want = brute(rows)
    got = {r["id"]: r for r in found.collect()}
    assert got.keys() == want.keys()
    for i, (n, least) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, least, i == least)


def test_whole_table_matches_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    found = minhash.op2_minhash(spark, SF)
    check(found.withColumnRenamed("doc_id", "id"), list(zip(t["doc_id"], t["text"], strict=True)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({minhash.OP2_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == want


def test_chains_of_close_copies(spark, documents):
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(40):
            texts.append(" ".join(words))
            if rng.random() < 0.9:
                words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
    texts += ["short one", "Short  ONE", "short two", "", None, " \n", "a b c d e", "a b c d", "A b\tc d"]
    order = rng.sample(range(1000, 1000 + len(texts)), len(texts))
    rows = list(zip(order, texts, strict=True))
    check(minhash.near_classes(documents(rows)), rows)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.75, 0.9):
        got = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            y = x.copy()
            new = int(1000 * (1 - share) / (1 + share))
            y[:new] = rng.integers(0, 2**63, new, dtype=np.uint64)
            got.append(np.mean(minhash.signature(x) == minhash.signature(y)))
        assert abs(np.mean(got) - share) < 0.04


def test_second_permutation_is_one():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash._mixed32(x.copy(), np.empty_like(x), 0x85EBCA6B, 0xC2B2AE35))) == len(x)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(9, k) for k in range(9)] + [(100, 9), (50, 51)]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long")
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["c"]: r["comp"] for r in minhash.components(links).collect()} == root


def test_defined_cases(spark, documents):
    assert minhash.near_classes(documents([])).count() == 0
    text = "one two three four five six seven eight nine ten"
    odd = documents([(None, text), (3, text), (3, text), (2, text + " eleven"), (None, None), (7, "")]).selectExpr("*", "1 AS id", "2 AS cls", "3 AS n", "4 AS same")
    got = sorted((str(r["id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_classes(odd).collect())
    assert got == [("2", 7, "2", True), ("3", 6, "2", False), ("3", 6, "2", False), ("7", 0, "7", True), ("None", 0, "None", True), ("None", 6, "2", False)]
    assert sorted(str(r["doc_id"]) for r in minhash.drop_near(odd).collect()) == ["2", "7", "None"]
    twice = documents([(3, text), (3, text), (4, text)]).selectExpr("*", "1 AS row")
    assert [(r["doc_id"], r["row"]) for r in minhash.drop_near(twice).collect()] == [(3, 1)]


def test_last_round_in_blocks(spark, documents, monkeypatch):
    """Copies of one text with so many changes that some are linked and some just aren't, in blocks of a few."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    check(minhash.near_classes(documents(rows)), rows)


def test_close_pairs_come_once(spark):
    """All pairs of one bucket that are unlike components and close, none twice."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for k in range(40):
        own = base.copy()
        own[: k % 8 * 6] = rng.integers(0, 2**63, k % 8 * 6, dtype=np.uint64)
        sets.append(np.unique(own))
    keys = [minhash.bands(minhash.signature(s)) for s in sets]
    placed = spark.createDataFrame([(int(x), b, k, 200, k // 2) for k, own in enumerate(keys) for b, x in enumerate(own)], "key long, band int, c long, n long, comp long")
    table = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "c long, numbers binary")
    rows = minhash.close_candidates(placed, table).collect()
    got = [tuple(sorted((r["c"], int(x)))) for r in rows for x in np.frombuffer(r["partners"], np.int64)]
    assert len({(r["key"], r["i"], r["j"], r["c"]) for r in rows}) == len(rows)
    long = [minhash.signature(s, minhash.LONG_SIGNATURE).astype(np.uint8) for s in sets]
    want = {(a, b) for b in range(40) for a in range(b) if a // 2 != b // 2 and (keys[a] == keys[b]).any() and np.mean(long[a] == long[b]) >= minhash.CLOSE}
    assert set(got) == want and len(got) == len(want) > 50


def test_rows_grow_with_the_texts_just_below_the_threshold(spark, documents, monkeypatch):
    """Texts that are 0.7 alike in pairs: nearly all pairs are compared, but rows are listed by text."""
    listed = []
    whole = minhash.close_candidates

    def counted(*args):
        found = minhash.staged(whole(*args), "counted")
        listed.append((found.count(), found.selectExpr("sum(length(partners) DIV 8)").first()[0]))
        return found

    monkeypatch.setattr(minhash, "close_candidates", counted)
    most = len(range(minhash.BANDS))
    for n in (60, 240):
        rng = random.Random(5)
        rows = [(k, " ".join([f"s{w}" for w in range(104)] + [f"o{rng.randrange(10**9)}" for _ in range(20)])) for k in range(n)]
        got = minhash.near_classes(documents(rows)).collect()
        assert len(got) == n and all(r["kept"] and r["n_shingles"] == 120 for r in got)
    (rows_few, pairs_few), (rows_many, pairs_many) = listed
    assert pairs_few > 1200 and pairs_many > 20_000  # of 1770 and of 28680
    assert rows_many <= 6 * rows_few and rows_many <= most * 240


def test_recall_of_links_near_the_threshold(spark, documents):
    """200 pairs of 0.75 to 0.80 that nothing else connects: all are found, and none of as many pairs of 0.70 to 0.75."""
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(400):
        new = rng.randrange(12, 15) if k % 2 else rng.randrange(15, 19)
        words = [f"p{k}w{w}" for w in range(104)]
        other = words[: 104 - new] + [f"p{k}n{w}" for w in range(new)]
        same, size = 100 - new, 100
        linked = 100 * same >= 75 * (2 * size - same)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if linked else 2 * k + 1}
    got = {r["id"]: r["component_id"] for r in minhash.near_classes(documents(rows)).collect()}
    assert sum(want[2 * k + 1] == 2 * k for k in range(400)) >= 190
    assert got == want
