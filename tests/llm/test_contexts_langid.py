import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.llm import contexts, langid

SF = "/root/testdata/sf0.01"


def brute_bits(train, text, depth):
    """Code length by method C with exclusion, over all contexts of the training texts."""
    count = defaultdict(Counter)
    for t in train:
        t = bytes([contexts.EDGE]) * depth + t
        for k in range(depth, len(t)):
            for d in range(depth + 1):
                count[t[k - d : k]][t[k]] += 1
    total, text = 0.0, bytes([contexts.EDGE]) * depth + text
    for k in range(depth, len(text)):
        out = set()
        for d in range(depth, -1, -1):
            c = {s: n for s, n in count[text[k - d : k]].items() if s not in out}
            if not count[text[k - d : k]]:
                continue
            room = sum(c.values()) + len(c)
            if text[k] in c:
                total -= math.log2(c[text[k]] / room)
                break
            if c:
                total -= math.log2(len(c) / room)
            out |= c.keys()
        else:
            total += math.log2(256 - len(out))
    return total


def model(trained, depth):
    got = [contexts.counted(texts, depth, end=False) for texts in trained.values()]
    return langid.Grams(list(trained), [g for g, _ in got], [n.astype(float) for _, n in got], depth)


def test_costs_are_a_proper_code():
    """After any context, seen or not, the 256 bytes' probabilities sum to one."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef ") for _ in range(400)).encode() for _ in range(3)]
    found = model({"x": texts, "y": texts[:1]}, 3)
    for context in (b"abc", b"aab", b"zzz", b"fzz", bytes([contexts.EDGE] * 3)):
        grams = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)])
        for k in (0, 1):
            assert np.isclose(np.exp2(-found.costs(k, grams)).sum(), 1)


def test_held_out_accuracy_on_a_whole_table(spark):
    rows = {r["doc_id"]: r for r in langid.op9_langid(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pydict()
    assert len(rows) == len(t["doc_id"])
    right = []
    for i, lang, text in zip(t["doc_id"], t["lang"], t["text"], strict=True):
        assert rows[i]["held_out"] == (crc32(str(i).encode()) % 5 == 0)
        assert 0 <= rows[i]["score"] <= 1
        assert (rows[i]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text))
        if rows[i]["held_out"]:
            right.append(rows[i]["lang_pred"] == lang)
    assert np.mean(right) > 0.97


def test_defined_cases(spark, documents):
    empty = documents([])
    assert langid.fit(empty) is None
    assert langid.identified(empty, None).count() == 0
    docs = documents([(k, "the cat and the dog " * 3, "en") for k in range(20)] + [(k + 20, "der hund und die katze " * 3, "de") for k in range(20)])
    found = langid.fit(docs)
    odd = documents([(None, None), (None, "the the"), (1, "12 !"), (1, ""), (2, "der und"), (2, "der und"), (3, "漢字 " * 5)])
    odd = odd.selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS id")
    got = [r["lang_pred"] for r in langid.identified(odd, found).orderBy("doc_id", "text").collect()]
    assert got == ["und", "en", "und", "und", "de", "de", got[-1]]
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}


def brute_plain_bits(text):
    seen, total = Counter(), 0.0
    for k, x in enumerate(text):
        total -= math.log2((seen[x] + 0.5) / (k + 128))
        seen[x] += 1
    return total


def test_plain_code_matches_brute_force():
    for text in (b"", b"a", b"aaaa", bytes(range(256)), b"the cat and the dog" * 9):
        assert math.isclose(langid.plain_bits(text), brute_plain_bits(text), rel_tol=1e-9, abs_tol=1e-9)


def junk(rng, k):
    """Texts that have letters and are in no language."""
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = (
        lambda: " ".join(pick("0123456789abcdef", 40) for _ in range(8)),
        lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 600),
        lambda: pick([chr(x) for x in range(0x4E00, 0x9FA5)], 200),
        lambda: " ".join(pick("qxzjvkwbg", 7) for _ in range(80)),
    )
    return kinds[k % len(kinds)]()


def test_stage_drops_junk_and_keeps_clean_documents(spark):
    """On a whole table with planted junk, without a language or with a false one among the held-out: all of the junk goes, of the rest no more than a few of a thousand."""
    rng = random.Random(11)
    label = lambda i: "en" if crc32(str(i).encode()) % 5 == 0 else None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(10**9 + k, junk(rng, k), label(10**9 + k), "junk", 1) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(planted.select([planted[c].cast(docs.schema[c].dataType) for c in docs.columns]))
    kept = {r["doc_id"] for r in langid.accepted(both).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**9]
    letters = [r["doc_id"] for r in docs.collect() if r["text"] and langid.LETTER.search(r["text"])]
    assert len(kept) >= 0.995 * len(letters) and kept <= set(letters)


def test_stage_leaves_columns_alone(spark, documents):
    """Names that the operator uses itself belong to the table."""
    docs = documents([(k, f"the cat and dog number {k}", "en") for k in range(30)] + [(40, "12345 -- 999", "en"), (41, None, "en")])
    docs = docs.selectExpr("*", "777 AS score", "'mine' AS lang_pred", "3 AS bits_per_byte", "4 AS c0", "5 AS plain_bits_per_byte")
    rows = langid.accepted(docs)
    assert rows.dtypes == docs.dtypes
    got = rows.collect()
    assert {r["doc_id"] for r in got} == set(range(30)) and {(r["score"], r["lang_pred"], r["c0"]) for r in got} == {(777, "mine", 4)}


def test_two_hundred_languages(spark, documents):
    """Each with letters of its own: all are told apart, by trees of their own."""
    rng = random.Random(7)
    rows = []
    for k in range(200):
        letters = [chr(0x400 + 8 * (k % 100) + j) for j in range(4)] + [chr(97 + (k + j) % 26) for j in range(3)]
        rows += [(10 * k + j, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12)), f"l{k:03d}") for j in range(5)]
    docs = documents(rows)
    found = langid.identified(docs, langid.fit(docs)).collect()
    held = [r["lang_pred"] == r["lang"] for r in found if crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len({r["lang_pred"] for r in found}) > 190 and np.mean(held) > 0.9


@pytest.mark.parametrize("end", [False, True])
def test_cells_follow_each_text_alone(end):
    texts = [b"abcab", b"", b"bca"]
    grams, n = contexts.counted(texts, 2, end)
    tree = contexts.Tree(contexts.kept_contexts(contexts.context_sums(grams, n / n.sum(), 2), 0))
    cost = np.arange(tree.nodes * 256, dtype=float)
    alone = [tree.summed([t], cost, end)[0] for t in texts]
    assert np.allclose(tree.summed(texts, cost, end), alone)


@pytest.mark.parametrize("others", [1, 300])
def test_each_language_keeps_all_its_contexts(others, monkeypatch):
    """The model that is fitted has the code lengths of brute force, however many other languages there are."""
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    trained = {"a": [make("aab cdz", 80) for _ in range(4)], "b": [make("bcd ", 60) for _ in range(3)]}
    trained |= {f"x{k}": [make("xyz ", 20)] for k in range(others)}
    got = [contexts.counted(texts, 3, end=False) for texts in trained.values()]
    ppm = langid.Grams(list(trained), [g for g, _ in got], [n.astype(float) for _, n in got])
    tests = [b"", b"a", b"abc abc dd", "zzz é".encode(), make("abcd z", 50)]
    want = [[brute_bits(trained[k], t, 3) for k in "ab"] for t in tests]
    assert np.allclose(ppm.bits([t.decode() for t in tests])[:, :2], want)
    monkeypatch.setattr(contexts, "TOGETHER", 7)  # long texts in parts
    assert np.allclose(ppm.bits([t.decode() for t in tests])[:, :2], want)


def test_stray_labels_change_no_code_length(spark, documents):
    """The fitted model's bits per byte of a language, alone and beside 70 stray labels."""
    rng = random.Random(9)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(80))
    rows = [(k, make("abcdefghijklm"), "en") for k in range(20)]
    strays = [(100 + k, make("0123456789xyz"), f"s{k % 70}") for k in range(280)]
    alone, beside = (langid.fit(documents(x)) for x in (rows, rows + strays))
    text = make("abcdefghijklm")
    assert np.isclose(alone.bits([text])[0, 0], beside.bits([text])[0, beside.langs.index("en")])
