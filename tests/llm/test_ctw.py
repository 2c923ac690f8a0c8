import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plumbline.llm import contexts, ctw

SF = "/root/testdata/sf0.01"


def brute_bits(train, text, depth):
    """Each decision as a ratio of weighted probabilities: with it appended, over without."""
    seen = defaultdict(Counter)  # (context, place): bits
    children = defaultdict(set)
    edge = bytes([contexts.EDGE])

    def decisions(byte):
        place = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield place, bit
            place = 2 * place + bit

    def kt(c):
        a, b = c[0], c[1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, place):
        if len(context) == depth:
            return kt(seen[context, place])
        below = sum(weighted(bytes([x]) + context, place) for x in children[context])
        return np.logaddexp(kt(seen[context, place]), below) + math.log(0.5)

    for t in train:
        t = edge * depth + t + edge
        for k in range(depth, len(t)):
            for d in range(depth + 1):
                c = t[k - d : k]
                for place, bit in decisions(t[k]):
                    seen[c, place][bit] += 1
                if d:
                    children[c[1:]].add(c[0])
    total, text = 0.0, edge * depth + text + edge
    for k in range(depth, len(text)):
        path = [text[k - d : k] for d in range(depth + 1)]
        for c in path[1:]:
            children[c[1:]].add(c[0])
        for place, bit in decisions(text[k]):
            before = weighted(b"", place)
            for c in path:
                seen[c, place][bit] += 1
            total -= (weighted(b"", place) - before) / math.log(2)
            for c in path:
                seen[c, place][bit] -= 1
    return total


class Model:
    """All contexts in one place."""

    def __init__(self, train, depth):
        grams, n = contexts.counted(train, depth, end=True)
        self.depth = depth
        self.levels, _ = ctw.subtrees(grams, n.astype(float), 0, depth)

    def bits(self, texts):
        return [ctw.code_lengths(self.levels, contexts.grams([t], self.depth, end=True), self.depth).sum() for t in texts]


def test_code_lengths_match_brute_force():
    rng = random.Random(5)
    train = ["".join(rng.choice("ab c") for _ in range(30)).encode() for _ in range(3)]
    tests = [b"", b"ab", b"abca z", train[0][:12]]
    assert np.allclose(Model(train, 2).bits(tests), [brute_bits(train, t, 2) for t in tests], rtol=1e-4)


def test_the_model_is_a_proper_code_and_learns():
    rng = random.Random(6)
    words = ["the", "and", "ing", "ough"]
    make = lambda: " ".join(rng.choice(words) for _ in range(200)).encode()
    m = Model([make() for _ in range(20)], 4)
    for context in (b"the ", b"ough", b"zzzz", b"zthe"):
        grams = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)])
        assert np.isclose(np.exp2(-ctw.code_lengths(m.levels, grams, 4)).sum(), 1)
    text = make()
    shuffled = bytes(rng.sample(text, len(text)))
    likely, unlikely = m.bits([text, shuffled])
    assert likely / len(text) < 1.5 < unlikely / len(text)


def test_ln_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e7, 1e11])
    assert np.allclose(ctw._ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


def test_query_over_a_whole_table(spark, monkeypatch):
    monkeypatch.setattr(ctw, "SENT", 300)  # so that both ways of counting words are taken
    rows = {r["doc_id"]: r for r in ctw.op10_lm_scores(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True))
    held = {i: crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*x.encode().lower().split(), None] for i, x in texts.items()}
    count = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = count.total(), len(count)
    scores = []
    for i, x in tokens.items():
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(x), n)
        assert r["n_known"] == sum(count[w] > 0 for w in x)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        if held[i]:
            scores.append((r["score"], base, r["bits_per_byte"]))
    score, base, bits = zip(*scores, strict=True)
    assert len(rows) == len(texts) and np.mean(bits) < 2.6
    assert np.corrcoef(score, base)[0, 1] > 0.98


def test_defined_cases(spark, documents):
    empty = documents([])
    assert ctw.scored(empty, empty).count() == 0
    odd = documents([(None, None), (1, ""), (2, "a b"), (2, "a b")]).selectExpr("*", "1 AS rid", "2 AS word", "3 AS n")
    rows = ctw.scored(odd, odd.filter(F.lit(False))).orderBy("id").collect()
    assert [(r["id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in rows] == [(None, 1, 0, 0.0), (1, 1, 0, 0.0), (2, 3, 0, 0.0), (2, 3, 0, 0.0)]
    assert math.isclose(rows[2]["score"], -8 * 4 * math.log10(2), rel_tol=1e-6)  # a bit for each decision
    rows = ctw.scored(odd, odd).orderBy("id").collect()
    assert [r["n_known"] for r in rows] == [1, 1, 3, 3] and {r["train_tokens"] for r in rows} == {8}


def test_long_texts_in_parts_have_the_same_grams(monkeypatch):
    texts = [b"abcab" * 9, b"", b"bca", b"xyz" * 20, b"a"]
    grams, n = contexts.counted(texts, ctw.DEPTH, end=True)
    bits = np.arange(1, len(grams) + 1, dtype=float)
    whole = ctw._summed(texts, grams, bits)
    monkeypatch.setattr(contexts, "TOGETHER", 7)
    assert np.allclose(ctw._summed(texts, grams, bits), whole) and math.isclose(whole.sum(), (bits * n).sum())


def test_every_context_of_the_corpus_is_learnt(spark, documents):
    """The same bits as a tree in memory that has all contexts, however many there are."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    train = [" ".join(word() for _ in range(60)) for _ in range(300)] + ["zyxwvut é zyxwvut"]
    tests = [*train[::40], "zyxwvut", "", None, "quite other 123", " ".join(train[:5])]
    got = {r["id"]: r["bits_per_byte"] for r in ctw.scored(documents(tests), documents(train)).collect()}
    lowered = [contexts.lowered(t) for t in tests]
    want = Model([contexts.lowered(t) for t in train], ctw.DEPTH).bits(lowered)
    assert np.allclose([got[k] * max(1, len(t)) for k, t in enumerate(lowered)], want, rtol=1e-4)


def test_long_words_are_counted_by_digest(spark, documents):
    """A long word that stands in every document, and one that stands in one."""
    often, once = "u" * 70 + "/" + "v" * 5000, "w" * 90
    docs = documents([(k, f"{often} word{k}") for k in range(20)] + [(20, once), (21, once + "x")])
    rows = {r["id"]: r for r in ctw.scored(docs, docs.filter("doc_id <> 21")).collect()}
    n, v = 20 * 3 + 2, 20 + 2 + 1
    base = lambda *counts: sum(math.log10((c + 1) / (n + v + 1)) for c in counts)
    assert [(rows[k]["n_tokens"], rows[k]["n_known"]) for k in (0, 20, 21)] == [(3, 3), (2, 2), (2, 1)]
    assert all(math.isclose(rows[k]["base_score"], x, rel_tol=1e-9) for k, x in ((0, base(20, 1, 21)), (20, base(1, 21)), (21, base(0, 21))))
