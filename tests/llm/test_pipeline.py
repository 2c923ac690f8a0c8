import hashlib
import math
from zlib import crc32

import pyarrow.parquet as pq
from test_contexts_langid import brute_plain_bits
from test_minhash import brute
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import bpe, common, langid, mixing

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(bpe.vocabulary_path())
SPACES = dict.fromkeys(map(ord, common.SPACES))


def brute_mix(docs, entropy=0.95, repeats=2.0, seed=7):
    """doc_id: how often it is taken."""
    tokens = {d["doc_id"]: len(d["text"].encode().split()) for d in docs}
    sums = {}
    for d in docs:
        sums[d["source"]] = sums.get(d["source"], 0) + tokens[d["doc_id"]]
    total = sum(sums.values())

    def weights(step):
        power = {s: (t / total) ** (step / mixing.STEPS) for s, t in sums.items()}
        return {s: p / sum(power.values()) for s, p in power.items()}

    def bisect(holds, low, high):
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if holds(weights(mid)) else (low, mid)
        return low

    wide = bisect(lambda w: -sum(x * math.log(x) for x in w.values()) >= entropy * math.log(len(sums)) - 1e-12, 0, mixing.STEPS + 1)
    rep = bisect(lambda w: max(w[s] * total / sums[s] for s in sums) > repeats, -1, mixing.STEPS) + 1
    w = weights(max(wide, rep))
    out = {}
    for s in sums:
        quota = int(round(w[s], 9) * total)
        blocks, room = divmod(quota, sums[s])
        own = [d["doc_id"] for d in docs if d["source"] == s]
        for i in sorted(own, key=lambda i: hashlib.md5(f"{seed}:{blocks}:{i}".encode()).hexdigest()):
            room -= tokens[i]
            out[i] = blocks + (room >= 0)
    return out


def test_run_matches_a_plain_version(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    table = common.table(spark, SF, "documents")
    model = langid.fit(table)
    kept = []
    for d, (lang, _, bits) in zip(docs, model.predict([d["text"] for d in docs]), strict=True):
        size = len(d["text"].encode())
        if lang != "und" and bits * size < brute_plain_bits(d["text"].encode().lower()):
            kept.append(d)
    assert len(kept) > 0.95 * len(docs) and any(crc32(str(d["doc_id"]).encode()) % 5 == 0 for d in kept)
    best = {}
    for d in kept:
        key = d["text"].translate(SPACES)
        if key not in best or (-len(d["text"]), d["doc_id"]) < (-len(best[key]["text"]), best[key]["doc_id"]):
            best[key] = d
    kept = sorted(best.values(), key=lambda d: d["doc_id"])
    least = brute([(d["doc_id"], d["text"]) for d in kept])
    kept = [d for d in kept if least[d["doc_id"]][1] == d["doc_id"]]
    times = brute_mix(kept)
    want = sorted((d["doc_id"], d["source"], LIBRARY.encode(d["text"], add_special_tokens=False).ids) for d in kept for _ in range(times[d["doc_id"]]))
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "source", "n_tokens", "ids"]
    got = rows.collect()
    assert sorted((r["doc_id"], r["source"], r["ids"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_keep_the_columns(spark, documents):
    docs = common.table(spark, SF, "documents").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0


def test_empty_and_odd_documents(spark, documents, written):
    rows = corpus_pipeline.run(spark, written(documents=documents([])))
    assert rows.count() == 0 and rows.columns == ["doc_id", "source", "n_tokens", "ids"]
    text = "the cat and the dog and the mouse"
    odd = documents([(None, None), (None, text, "en"), (1, text, "en", "a"), (1, text, "en", "a"), (2, "", "en", "b"), (3, "12", None, "b"), (4, text + " again and some other words", "en", None)])
    got = corpus_pipeline.run(spark, written(documents=odd)).collect()
    assert {r["doc_id"] for r in got} == {1}  # the quota of the other source holds no whole document
