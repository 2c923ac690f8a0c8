import hashlib
import random

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import bpe

SF = "/root/testdata/sf0.01"
LIBRARY = Tokenizer.from_file(bpe.vocabulary_path())
OWN = bpe.ForcedBoundaryBPE(bpe.read_vocabulary())


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    n, ids_sha, text_sha = OWN.digests(text)
    assert (n, ids_sha) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert text_sha == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    same(text)


def test_chosen_texts():
    rng = random.Random(1)
    for text in ["", " ", "\n\n The  end\n", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext", "՘a࢏ b", "\x00\x1c\x85 x", "'s 'S I'll  ", "�\U0001f600" * 9]:
        same(text)
    for _ in range(300):
        same("".join(rng.choice(["the", " ", "\n", "é", "ß", "12", "'", "ll", "漢", "՘", "\t", "<|endoftext|>", "ab"]) for _ in range(rng.randrange(40))))


def test_long_words_and_blocks(monkeypatch):
    rng = random.Random(2)
    same("".join(rng.choice("abcdefgh") for _ in range(5000)))
    same("a" * 3000 + "=" * 500)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    same("Many words é in blocks of\n\nthree, 漢字 and more. " * 20)


def test_cuts_are_where_no_token_has_the_pair():
    parts = list(OWN.fragments("zqé\x01\x02x".encode()))
    assert b"".join(parts) == "zqé\x01\x02x".encode() and len(parts) > 1


def test_query_over_a_whole_table(spark):
    rows = {r["doc_id"]: r for r in bpe.op8_bpe(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert len(rows) == len(t["doc_id"])
    for i, e, text in zip(t["doc_id"], LIBRARY.encode_batch(t["text"], add_special_tokens=False), t["text"], strict=True):
        assert rows[i]["n_tokens"] == len(e.ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_defined_cases(spark, documents):
    assert bpe.round_trips(documents([])).count() == 0
    docs = documents([(None, None), (1, ""), (2, "x y"), (2, "x y")]).selectExpr("*", "1 AS id", "2 AS ids", "3 AS n_tokens")
    got = sorted((str(r["id"]), r["n_tokens"]) for r in bpe.round_trips(docs).collect())
    assert got == [("1", 0), ("2", 2), ("2", 2), ("None", 0)]
    back = bpe.decoded(bpe.encoded(documents(["Hello é", None]))).collect()
    assert sorted(r["text"] for r in back) == ["", "Hello é"]
