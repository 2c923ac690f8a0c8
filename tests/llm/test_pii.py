import hashlib
import re

import duckdb
import pyarrow.parquet as pq

from plumbline.llm import pii

SF = "/root/testdata/sf0.01"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in BASE.items()}


TEXTS = [
    "write to a.b@c.de, or x@y@z.com and _q@r.st_u@v.w.x; @no.where a@b",
    "a@b.cd_x@y.z +1 (386) 555-3733. +12 +123456789012345678 ++49 30 1234567",
    "10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.000255 1.2.3 9999.1.1.1.1",
    "4041894974608795 4041 8949-7460 8795 40418949746087951 40418949746087956789 1 2 3 4  5",
    "\U0001f600 é joe@example.org \U0001f600 +44 20 7946 0958 é 4777431686562174",
    "",
    None,
    "9" * 20000 + " " + "a" * 20000 + " " + "1.2." * 3000,
    " ".join(f"u{i}@h{i}.org" for i in range(300)),
    "0000000000000 +1-2-3-4-5-6-7-8-9- 4111111111111111-4111111111111111",
]


def check(docs, texts):
    for r in docs:
        want = brute(texts[r["id"]])
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in BASE} == want, texts[r["id"]]


def test_base_spans_match_the_given_patterns(spark, documents):
    check(pii.base_spans(documents(TEXTS)).collect(), dict(enumerate(TEXTS)))


def test_query_over_a_whole_table(spark):
    rows = {r["doc_id"]: r for r in pii.op1_pii(spark, SF).collect()}
    texts = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        found = brute(text)
        listed = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in found[k])
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in BASE] == [len(x) for x in found.values()]
        assert rows[i]["spans"].startswith(listed)


def test_disclosing_terms_are_added_and_removed(spark, documents):
    texts = [f"Number {w} of Quixote reach joe@example.org by {w} mail." for w in ("alpha", "bravo", "delta", "gamma")]
    texts += [f"number of {w} by mail reach" for w in ("other", "plain", "words", "alpha", "bravo", "delta", "gamma")] * 3
    found = {r["id"]: r for r in pii.find_personal(documents(texts), support=3).collect()}
    terms = {s["value"] for r in found.values() for s in r["term"]}
    assert terms == {"quixote"}
    assert [len(found[i]["term"]) for i in range(len(texts))] == [1] * 4 + [0] * (len(texts) - 4)
    clean = {r["id"]: r["text"] for r in pii.sanitised(documents(texts), support=3).collect()}
    assert clean[0] == "Number alpha of  reach [EMAIL] by alpha mail."
    assert clean[5] == texts[5]


def test_copies_of_one_passage_are_one_context(spark, documents):
    texts = ["see Quixote at joe@example.org now"] * 50 + ["number of plain words"] * 50
    assert not any(r["term"] for r in pii.find_personal(documents(texts)).collect())


def test_values_that_occur_once_count_by_their_domain_or_block(spark, documents):
    """Ann stands beside eight addresses of one domain, Li beside eight cards of one block, each once, and is a term wherever it stands."""
    fill = ("alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "kappa")
    cards = [c for c in (f"411111000000{k:04d}" for k in range(300)) if luhn(c)][:8]
    texts = [f"{w} Ann u{k}@quill.org {w}" for k, w in enumerate(fill)]
    texts += [f"pay {w} {c} {w} for Li" for w, c in zip(fill, cards, strict=True)]
    texts += [f"{'pad ' * 50}ann and {w}, LI" for w in fill[:2]]
    texts += [f"pay {w} for {w} and pad" for w in fill] * 12
    rows = pii.find_personal(documents(texts)).collect()
    assert {s["value"] for r in rows for s in r["term"]} == {"ann", "li"}
    assert all(len(r["term"]) == (1 if r["id"] < 16 else 2 if r["id"] < 18 else 0) for r in rows)
    clean = {r["id"]: r["text"] for r in pii.sanitised(documents(texts)).collect()}
    assert clean[8] == "pay alpha [CARD] alpha for " and clean[16].endswith("pad  and alpha, ")


def test_more_telling_terms_than_are_sent(spark, documents, monkeypatch):
    texts = [f"Number {w} of Quixote reach joe@example.org by {w} mail." for w in ("alpha", "bravo", "delta", "gamma")]
    docs = documents(texts + ["number of plain mail by reach, quixote"] + [f"number of {w} mail by reach" for w in ("plain", "alpha", "bravo", "delta", "gamma")] * 6)
    sent = [sorted(map(str, pii.find_personal(docs).drop("rid").collect()))]
    monkeypatch.setattr(pii, "MOST_SENT", 0)
    monkeypatch.setattr(pii, "BUCKETS", 1)
    assert [sorted(map(str, pii.find_personal(docs).drop("rid").collect()))] == sent
    assert str(sent).count("quixote") == 5


def test_empty_table_nulls_and_clashing_columns(spark, documents):
    assert pii.find_personal(documents([])).count() == 0
    odd = documents([(None, None), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd")])
    odd = odd.selectExpr("*", "1 AS rid", "2 AS id", "3 AS t", "4 AS term", "5 AS email", "6 AS near")
    got = sorted((str(r["id"]), len(r["email"])) for r in pii.find_personal(odd).collect())
    assert got == [("3", 1), ("3", 1), ("None", 0), ("None", 1)]


def test_sql_gives_the_same_rows(spark, documents, written):
    """On all of a table, and on texts with disclosing terms, edges of windows and overlaps."""
    texts = [f"Number {w} of Quixote reach joe@example.org by {w} mail." for w in ("alpha", "bravo", "delta", "gamma")]
    texts += [f"number of {w} by mail reach" for w in ("other", "plain", "words", "alpha")] * 5
    texts += [f"{'pad ' * k}Quixote joe@example.org 10.0.0.{k} +44 20 7946 0958 Sancho Quixote joe@example.org" for k in range(15, 24)]
    texts += [f"{w} Ann u{k}@quill.org {w}" for k, w in enumerate(("alpha", "bravo", "omega", "sigma"))] + ["of ann u8@quill.or"]
    texts += [f"+49 30 1234{k:04d} and 10.20.30.{k} calls Bo" for k in range(5)]
    texts += [t for t in TEXTS if t is None or len(t) < 5000]
    for folder in (SF, written(documents=documents(texts))):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if folder == SF else '/*.parquet'}'")
        rows = pii.op1_pii(spark, folder)
        want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({pii.OP1_SQL}) ORDER BY doc_id").fetchall()
        got = [tuple(r) for r in rows.orderBy("doc_id").collect()]
        assert got == want
    assert sum(r[-1] for r in got) > 10


def test_very_many_values_in_one_text(spark, documents):
    """20,000 addresses and as many words between them: work in proportion, and the same spans as the given patterns'."""
    import time

    words = ["alpha", "bravo", "charlie", "delta", "echo"]
    text = " ".join(f"{words[k % 5]} u{k}@h{k % 50}.org" for k in range(20_000))
    docs = documents([(1, text), (2, "see u1@h1.org")])
    start = time.monotonic()
    rows = {r["id"]: r for r in pii.find_personal(docs).collect()}
    assert time.monotonic() - start < 120
    assert [(s["start"], s["end"]) for s in rows[1]["email"]] == brute(text)["email"]
    clean = {r["id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[1] == re.sub(BASE["email"], "[EMAIL]", text) and clean[2] == "see [EMAIL]"


def test_windows_over_the_edges_of_pieces(spark, documents, monkeypatch):
    """Windows and spans in pieces and blocks of a few: the same rows as otherwise."""
    texts = [f"{'é pad ' * k}Quixote joe@example.org 10.0.0.{k} +44 20 7946 0958 \U0001f600 Sancho Quixote joe@example.org" for k in range(15, 24)]
    docs = documents(texts + [None, "", "word " * 50])
    whole = [sorted(map(str, f(docs).drop("rid").collect())) for f in (pii.find_personal, pii.sanitised)]
    monkeypatch.setattr(pii, "PIECE", 83)
    monkeypatch.setattr(pii, "BLOCK", 2)
    assert [sorted(map(str, f(docs).drop("rid").collect())) for f in (pii.find_personal, pii.sanitised)] == whole
