import duckdb
import pytest

from plumbline.llm import licences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def known(spark):
    return licences.default_known(spark)


TEXTS = [
    "Released under the MIT License.",
    "  RELEASED under the mit   licence  ",
    "Copyright (c) 2020 Some One\nReleased under the MIT License\n",
    "Some text.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.\nmore",
    "Some text that only mentions the MIT License in a sentence.",
    "Licensed under Creative Commons Attribution-NonCommercial 4.0",
    "Licensed under Creative Commons Attribution Non-Commercial 4.0",
    "",
    None,
    "\n\n",
    "Copyright 2021 only",
]


def test_units_and_spellings(spark, documents, known):
    got = {r["id"]: r for r in licences.scan_licences(documents(TEXTS), known).collect()}
    assert [got[k]["whole_licence"] for k in range(len(TEXTS))] == ["MIT", "MIT", "MIT", None, None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None, None, None, None]
    assert got[2]["n_licence_lines"] == 1 and got[0]["n_licence_lines"] == 1
    assert (got[3]["n_licence_lines"], got[3]["licences"]) == (2, "Apache-2.0,LicenseRef-all-rights-reserved")
    assert got[4]["licences"] == "" and got[10]["n_licence_lines"] == 0


def test_entire_licence_texts_as_a_parameter(spark, documents):
    text = "The Licence\n\nPermission is granted, free of charge.\nNo warranty; none at all!"
    known = spark.createDataFrame([("Own-1.0", text)], "spdx string, text string")
    docs = documents([text.replace("Licence", "LICENSE").replace("\n", "  \n "), "Copyright 1999 me\n" + text, text + " And more.", "intro\n" + text])
    got = {r["id"]: r["whole_licence"] for r in licences.scan_licences(docs, known).collect()}
    assert got == {0: "Own-1.0", 1: "Own-1.0", 2: None, 3: None}


def test_defined_cases(spark, documents, known):
    assert licences.scan_licences(documents([]), known).count() == 0
    docs = documents([(None, TEXTS[0]), (1, TEXTS[0]), (1, TEXTS[0])]).selectExpr("*", "1 AS id", "2 AS rid", "3 AS spdx", "4 AS digest")
    rows = licences.scan_licences(docs, known).collect()
    assert len(rows) == 3 and {r["whole_licence"] for r in rows} == {"MIT"}
    assert licences.scan_licences(docs, known.limit(0)).filter("whole_licence IS NOT NULL").count() == 0


def test_whole_table_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, whole_licence, n_licence_lines, licences, canonical_md5 FROM ({licences.OP3_SQL}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in licences.op3_licences(spark, SF).orderBy("doc_id").collect()]
    assert got == want and sum(r[2] for r in got) > 5


def test_full_texts_and_runs_of_lines(spark, documents, known):
    """Whole licences, and licences and headers inside a document, also with other line breaks."""
    read = lambda name: (licences.FULL_TEXTS / f"{name}.txt").read_text()
    whole = ["MIT", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"]
    header = read("Apache-2.0+header")
    docs = [read(name) for name in whole]
    docs += ["intro\nCopyright 2020 me\n\n" + read("MIT") + "\nmore", "# a file\n" + " ".join(header.split()) + "\ncode", "x\n" + header.replace(" you ", "\nyou\n") + "y", "x\n" + header.replace("WARRANTIES", "PROMISES")]
    got = {r["id"]: r for r in licences.scan_licences(documents(docs), known).collect()}
    assert [got[k]["whole_licence"] for k in range(6)] == whole
    assert [name in got[k]["licences"].split(",") for k, name in enumerate(whole)] == [True] * 6
    assert [got[k]["licences"] for k in range(6, 10)] == ["MIT", "Apache-2.0", "Apache-2.0", ""]
    assert got[6]["whole_licence"] is None and got[6]["n_licence_lines"] == 0


def test_more_known_texts_than_are_sent(spark, documents, known, monkeypatch):
    docs = documents(TEXTS * 3)
    want = sorted(map(str, licences.scan_licences(docs, known).drop("rid").collect()))
    monkeypatch.setattr(licences, "MOST_SENT", 3)
    assert sorted(map(str, licences.scan_licences(docs, known).drop("rid").collect())) == want


def test_query_finds_entire_licences(spark, documents, written):
    text = (licences.FULL_TEXTS / "Apache-2.0.txt").read_text()
    rows = licences.op3_licences(spark, written(documents=documents([text, "Copyright 2001 me\n" + text.upper(), "some " + text, "word " * 200_000]))).orderBy("doc_id").collect()
    assert [r["whole_licence"] for r in rows] == ["Apache-2.0", "Apache-2.0", None, None]
