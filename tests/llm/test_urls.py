import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.llm import urls

SF = "/root/testdata/sf0.01"


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fit, key=lambda r: len(r[0] + r[1]), default=None)


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/1?x#y", "http://example.net", "http://example.net?/en/", "http://net/", "http://xnet/",
    "http://a.example.com/de/", "http://a.example.com/de", "x://b.org/fr/1://c.net/", "http://ÀB.org/fr/é#", "https://u@h.net:80/en/", "a\n://example.net/en/\nx",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, html string")


def test_rules_match_brute_force(pages):
    for r in urls.ruled(pages).collect():
        host, path, rule = brute(URLS[r["id"]])
        assert (r["host"], r["path"], r["rule"], r["allowed"]) == (host, path, rule and rule[0] + rule[1], rule and rule[2]), URLS[r["id"]]


def test_query_over_a_whole_table(spark):
    rows = {r["page_id"]: r for r in urls.op5_url_filter(spark, SF).collect()}
    t = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "url"]).to_pydict()
    assert len(rows) == len(t["url"])
    for i, u in zip(t["page_id"], t["url"], strict=True):
        host, path, rule = brute(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule and rule[0] + rule[1])
        assert rows[i]["verdict"] in ("allow", "block")
        if rule:
            assert rows[i]["verdict"] == ("allow" if rule[2] else "block")


def brute_log(train, text, depth):
    """Witten-Bell over all contexts, down to 1/256."""
    train, total = [b"\xff" * depth + t + b"\xff" for t in train], 0.0
    text = b"\xff" * depth + text + b"\xff"
    for k in range(depth, len(text)):
        p = 1 / 256
        for d in range(depth + 1):
            after = [t[j] for t in train for j in range(depth, len(t)) if t[j - d : j] == text[k - d : k]]
            if after:
                p = (after.count(text[k]) + len(set(after)) * p) / (len(after) + len(set(after)))
        total += np.log(p)
    return total


def test_ratios_match_brute_force():
    good = [f"good{k}.org/a{k}".encode() for k in range(10)]
    bad = [f"bad{k}.com/z{k}".encode() for k in range(10)]
    model = urls.Ratio(good, bad, 3, 10**9)
    learned = [[t for k, t in enumerate(x) if k % urls.CALIBRATED] for x in (good, bad)]
    tests = [b"good1.org/a", b"bad.com", b"q"]
    want = [(brute_log(learned[0], t, 3) - brute_log(learned[1], t, 3)) / (len(t) + 1) for t in tests]
    assert np.allclose(model.ratios(tests), want, rtol=1e-4)
    assert model.ratios(tests)[0] > model.threshold > model.ratios(tests)[1]


def test_undecided_urls_follow_those_they_resemble(spark):
    rows = [(k, f"http://casino{k}.bet.net/win/{k}") for k in range(60)] + [(k + 100, f"http://www.example.net/en/news/{k}") for k in range(60)]
    rows += [(200, "http://casino77.bet.com/win/5"), (201, "http://www.example.com/en/news/77"), (202, None)]
    found = urls.ruled(spark.createDataFrame(rows, "page_id long, url string"))
    got = {r["id"]: r["verdict"] for r in urls.judged(found, urls.fit(found)).collect()}
    model = urls.fit(found)
    assert (got[200], got[201]) == ("block", "allow")
    assert got[202] == ("allow" if model.ratios([b""])[0] >= model.threshold else "block")  # judged like any other


def test_defined_cases(spark, pages):
    empty = urls.ruled(pages.limit(0))
    assert urls.fit(empty) is None and urls.judged(empty, None).count() == 0
    one = spark.createDataFrame([(None, "http://a.com/", 1, 2)] * 2, "page_id long, url string, id int, host int")
    assert [r["verdict"] for r in urls.judged(urls.ruled(one), None).collect()] == ["allow"] * 2


def test_queries_and_fragments_are_judged(spark):
    rows = [(k, f"http://a{k}.bet.net/?win=casino{k}#cash") for k in range(60)] + [(k + 100, f"http://a{k}.example.net/en/?news=daily{k}#text") for k in range(60)]
    rows += [(200, "HTTP://Q.info/?win=casino77#cash"), (201, "http://q.info/?news=daily77#text")]
    found = urls.ruled(spark.createDataFrame(rows, "page_id long, url string"))
    got = {r["id"]: r for r in urls.judged(found, urls.fit(found)).collect()}
    assert (got[200]["verdict"], got[201]["verdict"]) == ("block", "allow")
    assert got[200]["url"] == "http://q.info/?win=casino77#cash"


def test_verdicts_on_a_whole_table(spark):
    """Those of undecided URLs, by the fitted model's ratio and threshold; and the share of held-out decided URLs that the model gets right."""
    rows = urls.ruled(spark.read.parquet(f"{SF}/pages.parquet"))
    model = urls.fit(rows)
    found = urls.judged(rows, model).collect()
    for r in found:
        assert math.isclose(r["ratio"], model.ratios([r["url"].encode()])[0], rel_tol=1e-6)
        if r["allowed"] is None:
            assert r["verdict"] == ("allow" if r["ratio"] >= model.threshold else "block")
    decided = sorted({(r["url"], r["allowed"]) for r in found if r["allowed"] is not None})
    held = [x for x in decided if zlib.crc32(x[0].encode()) % 4 == 0]
    learned = spark.createDataFrame([x for x in decided if x not in set(held)], "url string, allowed boolean")
    model = urls.fit(learned)
    right = [(r >= model.threshold) == allowed for r, (_, allowed) in zip(model.ratios([u.encode() for u, _ in held]), held, strict=True)]
    assert len(held) > 20 and np.mean(right) > 0.9


def test_many_rules_by_shuffle(spark, pages, monkeypatch):
    """The same rules among thousands of others, joined by a shuffle."""
    more = [(f"d{k}.example.org", f"/p{k}/", k % 2 == 0) for k in range(3000)]
    monkeypatch.setattr(urls, "MOST_SENT", 2)
    for r in urls.ruled(pages, urls.rule_table(spark, urls.RULES + more)).collect():
        host, path, rule = brute(URLS[r["id"]])
        assert (r["host"], r["path"], r["rule"], r["allowed"]) == (host, path, rule and rule[0] + rule[1], rule and rule[2])
