import hashlib
import random
import re
from zlib import crc32

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import merkle

SF = "/root/testdata/sf0.01"
TEXT = "First one. Second one! Third?\nA line\n\nNew section. With two.\nEnd"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.! \n\té"), max_size=60))
def test_parts_are_the_text(text):
    parts = merkle.tree(text)
    assert "".join(leaf for s in parts for p in s for leaf in p) == text
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=12), st.text(alphabet="ab. \n", max_size=12))
def test_equal_roots_mean_equal_texts(a, b):
    a_mark, b_mark = merkle.fingerprint(a), merkle.fingerprint(b)
    assert (a == b) == (a_mark == b_mark) == (a_mark.split("|")[0] == b_mark.split("|")[0])
    assert merkle.likeness(a_mark, b_mark) == merkle.likeness(b_mark, a_mark)


def test_shape_and_differences():
    assert [len(s) for s in merkle.tree(TEXT)] == [3, 2]
    other = TEXT.replace("With two", "With three")
    a, b = merkle.fingerprint(TEXT), merkle.fingerprint(other)
    assert merkle.differing(a, b) == [(1, 0)] and not merkle.differing(a, a)
    assert merkle.likeness(a, b) == 7 / 8  # the blank line is a leaf too
    assert merkle.likeness(a, merkle.fingerprint("Nothing alike.\nAt all")) == 0


def test_long_sentences_are_cut_by_content():
    words = " ".join(f"word{k}" for k in range(2000))
    leaves = [leaf for s in merkle.tree(words) for p in s for leaf in p]
    assert len(leaves) > 100
    changed = words.replace("word1000 ", "other ")
    assert merkle.likeness(merkle.fingerprint(words), merkle.fingerprint(changed)) > 0.95


def brute_leaves(sentence):
    """Of one sentence, by walking over its code points."""
    if len(sentence) <= 300:
        return [sentence]
    out, part, word = [], "", ""
    words = re.findall(r"\S+\s*|\s+", sentence)
    for word in words:
        at = 0
        if len(word) > 64:
            for k in range(8, len(word) - 7):
                if k - at >= 8 and crc32(word[k - 8 : k].encode()) % 32 == 0:
                    out.append(part + word[at:k])
                    part, at = "", k
        part += word[at:]
        if crc32(word[at:].encode()) % 8 == 0:
            out.append(part)
            part = ""
    return out + [part] if part else out


def brute_parts(text, is_end):
    """Cut behind each place that ``is_end`` names, but not at the text's end."""
    parts, last = [], 0
    for k in range(1, len(text)):
        if is_end(text, k):
            parts.append(text[last:k])
            last = k
    return [*parts, text[last:]]


def after_blank_lines(text, k):
    """Behind a run of line breaks with nothing but blanks between them, two or more, and no further one."""
    before = re.search(r"\n(?:[^\S\n]*\n)+\Z", text[:k])
    return bool(before) and not re.match(r"[^\S\n]*\n", text[k:])


def after_sentence(text, k):
    return text[k - 1].isspace() and not text[k].isspace() and text[:k].rstrip() != "" and text[:k].rstrip()[-1] in ".!?"


def digest(data, size=8):
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def brute_fingerprint(text):
    sections, marks = [], []
    for section in brute_parts(text, after_blank_lines):
        paragraphs = []
        for line in brute_parts(section, lambda t, k: t[k - 1] == "\n"):
            paragraphs.append([digest(x.encode()) for sentence in brute_parts(line, after_sentence) for x in brute_leaves(sentence)])
        sections.append(digest(b"s" + ",".join(digest(b"p" + ",".join(p).encode()) for p in paragraphs).encode()))
        marks.append(sections[-1] + ":" + ",".join(".".join(p) for p in paragraphs))
    return digest(b"r" + ",".join(sections).encode(), 16) + "|" + ";".join(marks)


def brute_likeness(a, b):
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    x, y = (re.findall(r"(?<![0-9a-f])[0-9a-f]{16}(?![0-9a-f:])", m.split("|")[1]) for m in (a, b))
    common = sum(min(x.count(leaf), y.count(leaf)) for leaf in set(x))
    return 2 * common / (len(x) + len(y))


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + other[:n]
        marks = [brute_fingerprint(x) for x in (text, changed, other)]
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), *marks[:2], brute_likeness(marks[0], marks[1]), brute_likeness(marks[0], marks[2]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.! \n\té"), max_size=40))
def test_fingerprints_match_brute_force(text):
    assert merkle.fingerprint(text) == brute_fingerprint(text)


def test_a_sentence_is_the_same_leaf_everywhere():
    one, two = merkle.fingerprint("One here. "), merkle.fingerprint("One here. Two there.")
    assert merkle.likeness(one, two) == 2 / 3
    assert merkle.verified(one) and merkle.verified(two)
    assert not merkle.verified(two.replace(two[-16:], one[-16:]))
    assert not merkle.verified("0" * 32 + two[32:])


def test_query_over_a_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = merkle.op6_fingerprints(spark, SF).collect()
    want = brute([(i, x) for i, x in zip(t["doc_id"], t["text"], strict=True)])
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)
    near = [r for r in rows if r["n_chars"] > 600]
    assert sum(r["near_edited"] > r["near_next"] for r in near) > 0.98 * len(near)
    assert sum(0.35 < r["near_edited"] < 0.95 for r in near) > 0.8 * len(near)


def test_defined_cases(spark, documents):
    assert merkle.neighbours(documents([])).count() == 0
    assert merkle.neighbours(documents([(5, "abc abc")])).collect()[0]["near_next"] == 1
    odd = documents([(None, "last"), (1, None), (2, ""), (2, ""), (3, "x" * 9), (1 << 40, "ab cd ef")]).selectExpr("*", "1 AS id", "2 AS part", "3 AS tie")
    rows = merkle.neighbours(odd).collect()
    assert sorted((str(r["id"]), r["n_chars"]) for r in rows) == [("1", 0), ("1099511627776", 8), ("2", 0), ("2", 0), ("3", 9), ("None", 4)]
    by = {r["id"]: r for r in rows}
    assert by[None]["edited_sha256"] == hashlib.sha256(b"lasa").hexdigest()  # the first row follows the last
    assert by[2]["near_edited"] == 1


def test_long_runs_without_blanks_are_cut_by_content():
    rng = random.Random(2)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    other = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1000))
    edited = text[:1000] + other + text[2000:]
    assert "".join(leaf for s in merkle.tree(text) for p in s for leaf in p) == text
    assert 0.5 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(edited)) < 0.8
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint("x" + text)) > 0.9
