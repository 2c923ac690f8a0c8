r"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A section ends with a blank line, a paragraph with a line break, a sentence with
``.``, ``!`` or ``?`` and blanks; separators belong to what they end, so the
parts of a text laid end to end are the text. A sentence over ``LONG`` code
points is cut behind words whose checksum is a multiple of ``EVERY``, and its
words over ``LONG_WORD`` code points (Chinese, Thai, base64) where the checksum
of the last ``ROLLED`` code points is one of ``EVERY_POINT``. A sentence of up to
``LONG`` code points is one leaf: of texts that have no more, a part that is
replaced leaves a likeness of 0. A leaf is a digest of 64 bits of its sentence's
bytes, the same wherever the sentence stands; a node is a digest of its kind and
of its children's digests, up to the root, which the leaves alone rebuild.

A fingerprint is the whole tree as text, ``root|section;section;...``, where a
section is ``digest:paragraph,paragraph,...`` and a paragraph its leaves in 16
hexadecimal digits each, joined by ``.``. Equal texts have equal roots, and
unlike texts unlike ones but for collisions of digests. Differing sections lead
to the differing paragraphs and sentences, whose places ``differing`` gives. The
likeness of two fingerprints is the share of leaves that they have in common:
twice the common leaves (each as often as both have it) over all leaves of both,
and 1 for equal roots.

``neighbours`` hands each row the next one by descending id (after the last the
first). A pass over ids and hashes of texts finds the first keys of ranges of
like size, as many as shuffle partitions, which are sent to all workers; then each
row goes to its range, and the first row of a range to the one before as well,
where it is the last row's next. So texts are shuffled once.

Defined cases: a null text is empty; an empty text has one empty leaf; rows with
the same id are ordered by a hash of the text; null ids come last; a single row
is its own next; an empty table gives an empty result; other columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

LONG, EVERY = 300, 8
LONG_WORD, ROLLED, EVERY_POINT = 64, 8, 32
BLANK_LINES = re.compile(r"\n(?:[^\S\n]*+\n)++")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
WORD = re.compile(r"\S+\s*|\s+")


def _cut(text: str, ends: re.Pattern) -> list[str]:
    """Parts of a text that end where a match ends."""
    parts, at = [], 0
    for m in ends.finditer(text):
        if m.end() < len(text):
            parts.append(text[at : m.end()])
            at = m.end()
    parts.append(text[at:])
    return parts


def _pieces(word: str) -> list[str]:
    """A long word cut by its content, into parts of ``ROLLED`` code points at least."""
    if len(word) <= LONG_WORD:
        return [word]
    parts, at = [], 0
    for k in range(ROLLED, len(word) - ROLLED + 1):
        if k - at >= ROLLED and crc32(word[k - ROLLED : k].encode()) % EVERY_POINT == 0:
            parts.append(word[at:k])
            at = k
    return [*parts, word[at:]]


def _leaves(paragraph: str) -> list[str]:
    out = []
    for sentence in _cut(paragraph, SENTENCE):
        if len(sentence) <= LONG:
            out.append(sentence)
            continue
        part = []
        for word in WORD.findall(sentence):
            *cut, word = _pieces(word)
            for piece in cut:
                out.append("".join([*part, piece]))
                part = []
            part.append(word)
            if crc32(word.encode()) % EVERY == 0:
                out.append("".join(part))
                part = []
        if part:
            out.append("".join(part))
    return out


def tree(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of leaves."""
    return [[_leaves(p) for p in _lines(section)] for section in _cut(text, BLANK_LINES)]


def _lines(section: str) -> list[str]:
    parts = section.split("\n")
    lines = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    return lines or [""]


def _node(kind: bytes, children: list[str], size: int) -> str:
    return hashlib.blake2b(kind + ",".join(children).encode(), digest_size=size).hexdigest()


def fingerprint(text: str | None) -> str:
    sections, digests = [], []
    for section in tree(text or ""):
        leaves = [[hashlib.blake2b(x.encode(), digest_size=8).hexdigest() for x in paragraph] for paragraph in section]
        digests.append(_node(b"s", [_node(b"p", x, 8) for x in leaves], 8))
        sections.append(digests[-1] + ":" + ",".join(".".join(x) for x in leaves))
    return _node(b"r", digests, 16) + "|" + ";".join(sections)


def read(mark: str) -> tuple[str, list[tuple[str, list[list[str]]]]]:
    """Root, and sections (digest, the leaves of each paragraph)."""
    root, _, rest = mark.partition("|")
    sections = []
    for section in rest.split(";"):
        digest, _, paragraphs = section.partition(":")
        sections.append((digest, [x.split(".") for x in paragraphs.split(",")]))
    return root, sections


def verified(mark: str) -> bool:
    """Whether the leaves of a fingerprint rebuild its sections' digests and its root."""
    root, sections = read(mark)
    digests = [_node(b"s", [_node(b"p", x, 8) for x in paragraphs], 8) for _, paragraphs in sections]
    return digests == [d for d, _ in sections] and root == _node(b"r", digests, 16)


def likeness(a: str, b: str) -> float:
    (root_a, sections_a), (root_b, sections_b) = read(a), read(b)
    if root_a == root_b:
        return 1.0
    x, y = (Counter(leaf for _, paragraphs in s for leaves in paragraphs for leaf in leaves) for s in (sections_a, sections_b))
    return 2 * (x & y).total() / (x.total() + y.total())


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` that are not where they are in ``b``, found by descending into differing branches."""
    (root_a, left), (root_b, right) = read(a), read(b)
    if root_a == root_b:
        return []
    out = []
    for k, (digest, paragraphs) in enumerate(left):
        other = right[k] if k < len(right) else ("", [])
        if digest != other[0]:
            out += [(k, j) for j, leaves in enumerate(paragraphs) if j >= len(other[1]) or other[1][j] != leaves]
    return out


def edited(text: str, other: str) -> str:
    """The text, its last third replaced by the first as many code points (or all) of another."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def compared(text: str, other: str, own: str | None = None, next_mark: str | None = None) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    changed = edited(text, other)
    own, next_mark = own or fingerprint(text), next_mark or fingerprint(other)
    mark = own if changed == text else fingerprint(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), own, mark, likeness(own, mark), likeness(own, next_mark)


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _order(key: object, tie: int) -> tuple:
    """Keys in rising order, null first."""
    return (0, tie) if key is None else (1, key, tie)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``compared`` of its text and that of the next row by descending id."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.bitwise_not(F.xxhash64("text")))
    kind = rows.schema["id"].dataType.simpleString()
    # the first keys of ranges of like size, as many as partitions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("id", "tie").repartitionByRange(parts, F.col("id").desc_nulls_last(), F.col("tie").desc())
    found = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("id", "tie")).alias("first")).orderBy("part").collect()
    rising = [_order(r["first"]["id"], r["first"]["tie"]) for r in reversed(found)]
    if not rising:
        return spark.createDataFrame([], f"id {kind}, {RESULT}")
    n = len(rising)
    shared = spark.sparkContext.broadcast(rising)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its range, and the first ones of a range once more as guests of the range before."""
        rising = shared.value
        for b in batches:
            keys = [_order(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            at = [n - 1 - bisect_left(rising, k) for k in keys]
            guests = [k for k, x in enumerate(keys) if rising[n - 1 - at[k]] == x]
            rows = [*range(len(keys)), *guests]
            bucket = [*at, *((at[k] - 1) % n for k in guests)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([k >= len(keys) for k in range(len(rows))]), *(c.take(pa.array(rows)) for c in (b.column(0), b.column(1), b.column(2)))], names=["bucket", "guest", "id", "tie", "text"])

    sent = rows.select("id", "tie", "text").mapInArrow(deal, f"bucket int, guest boolean, id {kind}, tie long, text string")
    sent = sent.repartitionById(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), F.col("tie").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row of a bucket meets the next one, the last one the bucket's guest."""
        before = None
        for b in batches:
            ids, done = [], []
            for bucket, is_guest, key, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if is_guest and before is None:
                    continue
                mark = fingerprint(text)
                if before is not None:
                    ids.append(before[0])
                    done.append(compared(before[1], text, before[2], mark))
                before = None if is_guest else (key, text, mark)
            cols = list(zip(*done, strict=True)) or [()] * len(TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(2).type), *(pa.array(c, t) for c, t in zip(cols, TYPES, strict=True))], names=["id", *NAMES])

    return sent.mapInArrow(run, f"id {kind}, {RESULT}")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
