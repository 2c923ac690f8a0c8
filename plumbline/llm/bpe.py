r"""Byte-level BPE encoding and decoding with forced boundaries.

A text is cut at special tokens and into words by the byte-level pattern. In a
word, two adjacent bytes that stand side by side in no token of the vocabulary
can't end up in one token, so the word is cut between them; the fragments are
encoded independently by rank-ordered merges and their ids laid end to end.

The vocabulary is a tokenizers file (a parameter; by default one of the public
tokenizers), read on the driver and sent to the workers. Words are matched by the ``regex`` module. It may know newer
characters than the tokenizers library, so a text with a code point that is
unassigned in Python's own Unicode tables is cut into words by the library's
pre-tokeniser instead.

Defined cases: a null text encodes like an empty one, to no ids; repeated rows
are encoded each; null ids are kept; an empty table gives an empty result;
other columns are ignored; a text of any length is taken in blocks of words.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import released, small_batches, table

VOCABULARY = "byte_bpe_50k.json"
# The pattern of byte-level pre-tokenisation.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that are kept with their ids, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 500_000, 48
#: Fragments up to this length are merged by scanning, longer ones with a heap.
SCANNED = 48
#: Words that are encoded at a time, and the length from which a text is cut lazily.
BLOCK, LONG_TEXT = 100_000, 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a vocabulary file of the public tokenizers is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBoundaryBPE:
    def __init__(self, vocabulary: str):
        """``vocabulary``: the text of a tokenizers file with a byte-level BPE model."""
        import regex

        self._source = vocabulary
        d = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        tokens = {as_bytes(t): i for t, i in d["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*tokens.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for t, i in [*tokens.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.token_bytes[i] = t
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(d["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[tokens[a], tokens[b]] = (rank, tokens[a + b])
        self.byte_ids = [tokens[bytes([b])] for b in range(256)]
        together = {t[k : k + 2] for t in tokens for k in range(len(t) - 1)}
        apart = {(a, b) for a in range(256) for b in range(256)} - {tuple(x) for x in together}
        self.cut_after = [bytes(b for b in range(256) if (a, b) in apart) for a in range(256)]
        self.words = regex.compile(WORDS)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.assigned = {chr(c) for c in range(128)}
        self.id_texts = [str(i) for i in range(size)]
        bpe = self

        class Known(dict):
            def __missing__(self, word: str) -> list[int]:
                ids = bpe._word(word.encode())
                if len(word) <= KEPT_LENGTH:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self._known = Known()

    def fragments(self, word: bytes) -> Iterator[bytes]:
        start = 0
        for k in range(1, len(word)):
            if word[k] in self.cut_after[word[k - 1]]:
                yield word[start:k]
                start = k
        yield word[start:]

    def _word(self, word: bytes) -> list[int]:
        return [i for part in self.fragments(word) for i in self._merged(part)]

    def _merged(self, part: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in part]
        if len(ids) > SCANNED:
            return self._merged_by_heap(ids)
        get, none = self.merges.get, (sys.maxsize, 0)
        found = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, ahead, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or (j := after[k]) >= n or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = self.merges[a, b][1], False, after[j]
            if after[k] < n:
                ahead[after[k]] = k
            for x, y in ((ahead[k], k), (k, after[k])):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [i for i, there in zip(ids, alive, strict=True) if there]

    def _pieces(self, text: str) -> Iterator[list[int]]:
        """Lists of the ids of words, in blocks."""
        known = self._known
        for part in self.at_special.splititer(text) if self.at_special else (text,):
            if part in self.special:
                yield [self.special[part]]
            elif not part.isascii() and self._has_unassigned(part):
                yield [i for word in self._library_words(part) for i in known[word]]
            elif len(part) < LONG_TEXT:
                yield list(chain.from_iterable(map(known.__getitem__, self.words.findall(part))))
            else:
                words = (m[0] for m in self.words.finditer(part))
                while block := list(islice(words, BLOCK)):
                    yield list(chain.from_iterable(map(known.__getitem__, block)))

    def _has_unassigned(self, text: str) -> bool:
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return True
        self.assigned |= new
        return False

    def _library_words(self, text: str) -> list[str]:
        from tokenizers import pre_tokenizers

        return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def forget(self) -> None:
        """Drop the kept words, as a task ends; the worker and this object stay."""
        self._known.clear()
        released()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self._pieces(text or "")))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """n_tokens, sha256 of the ids joined by commas, sha256 of the ids decoded."""
        n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self._pieces(text or ""):
            if ids:
                ids_sha.update(b"," * bool(n) + ",".join(map(self.id_texts.__getitem__, ids)).encode())
                text_sha.update(decoder.decode(b"".join(map(self.token_bytes.__getitem__, ids))).encode())
                n += len(ids)
        text_sha.update(decoder.decode(b"", True).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


@lru_cache(maxsize=2)
def _built(vocabulary: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(vocabulary)


def read_vocabulary(path: str | None = None) -> str:
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id and ``ids``, an array of token ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    rows = _of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(vocabulary.value)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
        bpe.forget()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def with_ids(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, an array of token ids, in the place of the text (a column ``ids`` is replaced)."""
    small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    rest = [c for c in docs.columns if c not in (text_col, "ids")]
    rows = docs.select(*[docs[f"`{c}`"] for c in rest], docs[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(vocabulary.value)
        for b in batches:
            ids = pa.array([bpe.encode(t.as_py()) for t in b.column(len(rest))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*rest, "ids"])
        bpe.forget()

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest) + ", ids array<int>")


def decoded(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Per row: id and the text of its ``ids``; null ids decode to an empty text."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    rows = _of(rows, id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(vocabulary.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    rows = _of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(vocabulary.value)
        for b in batches:
            found = [bpe.digests(t.as_py()) for t in b.column(1)]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _of(docs: DataFrame, id_col: str, value_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("id"), docs[value_col].alias("value"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
