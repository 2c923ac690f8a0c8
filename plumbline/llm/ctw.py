r"""Language-model scoring by context-tree weighting, beside a word-count base.

The model. A byte is eight binary decisions, each in one of 255 places of a
binary tree over the bytes; each place has a tree of byte contexts of 0 to
``DEPTH`` bytes. In every node the Krichevsky-Trofimov estimate of the node's
own counts is mixed with the product of its children, half and half, so that
all depths and all prunings of the tree take part by their weight under the
training texts. The counts are frozen after training: a byte's code length is
that of the mixture's next decisions given the training texts. Texts are UTF-8
bytes with A-Z lower-cased, after edges and up to an edge (0xFF) that ends them.

Training counts all grams (a context of full depth and its byte) of all training
texts. Each context that occurs has a node, so the model grows with the corpus;
no worker and not the driver has it as a whole. Grams are dealt to parts by
the ``SPLIT`` bytes before the byte, so that a part has whole subtrees; what the
subtrees weigh is summed for the shorter contexts (at most 256^2, on the driver),
and these go to the workers. The distinct grams of about ``CHUNK`` bytes of text
are looked up together: they go to the parts, and their code lengths come back
to the texts. The end of a text is part of the score.

The base is the sum over words ``[^\x20\x09-\x0D]+`` and one end of
log10((c+1)/(N+1*(V+1))) with counts of the training documents. Words that make
up one ``SENT``-th of the tokens (at most ``SENT`` words) go to the workers; all
others are counted per document, joined to the table of word counts by a
shuffle, and summed. A word over ``LONG_WORD`` bytes goes by a digest of 128 bits.

Defined cases: a null text is empty (its only token is the end); repeated rows
are scored each; null ids are kept and count by the crc32 of the empty text;
an empty table gives an empty result; without training documents N, V and all
counts are 0 and each decision costs one bit; other columns are ignored; texts
of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contexts
from .common import share_of, small_batches, staged, table

DEPTH, SPLIT = 5, 3
#: Distinct grams of a part, about; parts at least; bytes of text whose grams are looked up together.
PART, LEAST_PARTS, CHUNK = 100_000, 32, 8 << 20
#: Words sent to the workers at most; bytes from which a word goes by its digest.
SENT, LONG_WORD = 1 << 18, 64
#: Grams and words that a worker gathers before it hands on their counts.
GATHERED = 2_000_000


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2, by Stirling's series from x + 8 on."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    x = x + 8
    series = 1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x**2)) / x**2) / x**2
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series / x - np.log(shift)


def _ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - _ln_gamma(zeros + ones + 1) - math.log(math.pi)


def _key(word: bytes) -> bytes:
    """A word by which it is counted: itself, or a digest behind a blank if it is long, so that rows and what is sent stay small."""
    return word if len(word) <= LONG_WORD else b" " + hashlib.blake2b(word, digest_size=16).digest()


def _words(text: bytes) -> list[bytes]:
    words = text.split()
    return [*map(_key, words)] if max(map(len, words), default=0) > LONG_WORD else words


def gathered(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """word, gram, n: over all rows the counts of words (the empty one is the end) and of grams."""
    small_batches(docs.sparkSession)

    def rows(grams: tuple[np.ndarray, np.ndarray], words: Counter) -> Iterator[pa.RecordBatch]:
        gram, n = grams
        yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.binary()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["word", "gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            texts = [contexts.lowered(t) for t in b.column(0).to_pylist()]
            for t in texts:
                words.update(_words(t))
            words[b""] += len(texts)
            start = 0
            while start < len(texts):
                stop, size = start + 1, len(texts[start])
                while stop < len(texts) and size + len(texts[stop]) <= contexts.TOGETHER:
                    size += len(texts[stop])
                    stop += 1
                parts.append(contexts.counted(texts[start:stop], depth, end=True))
                start = stop
            if sum(len(g) for g, _ in parts) + len(words) > GATHERED:
                parts = [_added(parts)]
                if len(parts[0][0]) + len(words) > GATHERED // 2:
                    yield from rows(parts[0], words)
                    parts, words = [], Counter()
        if words:
            yield from rows(_added(parts), words)

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, gram long, n long")
    return counts.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.concatenate([g for g, _ in parts])
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(n, first)


#: Of contexts of one length: (context, place) as sorted numbers, zeros, ones, and the weight of the own estimate.
Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _decided(byte: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The place and the bit of a byte's decision."""
    return (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1


def subtrees(grams: np.ndarray, n: np.ndarray, top: int, depth: int, below: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[dict[int, Places], tuple[np.ndarray, np.ndarray]]:
    """By length from ``depth`` to ``top`` the places of all contexts that occur; and, for the next shorter ones, (context, place) and ln weight of each child.

    ``below``: the same of the contexts longer than ``depth``, if there are any.
    """
    out = {}
    for d in range(depth, top - 1, -1):
        gram, at = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        times = np.tile(np.bincount(at, weights=n, minlength=len(gram)), 8)
        steps = [_decided(gram & 255, k) for k in range(8)]
        key, at = np.unique(np.concatenate([gram >> 8 << 8 | place for place, _ in steps]), return_inverse=True)
        ones = np.bincount(at, weights=times * np.concatenate([bit for _, bit in steps]), minlength=len(key))
        zeros = np.bincount(at, weights=times, minlength=len(key)) - ones
        weighted, stop = _ln_kt(zeros, ones), np.ones(len(key))
        if below is not None:
            children = np.bincount(np.searchsorted(key, below[0]), weights=below[1], minlength=len(key))
            alone = math.log(0.5) + weighted
            weighted = np.logaddexp(alone, math.log(0.5) + children)
            stop = np.exp(alone - weighted)
        out[d] = (key, zeros, ones, stop)
        below = (key & ((1 << 8 * max(d, 1)) - 1), weighted)
    return out, below


def code_lengths(levels: dict[int, Places], grams: np.ndarray, depth: int) -> np.ndarray:
    """Bits of each gram's byte after its context."""
    bits = np.zeros(len(grams))
    for k in range(8):
        place, bit = _decided(grams & 255, k)
        given, left = np.zeros(len(grams)), np.ones(len(grams))
        for d in range(depth + 1):
            key, zeros, ones, stop = levels[d]
            look = ((grams >> 8) & ((1 << 8 * d) - 1)) << 8 | place
            at = np.minimum(np.searchsorted(key, look), len(key) - 1)
            there = key[at] == look if len(key) else np.zeros(len(grams), bool)
            c, total, own = np.zeros(len(grams)), np.zeros(len(grams)), np.full(len(grams), 0.5 if d < depth else 1.0)
            at = at[there]
            c[there], total[there], own[there] = np.where(bit[there] > 0, ones[at], zeros[at]), zeros[at] + ones[at], stop[at]
            given += left * own * (c + 0.5) / (total + 1)
            left *= 1 - own
        bits -= np.log2(given)
    return bits


def _part_of(gram, parts: int):
    """The part of a gram (an array or a column), by the bytes of its context that are nearest."""
    if isinstance(gram, np.ndarray):
        return (((gram >> 8) & ((1 << 8 * SPLIT) - 1)) * 0x9E3779B1 % (1 << 32) >> 8) % parts
    mixed = (F.shiftright(gram, 8).bitwiseAND((1 << 8 * SPLIT) - 1) * F.lit(0x9E3779B1)) % F.lit(1 << 32)
    return F.shiftright(mixed, 8) % F.lit(parts)


def _packed(x: np.ndarray) -> bytes:
    """Numbers by places of their bytes, compressed; whole numbers, which are sorted, as differences."""
    steps = np.diff(x, prepend=0) if x.dtype == np.int64 else x
    raw = np.ascontiguousarray(steps).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type = np.int64) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    x = np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()
    return np.cumsum(x) if kind is np.int64 else x


def _together(arrays: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def fit(counts: DataFrame) -> tuple[DataFrame, int, dict[int, Places]]:
    """From a table of ``gathered`` counts: the parts with their grams, the number of parts, and the places of contexts shorter than ``SPLIT``."""
    grams = counts.filter(F.col("gram").isNotNull()).select("gram", "n")
    parts = max(LEAST_PARTS, -(-grams.count() // PART))

    def packed(t: pa.Table) -> pa.Table:
        gram, n = t["gram"].to_numpy(), t["n"].to_numpy()
        order = np.argsort(gram)
        _, (root, weight) = subtrees(gram[order], n[order].astype(float), SPLIT, DEPTH)
        key, at = np.unique(root, return_inverse=True)
        weight = np.bincount(at, weights=weight, minlength=len(key))
        return pa.table({"part": t["part"][:1], "grams": [_packed(gram[order])], "n": [n[order].tobytes()], "roots": [_packed(key)], "weights": [weight.tobytes()]})

    dealt = grams.withColumn("part", _part_of(F.col("gram"), parts)).groupBy("part")
    dealt = staged(dealt.applyInArrow(packed, "part long, grams binary, n binary, roots binary, weights binary"), "ctw-parts")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, weight in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(key)), pa.array(np.frombuffer(weight))], names=["place", "weight"])

    below = dealt.select("roots", "weights").mapInArrow(roots, "place long, weight double").groupBy("place").agg(F.sum("weight").alias("weight")).toPandas()
    short = grams.groupBy(F.col("gram").bitwiseAND((1 << 8 * SPLIT) - 1).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    top, _ = subtrees(short["gram"].to_numpy(np.int64), short["n"].to_numpy(float), 0, SPLIT - 1, (below["place"].to_numpy(np.int64), below["weight"].to_numpy(float)))
    return dealt, parts, top


def chunked(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, id, text) with ``chunk``, drawn by a hash of id and text; about CHUNK bytes have the same."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    drawn = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text")
    return rows.select(F.pmod(drawn, F.lit(1 + size // CHUNK)).alias("chunk"), "rid", "id", "text")


def asked(texts: DataFrame, parts: int) -> DataFrame:
    """chunk, part, grams: the distinct grams of each chunk by part."""

    def run(b: pa.Table) -> pa.Table:
        found = [np.unique(grams) for _, _, grams in contexts.coded([contexts.lowered(t) for t in b["text"].to_pylist()], DEPTH, end=True)]
        every = np.unique(np.concatenate(found))
        part = _part_of(every, parts)
        order = np.argsort(part, kind="stable")
        ids, first = np.unique(part[order], return_index=True)
        return pa.table({"chunk": pa.array([b["chunk"][0].as_py()] * len(ids), pa.int64()), "part": ids, "grams": pa.array([_packed(x) for x in np.split(every[order], first[1:])], pa.binary())})

    return texts.groupBy("chunk").applyInArrow(run, "chunk long, part long, grams binary")


def answered(questions: DataFrame, dealt: DataFrame, top: dict[int, Places]) -> DataFrame:
    """chunk, grams, bits: the code lengths of the grams that the chunks ask for."""
    shared = questions.sparkSession.sparkContext.broadcast(top)

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        grams = _together([_unpacked(x) for x in own["grams"].to_pylist()])
        n = _together([np.frombuffer(x, np.int64) for x in own["n"].to_pylist()])
        levels, _ = subtrees(grams, n.astype(float), SPLIT, DEPTH)
        blobs = asked["grams"].to_pylist()
        wanted = [_unpacked(x) for x in blobs]
        every, at = np.unique(_together(wanted), return_inverse=True)
        bits = np.concatenate([code_lengths(shared.value | levels, some, DEPTH) for some in np.array_split(every, 1 + len(every) // 100_000)])
        bits = np.split(bits.astype(np.float32)[at], np.cumsum([len(x) for x in wanted])[:-1]) if wanted else []
        return pa.table({"chunk": asked["chunk"], "grams": pa.array(blobs, pa.binary()), "bits": pa.array([_packed(x) for x in bits], pa.binary())})

    return dealt.select("part", "grams", "n").groupBy("part").cogroup(questions.groupBy("part")).applyInArrow(run, "chunk long, grams binary, bits binary")


def _summed(texts: list[bytes], grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of each text, from those of all its grams."""
    out, places = np.zeros(len(texts)), contexts.Finder(grams)
    for start, sizes, found in contexts.coded(texts, DEPTH, end=True):
        each = bits[places.find(found)]
        out[start : start + len(sizes)] += np.add.reduceat(each, np.cumsum([0, *sizes[:-1]]), dtype=np.float64)
    return out


def scored(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    counts = staged(gathered(train, text_col, DEPTH), "ctw-counts")
    dealt, parts, top = fit(counts)
    words = counts.filter(F.col("word").isNotNull()).select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = F.col("n") * SENT >= total
    head = words.filter(often).toPandas()
    shared = spark.sparkContext.broadcast({bytes(w): math.log10(n + 1) for w, n in zip(head["word"], head["n"], strict=True)})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"rid long, id {rows.schema['id'].dataType.simpleString()}, word binary, n long, n_tokens long, n_known long, logs double, score double, bits_per_byte double"
    texts = chunked(rows)
    answers = answered(asked(texts, parts), dealt, top)

    def run(b: pa.Table, answers: pa.Table) -> pa.Table:
        """A row for each document, and one for each of its other words."""
        logs = shared.value
        grams = _together([_unpacked(x) for x in answers["grams"].to_pylist()])
        lengths = _together([_unpacked(x, np.float32) for x in answers["bits"].to_pylist()], np.float32)
        texts = [contexts.lowered(t) for t in b["text"].to_pylist()]
        bits = _summed(texts, grams, lengths)
        rid, n_tokens, n_known, sums = b["rid"].to_pylist(), [], [], []
        rare_rid, rare_word, rare_n = [], [], []
        for r, t in zip(rid, texts, strict=True):
            tokens = Counter(_words(t))
            tokens[b""] = 1
            n, total = 0, 0.0
            for w, k in tokens.items():
                if (x := logs.get(w)) is not None:
                    n += k
                    total += k * x
                else:
                    rare_rid.append(r)
                    rare_word.append(w)
                    rare_n.append(k)
            n_tokens.append(tokens.total())
            n_known.append(n)
            sums.append(total)
        m, ids = len(rare_rid), b["id"].combine_chunks()
        none = lambda size, kind: pa.nulls(size, kind)
        own = [b["rid"].combine_chunks(), ids, pa.array([b" " + r.to_bytes(8, "big") for r in rid], pa.binary()), none(len(rid), pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(-bits * math.log10(2)), pa.array([x / max(1, len(t)) for x, t in zip(bits, texts, strict=True)], pa.float64())]
        rare = [pa.array(rare_rid, pa.int64()), none(m, ids.type), pa.array(rare_word, pa.binary()), pa.array(rare_n, pa.int64()), *(none(m, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
        return pa.concat_tables([pa.Table.from_arrays(x, names=list(SCORED)) for x in (own, rare)])

    # a document's own row has a key that is no word and unlike any other, and so meets nothing
    out = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema).join(words.filter(~often).withColumnRenamed("n", "c"), "word", "left")
    room = math.log10(total + distinct + 1)
    summed = out.groupBy("rid").agg(
        F.max("id").alias("id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        (F.max("logs") + F.coalesce(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)), F.lit(0.0))).alias("logs"),
        F.max("score").alias("score"),
        F.max("bits_per_byte").alias("bits_per_byte"),
    )
    return summed.select("id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * room).alias("base_score"), "score", "bits_per_byte")


SCORED = ("rid", "id", "word", "n", "n_tokens", "n_known", "logs", "score", "bits_per_byte")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = share_of("doc_id", 7) == 2
    found = scored(docs, docs.filter(~held_out))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", (share_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
