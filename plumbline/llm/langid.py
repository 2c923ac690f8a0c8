"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``DEPTH`` bytes with frozen
counts. A byte costs its code length in the longest context that has it;
each shorter context is reached by an escape (method C: as many escapes as
distinct bytes), with the bytes of the longer context excluded, and below the
empty context all bytes left over are alike. So the costs are exact code
lengths of a proper code. A text's language is the one with the shortest code
for the whole text; the score is its share when all languages are alike
beforehand, 2^-length normalised over the languages.

Training reads texts with a non-null language whose crc32(id) mod ``parts`` is
not 0. Of each language about ``sample`` documents are taken by a hash of the
id (a documented bound of the classifier); their whole texts count. Each language
has a tree of its own with every context of its sample, whatever the number of
the others; the model sent to the workers grows with the number of languages, by
the distinct grams of a sample. Only these are stored; the costs of a batch are
found for its distinct grams.

A text that no language explains is told by its *plain* length: what it takes in
the adaptive code of its bytes alone (Krichevsky-Trofimov, no context, nothing
learnt before). ``accepted`` keeps a text whose best language has a shorter code
than that; the rule has no threshold to set, and a few words are enough, since the
plain code has to learn each byte first. A text that is itself among those that a
language was learnt from counts as explained by it.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
without any training text so is every document; ties go to the language that
sorts first; repeated rows are predicted each; null ids are kept (they count as
held out or not by the crc32 of the empty text); an empty table gives an empty
result; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contexts
from .common import released, share_of, small_batches, staged, table

DEPTH = 3
#: Documents to learn each language from, about.
SAMPLE = 1000
#: Languages whose sampled parts are sent to every executor at most; beyond, texts are shuffled by language.
MOST_SENT = 10_000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def gram_counts(rows: DataFrame, depth: int) -> DataFrame:
    """lang, gram, n of rows with ``lang`` and ``text``."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[lang].append(contexts.lowered(text))
            for lang, texts in by.items():
                grams, n = contexts.counted(texts, depth, end=False)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Grams:
    """Code lengths in bits by language, from all contexts of each language."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], n: list[np.ndarray], depth: int = DEPTH):
        self.langs, self.depth = langs, depth
        self.levels = [[self._level(g, x, d) for d in range(depth + 1)] for g, x in zip(grams, n, strict=True)]

    @staticmethod
    def _level(grams: np.ndarray, n: np.ndarray, d: int) -> tuple[np.ndarray, ...]:
        """Contexts of one length: their grams and log2 of the counts; the contexts, and log2 of what is divided by there,
        of an escape's share, and with the bytes excluded, of what is divided by in the shorter context, and of its escape's share."""
        gram, at = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(gram))
        context, at = np.unique(gram >> 8, return_inverse=True)
        total, kinds = np.bincount(at, weights=count), np.bincount(at)
        out = gram, np.log2(count), context, np.log2(total + kinds), np.log2(total + kinds) - np.log2(kinds)
        if not d:
            return (*out, np.zeros(1), np.full(1, np.log2(max(256 - kinds[0], 1))))
        shorter, to = np.unique(grams & ((1 << 8 * d) - 1), return_inverse=True)
        count = np.bincount(to, weights=n, minlength=len(shorter))
        above, to = np.unique(shorter >> 8, return_inverse=True)
        up = np.searchsorted(above, context & ((1 << 8 * (d - 1)) - 1))
        new = np.bincount(to)[up] - kinds
        same = count[np.searchsorted(shorter, gram & ((1 << 8 * d) - 1))]
        room = np.bincount(to, weights=count)[up] - np.bincount(at, weights=same) + new
        with np.errstate(divide="ignore", invalid="ignore"):
            return (*out, np.where(new > 0, np.log2(room), 0), np.where(new > 0, np.log2(room / new), 0))

    def costs(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram's byte after its context."""
        out = np.zeros(len(grams))
        open_, node = np.arange(len(grams)), np.full(len(grams), -1)  # what isn't found yet, and its node in the longer context
        longer = None
        for d in range(self.depth, -1, -1):
            gram, logs, context, whole, escape, *_ = self.levels[lang][d]
            g = grams[open_] & ((1 << 8 * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(context, g >> 8), len(context) - 1)
            there = context[at] == g >> 8
            k = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
            seen = gram[k] == g
            first = there & (node < 0)
            out[open_] += np.where(first, np.where(seen, whole[at] - logs[k], escape[at]), 0)
            later = node >= 0
            if longer is not None:
                out[open_[later]] += np.where(seen[later], longer[5][node[later]] - logs[k[later]], longer[6][node[later]])
            longer, node = self.levels[lang][d], np.where(there, at, -1)[~seen]
            open_ = open_[~seen]
        out[open_] += longer[6][0]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and bits per byte."""
        bits = self.bits(texts)
        out = []
        for t, row in zip(texts, bits, strict=True):
            if t is None or not LETTER.search(t):
                out.append((UNKNOWN, 0.0, 0.0))
            else:
                best = int(np.argmin(row))
                out.append((self.langs[best], float(1 / np.exp2(row[best] - row).sum()), float(row[best]) / len(t.encode())))
        return out

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Code lengths of texts (rows) in languages (columns)."""
        out = np.zeros((len(texts), len(self.langs)))
        for start, sizes, found in contexts.coded([contexts.lowered(t) for t in texts], self.depth, end=False):
            if not len(found):
                continue
            grams = np.sort(found)
            grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]
            at = contexts.Finder(grams).find(found)
            stops = np.cumsum([0, *sizes])
            for k in range(len(self.langs)):
                sums = np.concatenate([np.zeros(1), np.cumsum(self.costs(k, grams)[at])])
                out[start : start + len(sizes), k] += sums[stops[1:]] - sums[stops[:-1]]
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 5, sample: int = SAMPLE) -> Grams | None:
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.filter(F.col("lang").isNotNull() & (share_of("id", parts) != 0))
    sizes = known.groupBy("lang").count()
    thin = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("part"))
    drawn = F.pmod(F.xxhash64(F.lit(0), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 20)) < F.col("part") * (1 << 20)
    thin = staged(thin, "lang-parts")
    few = thin.count() <= MOST_SENT
    chosen = known.filter(F.col("text").isNotNull()).join(F.broadcast(thin) if few else thin, "lang").filter(drawn)
    counts = gram_counts(chosen, DEPTH).toPandas()
    if counts.empty:
        return None
    groups = [(lang, g) for lang, g in counts.sort_values(["lang", "gram"]).groupby("lang")]
    return Grams([x for x, _ in groups], [g["gram"].to_numpy() for _, g in groups], [g["n"].to_numpy().astype(float) for _, g in groups])


def plain_bits(text: bytes) -> float:
    """The length of a text's bytes in the adaptive code without contexts: each byte begins with half a count."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=1)
    counts = counts[counts > 0].tolist()
    known = sum(math.lgamma(n + 0.5) for n in counts) - len(counts) * math.lgamma(0.5)
    return (math.lgamma(len(text) + 128) - math.lgamma(128) - known) / math.log(2)


FOUND = {"lang_pred": "string", "score": "double", "bits_per_byte": "double", "plain_bits_per_byte": "double"}


def _identified(docs: DataFrame, model: Grams | None, text_col: str) -> DataFrame:
    """The columns of ``docs`` by their places (c0, c1, ...), so that no name can clash, and those of ``FOUND``."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            got = model.predict(texts) if model else [(UNKNOWN, 0.0, 0.0)] * len(texts)
            plain = [plain_bits(x) / max(1, len(x)) for x in map(contexts.lowered, texts)]
            columns = [*zip(*got, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(columns[0], pa.string()), *(pa.array(x, pa.float64()) for x in (*columns[1:], plain))], names=[*b.schema.names, *FOUND])
        released()

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} {kind}" for c, kind in FOUND.items()])
    return rows.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Grams | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``bits_per_byte`` and ``plain_bits_per_byte`` added (columns of these names are replaced)."""
    own = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in FOUND]
    return _identified(docs, model, text_col).select(*own, *FOUND)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs``, in their own columns, without those that are ``und`` or that their best language explains no better than the plain code of their bytes."""
    found = _identified(docs, fit(docs, id_col, text_col, lang_col), text_col)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < F.col("plain_bits_per_byte")))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (share_of("doc_id", 5) == 0).alias("held_out"), "text")
    return identified(rows, fit(docs)).drop("text")
