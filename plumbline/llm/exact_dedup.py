"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``; a null text counts as empty. Of equal texts the row with
the most code points stays, then the smallest id (a null id comes last).

Rows of a group meet as partial aggregates, so a group that holds a third of
all rows costs each task one row. Bytes are compared only for hashes that occur
more than once: those texts are grouped by (hash, text itself), and a hash
under which several texts turn up is split by text from then on. Texts that very
many rows have are met where they are and pre-aggregated, at any size.

Defined cases: an empty table gives an empty result; empty and null texts form
one group; repeated rows (same id, same text) are one document, each of its
rows is marked like the others; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, staged, table, text_or_empty

#: Hashes of repeated texts to send to every executor at most (16 bytes each); beyond, rows are shuffled to those that occur less than ``OFTEN`` times.
MOST_SENT, OFTEN = 1_000_000, 10_000


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """Per row: id, n_chars, h (128-bit hash), text_sha256, variant, keep_id, group_size, kept.

    ``variant`` is empty but for hashes that several texts share, where it is
    the normalised text. ``digest`` can be replaced to test such collisions.
    """
    norm = docs.select(F.col(id_col).alias("id"), F.length(text_or_empty(text_col)).alias("n_chars"), without_spaces(text_or_empty(text_col)).alias("norm"))
    full = norm.withColumn("h", digest(F.col("norm")))
    rows = staged(full.select("id", "n_chars", "h", F.sha2("norm", 256).alias("text_sha256")), "dedup-rows")

    repeated = staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dedup-repeated")
    texts = of_repeated(full.select("h", "norm"), repeated)
    shared = staged(texts.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h"), "dedup-shared")
    if shared.isEmpty():
        rows = rows.withColumn("variant", F.lit(""))
    else:
        hit = full.join(shared.withColumn("hit", F.lit(True)), "h", "left")
        rows = staged(hit.select("id", "n_chars", "h", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("hit"), F.col("norm")).otherwise("").alias("variant")), "dedup-rows")

    best = F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), F.col("id").alias("id")))
    groups = rows.groupBy("h", "variant").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = staged(groups.select("h", "variant", F.col("best.id").alias("keep"), "group_size"), "dedup-groups")
    joined = rows.join(groups, ["h", "variant"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select("id", F.col("n_chars").cast("long").alias("n_chars"), "h", "text_sha256", "variant", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"))


def of_repeated(full: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows whose hash is in ``repeated`` (h, n), without a shuffle by a hash that very many rows have.

    If there are too many hashes to send, those of often repeated texts are sent, being few
    (at most one in ``OFTEN`` rows), and rows are shuffled to the others.
    """
    if repeated.count() <= MOST_SENT:
        return full.join(F.broadcast(repeated.select("h")), "h", "left_semi")
    often, others = (repeated.filter(x).select("h") for x in (F.col("n") >= OFTEN, F.col("n") < OFTEN))
    sent = F.broadcast(often) if often.count() <= MOST_SENT else often
    return full.join(sent, "h", "left_semi").unionByName(full.join(sent, "h", "left_anti").join(others, "h", "left_semi"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts, in its own columns."""
    stay = staged(exact_classes(docs, id_col, text_col).filter("kept").select("h", "variant", F.col("id").alias("stay_id")), "dedup-stay")
    again = not stay.groupBy("h", "variant").count().filter("count > 1").isEmpty()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    norm = without_spaces(text_or_empty(text_col))
    rows = docs.select(own, F.col(id_col).alias("own_id"), norm.alias("norm")).withColumn("own_h", md5_128(F.col("norm")))
    meets = (F.col("own_h") == F.col("h")) & F.col("own_id").eqNullSafe(F.col("stay_id")) & ((F.col("variant") == "") | (F.col("variant") == F.col("norm")))
    kept = rows.join(stay.distinct() if again else stay, meets, "left_semi")
    if again:  # repeated rows of one document: leave one of them
        kept = kept.dropDuplicates(["own_h", "own_id", "norm"])
    return kept.select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
