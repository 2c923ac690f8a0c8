r"""Licence scans: canonical digests of entire texts, hash-joined to known ones.

A text is normalised: A-Z lower-cased, copyright lines dropped, equivalent
spellings replaced by one, punctuation turned into blanks and blanks merged.
The md5 of what is left is looked up among the digests of known licence texts,
which are normalised by the same expressions. The scanned units are the whole
text and each of its lines, since notices stand on lines of their own. Known
texts of several lines are looked up as runs of words from a line's start, too,
however the lines are broken: where the first ``ANCHOR`` words are those of known
texts, the digests of as many words as these have are compared. A run adds to
``licences`` alone; it counts as no line.

The known texts are a parameter (a table of ``spdx`` and ``text``); they are
sent to every executor while there are at most ``MOST_SENT`` of them; beyond,
those that occur are found among the distinct digests, and sent if these are few.

Only DataFrame functions are used. Defined cases: null and empty texts hold no
licence (a unit that normalises to nothing is not looked up); an empty table
gives an empty result; repeated rows are reported each; null ids are kept;
other columns are ignored; a line matched by several known texts reports each.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged, table, text_or_empty

# Public licence notices by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under Creative Commons Attribution-NonCommercial 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
# Spellings that count as one, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("https://", "http://"),
    ("v. ", "version "),
]
COPYRIGHT_LINE = r"^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Known texts that are sent to every executor at most.
MOST_SENT = 100_000
#: Words by which runs are found.
ANCHOR = 4
#: Full licence texts and headers of several lines, ``spdx.txt`` or ``spdx+which.txt``.
FULL_TEXTS = Path(__file__).resolve().parent / "known"
LAST_TERM = "END OF TERMS AND CONDITIONS"


def canonical(text: Column) -> Column:
    text = F.regexp_replace(F.translate(text, UPPER, LOWER), "(?md)" + COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def known_digests(known: DataFrame) -> DataFrame:
    norm = known.select("spdx", canonical(text_or_empty("text")).alias("norm")).filter("norm <> ''")
    return norm.select(F.md5("norm").alias("digest"), "spdx").distinct()


def default_known(spark: SparkSession) -> DataFrame:
    texts = [(f.stem.split("+")[0], f.read_text()) for f in sorted(FULL_TEXTS.glob("*.txt"))]
    # licences are given with what follows their terms, or without
    terms = [(spdx, text[: text.index(LAST_TERM) + len(LAST_TERM)]) for spdx, text in texts if LAST_TERM in text]
    return spark.createDataFrame(NOTICES + texts + terms, "spdx string, text string")


def _words(text: str) -> Column:
    """The words of a text's canonical lines; the first one of each line but the first has a line break before it."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), canonical), lambda x: x != "")
    return F.split(F.array_join(lines, " \n"), " ")


def _run(words: str, start: Column, size: Column) -> Column:
    return F.translate(F.array_join(F.slice(words, start, size), " "), "\n", "")


def runs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rid, spdx: known texts of several lines that start at a line of a text of ``rows`` (rid, t)."""
    several = known.select("spdx", text_or_empty("text").alias("t")).select("spdx", _words("t").alias("words"))
    several = several.filter(F.exists("words", lambda w: F.startswith(w, F.lit("\n")))).withColumn("size", F.size("words"))
    several = several.withColumn("anchor_size", F.least("size", F.lit(ANCHOR)))
    several = several.select("spdx", "size", "anchor_size", _run("words", F.lit(1), F.col("anchor_size")).alias("anchor"), F.md5(_run("words", F.lit(1), F.col("size"))).alias("digest"))
    several = staged(several.distinct(), "licence-runs")
    few = several.count() <= MOST_SENT
    sent = lambda df: F.broadcast(df) if few else df
    sizes = sorted(x[0] for x in several.select("anchor_size").distinct().collect())
    if not sizes:
        return several.select(F.lit(0).cast("long").alias("rid"), "spdx")
    words = rows.select("rid", _words("t").alias("words"))
    at_line = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i == 1) | F.startswith(F.element_at("words", i), F.lit("\n")))
    anchors = F.flatten(F.transform(at_line, lambda i: F.array(*[F.struct(i.alias("start"), _run("words", i, F.lit(k)).alias("anchor")) for k in sizes])))
    starts = words.select("rid", F.explode(anchors).alias("a")).select("rid", "a.start", "a.anchor")
    hits = starts.join(sent(several.select("anchor", "size").distinct()), "anchor")
    hits = staged(hits.select("rid", "start", "size").distinct(), "licence-starts")
    near = hits.count() <= MOST_SENT
    there = rows.join(F.broadcast(hits.select("rid").distinct()) if near else hits.select("rid").distinct(), "rid", "left_semi")
    there = there.select("rid", _words("t").alias("words")).join(F.broadcast(hits) if near else hits, "rid")
    digests = there.select("rid", F.md5(_run("words", F.col("start"), F.col("size"))).alias("digest")).distinct()
    return digests.join(sent(several.select("digest", "spdx").distinct()), "digest").select("rid", "spdx").distinct()


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, whole_licence, n_licence_lines, licences (sorted, comma-joined), canonical_md5 of the whole text."""
    digests = known_digests(known)
    rows = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")), "licence-rows")
    # the whole text is unit 0; a text of a single line has no other unit
    parts = rows.withColumn("lines", F.split("t", "\n", -1))
    units = F.posexplode(F.when(F.size("lines") > 1, F.concat(F.array("t"), F.col("lines"))).otherwise(F.array("t")))
    units = parts.select("rid", "id", F.size("lines").alias("n_lines"), units.alias("unit", "part"))
    units = units.withColumn("norm", canonical(F.col("part"))).withColumn("digest", F.when(F.col("norm") != "", F.md5("norm")))
    units = units.select("rid", "id", "n_lines", "unit", "digest")
    if known.count() > MOST_SENT:
        # only those that occur, found among distinct digests, so that a line that many texts have is one row of a shuffle
        digests = staged(units.filter(F.col("digest").isNotNull()).select("digest").distinct().join(digests, "digest"), "licence-digests")
    few = digests.count() <= MOST_SENT
    # units that normalise to nothing have keys of their own, which meet nothing
    keyed = units.withColumn("key", F.coalesce("digest", F.concat(F.lit("-"), F.col("rid").cast("string"))))
    own = digests.withColumnRenamed("digest", "key")
    found = keyed.join(F.broadcast(own) if few else own, "key", "left").drop("key")
    found = found.unionByName(runs(rows, known), allowMissingColumns=True)
    is_line = (F.col("unit") > 0) | (F.col("n_lines") == 1)
    return found.groupBy("rid").agg(
        F.first("id", ignorenulls=True).alias("id"),
        F.min(F.when(F.col("unit") == 0, F.col("spdx"))).alias("whole_licence"),
        F.sum(F.when(is_line & F.col("spdx").isNotNull(), 1).otherwise(0)).alias("n_licence_lines"),
        F.array_join(F.array_sort(F.collect_set("spdx")), ",").alias("licences"),
        F.max(F.when(F.col("unit") == 0, F.coalesce("digest", F.md5(F.lit(""))))).alias("canonical_md5"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"), default_known(spark))
    return found.select(F.col("id").alias("doc_id"), "whole_licence", "n_licence_lines", "licences", "canonical_md5")


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT_LINE}', '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'), ' ')"


OP3_SQL = f"""
WITH known AS (
  SELECT DISTINCT md5({_sql_canonical("text")}) AS digest, spdx
  FROM (VALUES {", ".join(f"('{s}', '{t}')" for s, t in NOTICES)}) v(spdx, text)),
whole AS (
  SELECT doc_id, coalesce(text, '') AS t, {_sql_canonical("coalesce(text, '')")} AS norm FROM documents),
lines AS (
  SELECT doc_id, {_sql_canonical("part")} AS norm
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS part FROM whole)),
line_hits AS (
  SELECT doc_id, spdx FROM lines JOIN known ON norm <> '' AND md5(norm) = digest),
whole_hits AS (
  SELECT doc_id, min(spdx) AS spdx FROM whole JOIN known ON norm <> '' AND md5(norm) = digest GROUP BY doc_id),
hits AS (
  SELECT doc_id, count(*) AS n FROM line_hits GROUP BY doc_id),
names AS (
  SELECT doc_id, string_agg(spdx, ',' ORDER BY spdx) AS licences
  FROM (SELECT doc_id, spdx FROM line_hits UNION SELECT doc_id, spdx FROM whole_hits) GROUP BY doc_id)
SELECT w.doc_id, wh.spdx AS whole_licence, coalesce(h.n, 0) AS n_licence_lines,
       coalesce(n.licences, '') AS licences, md5(w.norm) AS canonical_md5
FROM whole w LEFT JOIN whole_hits wh USING (doc_id) LEFT JOIN hits h USING (doc_id) LEFT JOIN names n USING (doc_id)
"""
