r"""Personal data: fixed patterns, then terms that disclose what the patterns found.

Base spans, leftmost and non-overlapping per kind, as code point offsets with
exclusive end:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, parts at most 255
* card ``[0-9]([ -]?[0-9])+``, 13 to 19 digits that pass Luhn
* phone ``\+[0-9][ ().0-9-]+[0-9]``, 9 to 15 digits

The patterns below find the same matches in linear time: quantifiers that never
need to give back are possessive, and a match doesn't start where an earlier
start of the same run has failed already.

The information-theoretic step takes as entities each value found and what it
shares with others: an email's domain, the first three parts of an ip, the first
six digits of a card, the digits of a phone but for the last four. So values that
occur once still count together. The terms t are the words of two letters or more
within ``NEAR`` code points of a value. Over all documents it counts how many hold
t, how many e, and how many t near e, and takes as disclosure the share of the
entity's information that the term gives away,
PMI(t; e) / IC(e) = ln(n_te N / (n_t n_e)) / ln(N / n_e). A term is telling when its
disclosure of some entity reaches ``disclosure`` and the two were seen in at least
``support`` documents and as many different contexts (copies of one passage are one
context; what was seen less often is no estimate). A telling term discloses its entity wherever it
stands, so each of its occurrences in all texts becomes a span of kind ``term``,
with or without the value beside it.

The work grows with the text, not with the square of its matches: places of
matches are summed in blocks of ``BLOCK`` matches, windows are cut from pieces of
``PIECE`` code points, and terms that overlap a base span are found by one pass
over both in the order of their places.

Only DataFrame functions are used. Defined cases: a null text is empty and has
no spans; an empty table gives an empty result; repeated rows are reported
each; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TERM = r"\p{L}{2,}"
#: Code points on either side of a value that count as near it.
NEAR = 80

SPAN = "struct<start:int,end:int,value:string>"
#: Terms, paired or telling, to send to every executor at most; beyond, the words of all texts are shuffled.
MOST_SENT = 100_000
#: Matches whose places are summed together; code points of the pieces that windows are cut from.
BLOCK, PIECE = 100, 1024
#: Buckets of words, so that a word is looked up in a bounded list however many terms its text holds.
BUCKETS = 256


def matches(text: str, pattern: str, wanted: str = "true") -> str:
    """SQL: the matches x of a pattern in a text that are ``wanted``, as an array of SPAN.

    The pieces between the matches and the matches themselves, laid end to end,
    give the offsets.
    """
    quoted = "r'" + pattern + "'"
    none = f"cast(array() AS array<{SPAN}>)"
    pairs = f"zip_with(split({text}, {quoted}, -1), regexp_extract_all({text}, {quoted}, 0), (p, m) -> struct(length(p) AS gap, m AS value))"
    step = f"named_struct('at', acc.at + x.gap + coalesce(length(x.value), 0), 'found', CASE WHEN x.value IS NOT NULL AND {wanted} THEN array_append(acc.found, named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + length(x.value), 'value', x.value)) ELSE acc.found END)"
    block = f"aggregate(slice(pairs, k, {BLOCK}), named_struct('at', whole.at, 'found', {none}), (acc, x) -> {step}, acc -> named_struct('at', acc.at, 'blocks', array_append(whole.blocks, acc.found)))"
    blocks = f"aggregate(sequence(1, size(pairs), {BLOCK}), named_struct('at', 0, 'blocks', cast(array() AS array<array<{SPAN}>>)), (whole, k) -> {block}, whole -> flatten(whole.blocks))"
    # as the only element of an array the pairs have a name, and are found once
    return f"CASE WHEN {text} RLIKE {quoted} THEN element_at(transform(array({pairs}), pairs -> {blocks}), 1) ELSE {none} END"


def between(start: str, end: str) -> str:
    """SQL: the code points of a text from ``start`` up to ``end``, from its ``pieces``."""
    first, last = f"int(({start}) div {PIECE})", f"int(({end}) div {PIECE})"
    return f"substring(array_join(slice(pieces, {first} + 1, {last} - {first} + 1), ''), ({start}) % {PIECE} + 1, ({end}) - ({start}))"


def beside(start: str, size: str | int) -> str:
    """SQL: ``size`` code points (``PIECE`` at most, or up to the end) from ``start`` on, from the two ``pieces`` that they are in."""
    first = f"int(({start}) div {PIECE})"
    return f"substring(concat(coalesce(get(pieces, {first}), ''), coalesce(get(pieces, {first} + 1), '')), ({start}) % {PIECE} + 1, {size})"


def in_pieces(rows: DataFrame, text: str, when: str) -> DataFrame:
    """``pieces``: the text in pieces of ``PIECE`` code points, for rows where they are wanted."""
    return rows.withColumn("pieces", F.expr(f"CASE WHEN {when} THEN regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0) END"))


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


HOLDS = {
    "email": "true",
    "ip": f"x.value RLIKE r'^{BYTE_PART}(?:[.]{BYTE_PART}){{3}}$'",
    "card": f"length({_digits('x.value')}) BETWEEN 13 AND 19 AND luhn_check({_digits('x.value')})",
    "phone": f"length({_digits('x.value')}) BETWEEN 9 AND 15",
}
#: Cheap tests that a text must pass to hold a match at all.
MAY = {"email": "contains(t, '@')", "ip": "contains(t, '.')", "card": "true", "phone": "contains(t, '+')"}


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, t (the text) and, by kind, an array of spans that hold."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    for kind in KINDS:
        every = f"CASE WHEN {MAY[kind]} THEN {matches('t', PATTERNS[kind])} ELSE cast(array() AS array<{SPAN}>) END"
        rows = rows.withColumn(kind, F.expr(f"filter({every}, x -> {HOLDS[kind]})"))
    return rows


#: By kind what a value shares with others of its domain or block of numbers.
BLOCKS = {
    "email": "regexp_extract(lower(s.value), '@.*$', 0)",
    "ip": "regexp_replace(s.value, '[0-9]+$', '*')",
    "card": f"concat(left({_digits('s.value')}, 6), '*')",
    "phone": f"concat(left({_digits('s.value')}, length({_digits('s.value')}) - 4), '*')",
}


def _bucket(term: str) -> str:
    return f"pmod(xxhash64({term}), {BUCKETS})"


def _listed(spans: str | Column, kind: str) -> Column:
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.8, support: int = 3) -> DataFrame:
    """Per row: rid (a number of the row), id, the base spans by kind, and ``term`` spans."""
    shared = {k: f"transform({k}, s -> struct(s.start, s.end, array(concat('{k}:', lower(s.value)), concat('{k}:', {BLOCKS[k]})) AS entities))" for k in KINDS}
    first = f"greatest(s.start - {NEAR}, 0)"
    window = f"concat({beside(first, f'least(s.start, {NEAR})')}, repeat(' ', s.end - s.start), {beside('s.end', NEAR)})"
    near = F.expr(f"transform(every, s -> struct(s.entities, {first} AS at, {window} AS around, s.end AS stop))")
    rows = base_spans(docs, id_col, text_col).withColumn("every", F.concat(*[F.expr(x) for x in shared.values()]))
    rows = in_pieces(rows, "t", "size(every) > 0").withColumn("near", F.when(F.size("every") > 0, near))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "t", F.length("t").alias("n"), *KINDS, "near"), "pii-base")

    mentions = rows.filter(F.size("near") > 0).select("rid", "n", F.explode("near").alias("m")).select("rid", "m.*", (F.col("m.stop") + NEAR >= F.col("n")).alias("last"))
    # a word that the window cuts off isn't a term
    whole = "filter({0}, x -> (at = 0 OR x.start > 0) AND (last OR x.end < length(around)))".format(matches("around", TERM))
    terms = mentions.select("rid", "entities", F.xxhash64("around").alias("context"), "at", F.explode(F.expr(whole)).alias("x"))
    terms = terms.select("rid", "entities", "context", F.lower("x.value").alias("term"), (F.col("at") + F.col("x.start")).alias("start"), (F.col("at") + F.col("x.end")).alias("end"))
    terms = staged(_clear(terms, rows).select("rid", F.explode("entities").alias("entity"), "context", "term"), "pii-terms")

    seen = terms.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= support)
    both = terms.select("entity", "term", "rid").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= support)
    pairs = staged(both.join(seen, ["entity", "term"]), "pii-pairs")
    n_e = mentions.select(F.explode("entities").alias("entity"), "rid").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))

    words = rows.select("rid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    paired = staged(pairs.select("term").distinct(), "pii-paired")
    sought = words.join(F.broadcast(paired), "term", "left_semi") if paired.count() <= MOST_SENT else words
    n_t = sought.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = rows.count()
    share = F.log(F.col("n_te") * float(total) / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    telling = pairs.join(n_e, "entity").join(n_t, "term").filter(F.col("n_e") < total).withColumn("disclosure", share)
    telling = staged(telling.filter(F.col("disclosure") >= disclosure).select("term").distinct(), "pii-telling")

    # which texts hold telling terms, and only then where; of other words most are left out by their buckets
    holds = staged(words.join(F.broadcast(telling) if telling.count() <= MOST_SENT else telling, "term", "left_semi"), "pii-holds")
    held = holds.groupBy("rid").agg(F.collect_set(F.expr(_bucket("term"))).alias("buckets"))
    places = rows.join(held, "rid").select("rid", F.explode(F.expr(matches("t", TERM, f"array_contains(buckets, {_bucket('lower(x.value)')})"))).alias("x"))
    places = places.select("rid", F.lower("x.value").alias("term"), F.col("x.start").alias("start"), F.col("x.end").alias("end")).join(holds, ["rid", "term"], "left_semi")
    flagged = _clear(places, rows).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("term").alias("value")))).alias("found"))
    joined = rows.join(flagged, "rid", "left")
    return joined.select("rid", "id", *KINDS, F.coalesce("found", F.expr(f"cast(array() AS array<{SPAN}>)")).alias("term"))


def _clear(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """The terms that no base span of their row overlaps: those before whose end no span starts that ends behind their start."""
    spans = F.concat(*[F.transform(k, lambda x: F.struct(x["start"], x["end"])) for k in KINDS])
    spans = rows.select("rid", F.explode(spans).alias("b")).select("rid", F.col("b.start").alias("place"), F.lit(1).alias("is_span"), F.col("b.end").alias("reach"))
    events = terms.withColumns({"place": F.col("end"), "is_span": F.lit(0)}).unionByName(spans, allowMissingColumns=True)
    before = W.partitionBy("rid").orderBy("place", "is_span").rowsBetween(W.unboundedPreceding, -1)
    found = events.withColumn("reached", F.max("reach").over(before)).filter((F.col("is_span") == 0) & (F.coalesce("reached", F.lit(0)) <= F.col("start")))
    return found.select(*terms.columns)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.8, support: int = 3) -> DataFrame:
    """Per row: id and the text with values generalised to ``[KIND]`` and disclosing terms removed.

    Of overlapping spans the one that starts first (then the longest) is replaced.
    """
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")), "pii-texts")
    found = find_personal(numbered.select("row", "t"), "row", "t", disclosure, support)
    put = {k: f"[{k.upper()}]" for k in KINDS} | {"term": ""}
    marks = F.concat(*[F.expr(f"transform({k}, x -> struct(x.start AS start, -x.end AS last, '{p}' AS put))") for k, p in put.items()])
    joined = numbered.join(found.select(F.col("id").alias("row"), F.array_sort(marks).alias("marks")), "row")
    # marks that start before an earlier one's end go; what is between the others comes from the pieces
    none = "cast(array() AS array<struct<start:int,end:int,put:string>>)"
    keep = f"aggregate(slice(marks, k, {BLOCK}), named_struct('at', whole.at, 'kept', {none}), (acc, m) -> CASE WHEN m.start < acc.at THEN acc ELSE named_struct('at', -m.last, 'kept', array_append(acc.kept, named_struct('start', m.start, 'end', -m.last, 'put', m.put))) END, acc -> named_struct('at', acc.at, 'blocks', array_append(whole.blocks, acc.kept)))"
    kept = f"aggregate(CASE WHEN size(marks) > 0 THEN sequence(1, size(marks), {BLOCK}) ELSE array() END, named_struct('at', 0, 'blocks', cast(array() AS array<array<struct<start:int,end:int,put:string>>>)), (whole, k) -> {keep}, whole -> flatten(whole.blocks))"
    joined = in_pieces(joined, "t", "size(marks) > 0").withColumn("kept", F.expr(kept))
    ends = "concat(array(0), transform(kept, m -> m.end))"
    parts = f"zip_with({ends}, kept, (at, m) -> concat({between('at', 'coalesce(m.start, length(t))')}, coalesce(m.put, '')))"
    return joined.select("id", F.expr(f"CASE WHEN size(kept) > 0 THEN array_join({parts}, '') ELSE t END").alias("text"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    base = F.concat(*[_listed(k, k) for k in KINDS])
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed("term", "term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def _sql_spans(text: str, pattern: str, more: str) -> str:
    """Rows of a table's texts: more, start, stop, value of each match."""
    return f"""SELECT {more}, list_sum([length(x) FOR x IN g[:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN m[:i-1]]), 0)::BIGINT AS start,
    list_sum([length(x) FOR x IN g[:i]])::BIGINT + list_sum([length(x) FOR x IN m[:i]])::BIGINT AS stop, m[i] AS value
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g"""


# The patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(list_reverse(string_split({_DIGITS}, '')), lambda x, k: CASE WHEN k % 2 = 1 THEN x::INTEGER WHEN x::INTEGER < 5 THEN 2 * x::INTEGER ELSE 2 * x::INTEGER - 9 END)) % 10 = 0"
_HOLDS = {
    "email": "true",
    "ip": f"regexp_full_match(value, '{BYTE_PART}(?:[.]{BYTE_PART}){{3}}')",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
_BLOCK = f"""CASE kind WHEN 'email' THEN regexp_extract(lower(value), '@.*$') WHEN 'ip' THEN regexp_replace(value, '[0-9]+$', '*')
    WHEN 'card' THEN left({_DIGITS}, 6) || '*' ELSE left({_DIGITS}, length({_DIGITS}) - 4) || '*' END"""
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  {" UNION ALL ".join(f"SELECT rid, {k} AS kind_no, '{kind}' AS kind, start, stop, value FROM ({_sql_spans('t', GIVEN[kind], 'rid')} FROM d))) WHERE {_HOLDS[kind]}" for k, kind in enumerate(KINDS))}),
mentions AS (
  SELECT rid, [kind || ':' || lower(value), kind || ':' || {_BLOCK}] AS entities, greatest(start - {NEAR}, 0) AS at_place, stop + {NEAR} >= length(t) AS last,
         substring(t, greatest(start - {NEAR}, 0) + 1, least(start, {NEAR})) || repeat(' ', stop - start) || substring(t, stop + 1, {NEAR}) AS around
  FROM base JOIN d USING (rid)),
found AS ({_sql_spans("around", TERM, "rid, entities, around, at_place, last")} FROM mentions))),
terms AS (
  SELECT rid, unnest(entities) AS entity, around, lower(value) AS term FROM found f
  WHERE (at_place = 0 OR start > 0) AND (last OR stop < length(around))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = f.rid AND b.start < at_place + f.stop AND b.stop > at_place + f.start)),
pairs AS (SELECT entity, term, count(DISTINCT rid) AS n_te FROM terms GROUP BY ALL HAVING count(DISTINCT around) >= 3 AND count(DISTINCT rid) >= 3),
n_e AS (SELECT entity, count(DISTINCT rid) AS n_e FROM (SELECT rid, unnest(entities) AS entity FROM mentions) GROUP BY 1),
words AS (SELECT DISTINCT rid, lower(unnest(regexp_extract_all(t, '{TERM}'))) AS term FROM d),
n_t AS (SELECT term, count(*) AS n_t FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY 1),
total AS (SELECT count(*)::DOUBLE AS total FROM d),
telling AS (
  SELECT DISTINCT term FROM pairs JOIN n_e USING (entity) JOIN n_t USING (term), total
  WHERE n_e < total AND ln(n_te * total / (n_t * n_e)) / ln(total / n_e) >= 0.8),
places AS ({_sql_spans("t", TERM, "rid")} FROM (SELECT * FROM d WHERE rid IN (SELECT rid FROM words WHERE term IN (SELECT term FROM telling)))))),
flagged AS (
  SELECT rid, start, stop, lower(value) AS term FROM places p
  WHERE lower(value) IN (SELECT term FROM telling) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = p.rid AND b.start < p.stop AND b.stop > p.start)),
listed AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY kind_no, start) AS spans,
                  {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)} FROM base GROUP BY rid),
more AS (SELECT rid, string_agg('term:' || start || ':' || stop, ',' ORDER BY start, stop, term) AS spans, count(*) AS n_term FROM flagged GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(l.spans, '')) AS base_sha256,
       concat_ws(',', l.spans, m.spans) AS spans, coalesce(n_term, 0) AS n_term
FROM d LEFT JOIN listed l USING (rid) LEFT JOIN more m USING (rid)
"""
