r"""Temperature mixing of sources to target weights.

A source's share of all tokens (words ``[^\x20\x09-\x0D]+``) is raised to an
exponent a in [0, 1] and normalised. The exponent is bisected on a grid of
``STEPS`` steps: the largest at which the mixture's entropy reaches
``entropy`` times the greatest possible one, or, if that repeats some source
more than ``repeats`` times under the budget, the smallest that doesn't.

The budget is ``budget`` times all tokens. A source's quota, its weight times
the budget, is realised as block permutations: each pass over a source is a
block in an order drawn from md5(seed, pass, id), a document's *place*; as many
whole blocks as the quota holds, then of one more block the documents that come
first, as far as the quota reaches. That cut is a greatest place per source. It is
found from the top: places are summed by their first two digits, then, inside the
range that the quota ends in, by the next two, until a range holds few documents;
so a task sees 256 ranges of a source, however large it is. ``mixed`` gives the rows
in the order of blocks and places, dealt over partitions by ranges of them.

Only DataFrame functions are used. Defined cases: a null text has no tokens; a
null source counts as the source ``''``; documents without tokens are never
chosen; repeated rows (same id) share their places and are chosen together; rows
of null ids have places by their texts; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

STEPS = 1 << 20
#: Exponents that are tried in one pass over the sources.
FAN = 64
#: Documents in whose range the cut is looked for one by one.
IN_RANGE = 1024
#: Sources that are sent to every executor at most; beyond, rows and sources are shuffled by source.
MOST_SENT = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def place_key(id_col: str | Column, text: str | Column) -> Column:
    """What a document's places are drawn from: its id, or a digest of its text if it has none."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(key.cast("string"), F.concat(F.lit("~"), F.md5(text_or_empty(text))))


def place(key: Column, block: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), key))


def exponent(shares: DataFrame, n: int, entropy: float, repeats: float, budget: float) -> int:
    """The exponent, in steps. ``shares``: a row with ``p`` for each source that has tokens."""

    def tried(low: int, high: int) -> list[tuple[int, float, float]]:
        steps = sorted({low + (high - low) * k // FAN for k in range(FAN + 1)})
        grid = shares.select("p", F.explode(F.array(*[F.lit(j) for j in steps])).alias("j")).withColumn("a", F.col("j") / STEPS)
        power = F.pow("p", "a")
        sums = grid.groupBy("j").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"), F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("most"), F.first("a").alias("a"))
        return sorted((r["j"], math.log(r["z"]) - r["a"] * r["zl"] / r["z"], budget * r["most"] / r["z"]) for r in sums.collect())

    def last(holds, low: int = 0, high: int = STEPS) -> int:
        """The last step at which ``holds``, which is so at low and up to some step."""
        while True:
            rows = tried(low, high)
            good = [j for j, *x in rows if holds(*x)]
            if not good:
                return low
            low, high = good[-1], min([j for j, *_ in rows if j > good[-1]], default=good[-1])
            if high - low <= 1:
                return low

    wide = last(lambda h, _: h >= entropy * math.log(n) - 1e-12)
    (_, _, most), *_ = [x for x in tried(wide, wide + 1) if x[0] == wide]
    if most <= repeats:
        return wide
    return min(STEPS, last(lambda _, most: most > repeats) + 1)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = 0.95, repeats: float = 2.0, budget: float = 1.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(per row: id, source, n_tokens), (per source: source, weight, quota, blocks, cut)."""
    rows = staged(docs.select(F.col(id_col).alias("id"), place_key(id_col, text_col).alias("key"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), n_tokens(text_col).alias("n_tokens")), "mix-rows")
    sums = staged(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"), "mix-sources")
    total, n = sums.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n:
        empty = sums.select("source", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(0).cast("long").alias("blocks"), F.lit("").alias("cut"))
        return rows, empty
    shares = sums.withColumn("p", F.col("tokens") / F.lit(float(total)))
    step = exponent(shares.select("p"), n, entropy, repeats, budget)
    power = F.pow(F.col("p"), F.lit(step / STEPS))
    (norm,) = shares.agg(F.sum(power)).first()
    shares = shares.withColumn("weight", F.round(power / F.lit(norm), 9))
    shares = shares.withColumn("quota", F.floor(F.col("weight") * F.lit(float(int(total * budget)))))
    shares = staged(shares.withColumn("blocks", F.floor(F.col("quota") / F.col("tokens"))).select("source", "tokens", "weight", "quota", "blocks"), "mix-weights")

    sent = lambda df: F.broadcast(df) if n <= MOST_SENT else df
    chosen = rows.join(sent(shares), "source").filter("n_tokens > 0")
    placed = staged(chosen.select("source", "n_tokens", place(F.col("key"), F.col("blocks"), seed).alias("place")), "mix-places")
    cuts = cut_places(placed, shares.select("source", (F.col("quota") - F.col("blocks") * F.col("tokens")).alias("room")), sent)
    sources = shares.join(cuts, "source", "left").select("source", "weight", "quota", "blocks", F.coalesce("cut", F.lit("")).alias("cut"))
    return rows, staged(sources, "mix-plan")


def cut_places(placed: DataFrame, rooms: DataFrame, sent) -> DataFrame:
    """source, cut: up to which place the documents (source, place, n_tokens) fill a source's room and no more.

    ``prefix`` leads to the range in which the room ends; what is before it is in ``ahead``.
    """
    edge, cuts, digits = rooms.select("source", "room", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("ahead")), None, 0
    in_order = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    while True:
        inside = placed.join(sent(edge), (placed["source"] == edge["source"]) & (F.substring("place", 1, digits) == F.col("prefix"))).drop(edge["source"])
        if digits and (digits == 32 or not edge.filter(F.col("docs") > IN_RANGE).count()):
            one_by_one = W.partitionBy("source").orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow)
            found = inside.withColumn("upto", F.col("ahead") + F.sum("n_tokens").over(one_by_one)).filter("upto <= room")
            return cuts.unionByName(found.select("source", F.col("place").alias("cut"))).groupBy("source").agg(F.max("cut").alias("cut"))
        digits += 2
        ranges = inside.groupBy("source", F.substring("place", 1, digits).alias("range")).agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("docs"), F.first("room").alias("room"), F.first("ahead").alias("ahead"))
        ranges = ranges.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("held").over(in_order), F.lit(0))).filter("ahead <= room")
        ranges = staged(ranges.select("source", "range", "room", "ahead", "held", "docs"), "mix-ranges")
        full = ranges.filter("ahead + held <= room").select("source", F.concat("range", F.lit("g")).alias("cut"))  # after every place of the range
        cuts = full if cuts is None else cuts.unionByName(full)
        edge = ranges.filter("ahead + held > room").select("source", "room", F.col("range").alias("prefix"), "ahead", "docs")


def _copies(key: Column, tokens: Column, seed: int) -> Column:
    last = F.when(place(key, F.col("blocks"), seed) <= F.col("cut"), 1).otherwise(0)
    return F.when(tokens > 0, F.coalesce(F.col("blocks") + last, F.lit(0))).otherwise(0).cast("long")


def _taken(key: Column, copies: Column, seed: int) -> Column:
    """(block, place) of each copy of a document."""
    blocks = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(blocks, lambda b: F.struct(b.alias("block"), place(key, b, seed).alias("place")))


def scheduled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **how) -> DataFrame:
    """row (the columns of ``docs``), block and place: a row for each copy that the mixture takes, in no order."""
    _, sources = plan(docs, id_col, text_col, source_col, seed=seed, **how)
    few = sources.count() <= MOST_SENT
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, place_key(id_col, text_col).alias("key"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    rows = rows.join(F.broadcast(sources) if few else sources, "source")
    copies = _copies(F.col("key"), F.regexp_instr(text_or_empty(F.col(f"row.`{text_col}`")), F.lit(WORD)), seed)
    return rows.select("row", F.explode(_taken(F.col("key"), copies, seed)).alias("x")).select("row", "x.*")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **how) -> DataFrame:
    """``docs``, each row as often as the mixture takes it, in its own columns, block after block in the order of places."""
    rows = scheduled(docs, id_col, text_col, source_col, seed, **how)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "block", "place").sortWithinPartitions("block", "place").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its source, tokens, the source's weight, how often the mixture takes it, and ``block:place`` of each time."""
    rows, sources = plan(table(spark, sf_dir, "documents"))
    few = sources.count() <= MOST_SENT
    found = rows.join(F.broadcast(sources) if few else sources, "source", "left").withColumn("copies", _copies(F.col("key"), F.col("n_tokens"), 7))
    schedule = F.array_join(F.transform(_taken(F.col("key"), F.col("copies"), 7), lambda x: F.concat_ws(":", x["block"].cast("string"), x["place"])), ",")
    return found.select(F.col("id").alias("doc_id"), "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), "copies", schedule.alias("schedule"))


OP4_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))) AS id_key, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens
  FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY source HAVING sum(n_tokens) > 0),
total AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n FROM s),
p AS (SELECT list(tokens / total) AS ps, any_value(n) AS n FROM s, total),
wide AS (
  SELECT 0 AS low, {STEPS + 1} AS high, ps, n FROM p
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END, ps, n
  FROM (SELECT *, ln(z) - a * list_sum(list_transform(ps, lambda x: pow(x, a) * ln(x))) / z >= 0.95 * ln(n) - 1e-12 AS ok
        FROM (SELECT *, list_sum(list_transform(ps, lambda x: pow(x, a))) AS z
              FROM (SELECT *, (low + high) // 2 AS mid, ((low + high) // 2) / {STEPS}::DOUBLE AS a FROM wide WHERE high - low > 1)))),
rep AS (
  SELECT -1 AS low, {STEPS} AS high, ps FROM p
  UNION ALL
  SELECT CASE WHEN much THEN mid ELSE low END, CASE WHEN much THEN high ELSE mid END, ps
  FROM (SELECT *, list_max(list_transform(ps, lambda x: pow(x, a - 1))) / list_sum(list_transform(ps, lambda x: pow(x, a))) > 2.0 AS much
        FROM (SELECT *, (low + high) // 2 AS mid, ((low + high) // 2) / {STEPS}::DOUBLE AS a FROM rep WHERE high - low > 1))),
step AS (SELECT greatest((SELECT low FROM wide WHERE high - low = 1), (SELECT high FROM rep WHERE high - low = 1)) / {STEPS}::DOUBLE AS a),
w AS (
  SELECT source, tokens, floor(weight * total)::BIGINT AS quota, floor(floor(weight * total) / tokens)::BIGINT AS blocks, weight
  FROM (SELECT source, tokens, total, round(pow(tokens / total, a) / sum(pow(tokens / total, a)) OVER (), 9) AS weight FROM s, total, step)),
k AS (
  SELECT t.*, weight, quota, blocks, tokens, md5('7:' || blocks || ':' || id_key) AS key
  FROM t LEFT JOIN w USING (source)),
c AS (
  SELECT *, CASE WHEN n_tokens > 0 THEN blocks + (sum(n_tokens) OVER (PARTITION BY source ORDER BY key) <= quota - blocks * tokens)::BIGINT ELSE 0 END AS copies FROM k)
SELECT doc_id, source, n_tokens, coalesce(weight, 0.0) AS weight, copies,
       array_to_string([b || ':' || md5('7:' || b || ':' || id_key) FOR b IN range(0, copies)], ',') AS schedule
FROM c
"""
