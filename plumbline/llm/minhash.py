r"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard similarity.

A text is lower-cased (A-Z) and split into words ``[^\x20\x09-\x0D]+``; its set
holds its distinct shingles of five words, or, with fewer words, the whole
sequence as one. Two documents are linked when 100 * intersection >= 75 * union;
a component is what links connect.

*Signatures.* A shingle is a number of 64 bits, its low 32 bits an element of
the universe Z(2^32). One permutation of the universe scatters the elements; the
other, circularly shifted by k, gives coordinate k as the least image over the
set, for all ``BANDS * ROWS`` coordinates. ``ROWS`` of them make a band; sets
with an equal band meet in a bucket. A pair at the threshold misses all 60
buckets with probability (1 - 0.75^6)^60 = 8e-6; one at 0.25 meets in 1.5 of 100 cases.

*Classes.* Documents with the same set are one class from the start, so exact
copies cost a partial aggregate; everything after handles one row per class.

*Links.* Not all pairs of a bucket are compared, only what connects it. First
each class is compared with the least class of a bucket, the one it meets most
often; components are found; then the classes of each bucket with the bucket's
least class where their components differ; last, those classes of a bucket whose
components still differ, whose sizes allow the similarity and whose signatures
come close to it. These are compared where the bucket is: a bucket is dealt in
blocks, every two blocks meet in a group, and the group lists its members that
have someone to be compared with, gets their full sets, and gives back no more
links than connect it. So rows grow with members, not with pairs, even where
very many texts are just below the threshold; the comparisons in memory are the
square of such a bucket. All comparisons that make a link are exact, on the full
sets. Later rounds only join the components of earlier ones.

Defined cases: a document without words (or with a null text) has an empty set,
is linked with nothing and kept; repeated rows belong to one class and are marked
alike; null ids are left out of the smallest id, and are kept if their
component has no other; an empty table gives an empty result; other columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, released, small_batches, staged, table, text_or_empty

WORDS, BANDS, ROWS = 5, 60, 6
#: Linked if PART * intersection >= OF * union.
PART, OF = 100, 75
#: Coordinates (a byte of each) that decide which pairs are compared exactly at last, and the share of them that must be equal.
#: Of pairs at the threshold one in a million has a share under 0.66: 4.7 standard deviations below 0.75.
LONG_SIGNATURE, CLOSE = 512, 0.66
#: Members and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 512, 2 << 20
#: Shingles whose images are computed together; words whose numbers are kept.
CHUNK, KEPT_WORDS = 512, 150_000
#: Keys of rows that are sent to every executor at most (50 bytes each); beyond, both sides are shuffled.
MOST_SENT = 500_000
#: Odd multipliers for the places of a shingle's words.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Numbers(dict):
    """64-bit numbers of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number


def _mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _mixed32(x: np.ndarray, spare: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of Z(2^32), in place."""
    for shift, factor in ((16, a), (13, b), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def shingles(text: str | None, numbers: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * PLACES[k]
    return np.unique(_mixed64(out + np.uint64(size)))


def signature(numbers: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash of a set that isn't empty."""
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    first = numbers.astype(np.uint32)
    first = _mixed32(first, np.empty_like(first), 0x7FEB352D, 0x846CA68B)
    for a in range(0, len(first), CHUNK):
        x = first[None, a : a + CHUNK] + shift
        np.minimum(least, _mixed32(x, np.empty_like(x), 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=least)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band and its place."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed64(key * PLACES[0] + rows[:, k])
    return key.view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select("id", F.unhex(F.md5("text")).alias("same"), "text")


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, same (md5 of the text), n (size of the set), cls (128-bit digest of the set; null if empty), bands."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for b in batches:
            n, cls, keys = [], [], []
            for text in b.column(2):
                own = shingles(text.as_py(), numbers)
                n.append(len(own))
                cls.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                keys.append(bands(signature(own)) if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "same", "n", "cls", "bands"])
        numbers.clear()
        released()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, same binary, n long, cls binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """c, numbers (8 bytes each) of the documents that stand for the wanted classes (c, id, same)."""
    small_batches(docs.sparkSession)
    few = wanted.count() <= MOST_SENT
    keys = wanted.select("c", F.col("id").alias("own_id"), F.col("same").alias("own_same"))
    rows = _rows(docs, id_col, text_col).join(F.broadcast(keys) if few else keys, (F.col("same") == F.col("own_same")) & F.col("id").eqNullSafe(F.col("own_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for b in batches:
            found = [shingles(t.as_py(), numbers).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["c", "numbers"])
        numbers.clear()
        released()

    sets = staged(rows.select("c", "text").mapInArrow(run, "c long, numbers binary"), "near-sets")
    if not sets.groupBy("c").count().filter("count > 1").isEmpty():  # repeated rows
        sets = staged(sets.dropDuplicates(["c"]), "near-sets")
    return sets


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are alike enough, by their full sets."""
    small_batches(pairs.sparkSession)
    left = sets.select(F.col("c").alias("a"), F.col("numbers").alias("numbers_a"))
    right = sets.select(F.col("c").alias("b"), F.col("numbers").alias("numbers_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "numbers_a", "numbers_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(alike(x, y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(both.mapInArrow(run, "a long, b long"), "near-links")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if len(x) > len(y):
        x, y = y, x
    if PART * len(x) < OF * len(y):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return PART * shared >= OF * (len(both) - shared)


def components(links: DataFrame) -> DataFrame:
    """c, comp: for every node of the links (a, b) the least node that it is connected with.

    Alternating large and small stars: each node hands the least of its
    neighbours to the others, until all edges lead to the least of a component.
    """
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    seen = edges.agg(*mark).first()
    while seen[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "near-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = staged(small, "near-edges")
        now = edges.agg(*mark).first()
        if now == seen:
            break
        seen = now
    return staged(edges.select(F.col("a").alias("c"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct()), "near-comps")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, same (md5 of the text), n_shingles, component_id, kept."""
    rows = staged(signed(docs, id_col, text_col), "near-rows")
    by = F.struct(F.col("id").isNull(), "id", "same")
    classes = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(by).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("c"), "cls", "first.id", "first.same", "n", "bands"), "near-classes")

    keys = classes.select("c", "n", F.posexplode("bands").alias("band", "key"))
    buckets = staged(keys.groupBy("key").agg(F.min("c").alias("center"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "center"), "near-buckets")
    members = staged(keys.join(buckets, "key"), "near-members")
    wanted = classes.join(members.select("c").distinct(), "c").select("c", "id", "same")
    sets = sets_of(docs, wanted, id_col, text_col)

    met = members.filter("c <> center").groupBy("c", "center").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("c").agg(F.max(F.struct("times", (-F.col("center")).alias("near"))).alias("x")).select(F.col("c").alias("a"), (-F.col("x.near")).alias("b"))
    comps = components(linked(best, sets))

    placed = staged(_placed(members, comps), "near-placed")
    ends = placed.join(comps.select(F.col("c").alias("center"), F.col("comp").alias("center_comp")), "center", "left").withColumn("center_comp", F.coalesce("center_comp", "center"))
    more = linked(ends.filter("comp <> center_comp").select(F.col("c").alias("a"), F.col("center").alias("b")).distinct(), sets)
    comps = joined_components(comps, more)
    comps = joined_components(comps, close_links(_placed(members, comps), sets))

    ids = classes.select("c", "cls", "id").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = ids.groupBy("comp").agg(F.min("id").alias("component_id"))
    ids = staged(ids.join(least, "comp").select("cls", "component_id"), "near-ids")
    found = rows.join(ids, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return found.select("id", "same", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (c, comp) after ``links`` (a, b) between classes have joined some of them."""
    ends = links
    for end in ("a", "b"):
        top = comps.select(F.col("c").alias(end), F.col("comp").alias("top"))
        ends = ends.join(top, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    tops = components(ends).select(F.col("c").alias("comp"), F.col("comp").alias("top"))
    moved = comps.join(tops, "comp", "left").select("c", F.coalesce("top", "comp").alias("comp"))
    single = tops.select(F.col("comp").alias("c"), F.col("top").alias("comp")).join(comps.select("c"), "c", "left_anti")
    return staged(moved.union(single), "near-comps")


def close_candidates(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """key, i, j, c, comp, partners: by group (two blocks of a bucket) the classes that are to be compared exactly.

    ``placed`` has key, band, c, n, comp. Buckets of a single component are done.
    ``partners`` are the classes of other components (8 bytes each) whose long
    signatures are ``CLOSE`` or more alike; each pair is with one of its ends, in the
    group of the first bucket that it shares. A class has one row in a group.
    """
    small_batches(placed.sparkSession)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).filter("x <> y")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = staged(placed.join(mixed.select("key", blocks.alias("blocks")), "key"), "near-mixed")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            long = [signature(np.frombuffer(x.as_buffer(), np.uint64), LONG_SIGNATURE) for x in b.column(1)]
            found = [x.astype(np.uint8).tobytes() + bands(x[: BANDS * ROWS]).tobytes() for x in long]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["c", "sig"])

    signs = sets.join(placed.select("c").distinct(), "c", "left_semi").select("c", "numbers").mapInArrow(sign, "c long, sig binary")
    block = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "band", "c", "n", "comp")
    rows = dealt.join(staged(signs, "near-signs"), "c").select("key", "i", "j", "block", "band", "c", "n", "comp", "sig")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def read(b: pa.RecordBatch) -> list[np.ndarray]:
        cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8)]
        return [*cols, np.frombuffer(b"".join(x.as_py() for x in b.column(8)), np.uint8).reshape(-1, LONG_SIGNATURE + 8 * BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches, read):
            yield from _close_in_group(cols)
        released()

    return rows.mapInArrow(run, "key long, i int, j int, c long, comp long, partners binary")


def _groups(batches: Iterator[pa.RecordBatch], read) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal first three columns."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = read(b)
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for p, q in zip(edges, edges[1:], strict=False):
            yield [x[p:q] for x in cols]
        kept = [x[edges[-1] :] for x in cols]
    if kept is not None:
        yield kept


def _close_in_group(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Two blocks of a bucket: key, i, j, block, band, c, n, comp, sig."""
    key, i, j, block, band, c, n, comp, sig = cols
    if (comp == comp[0]).all():
        return
    sig, keys = sig[:, :LONG_SIGNATURE], np.ascontiguousarray(sig[:, LONG_SIGNATURE:]).view(np.int64)
    partners: dict[int, bytes] = {}
    for k in range(len(c)):
        # inside a block each pair once, between two blocks the first with the second
        if i[0] != j[0] and block[k] != i[0]:
            continue
        other = np.flatnonzero(comp != comp[k])
        other = other[other > k] if i[0] == j[0] else other[block[other] == j[0]]
        other = other[PART * np.minimum(n[k], n[other]) >= OF * np.maximum(n[k], n[other])]
        if not len(other):
            continue
        other = other[(sig[other] == sig[k]).sum(1) >= CLOSE * LONG_SIGNATURE]
        other = other[(keys[other] == keys[k]).argmax(1) == band[k]]
        if len(other):
            partners[k] = c[other].tobytes()
            for x in other.tolist():
                partners.setdefault(x, b"")
    if partners:
        at = sorted(partners)
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[:m], pa.int64()), pa.array(i[:m].astype(np.int32)), pa.array(j[:m].astype(np.int32)), pa.array(c[at]), pa.array(comp[at]), pa.array([partners[k] for k in at], pa.binary())],
            names=["key", "i", "j", "c", "comp", "partners"],
        )


def close_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect classes of unlike components of a bucket; of each group no more than join its components."""
    found = staged(close_candidates(placed, sets), "near-close")
    rows = found.join(sets, "c").select("key", "i", "j", "c", "comp", "partners", "numbers")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "c")

    def read(b: pa.RecordBatch) -> list[np.ndarray]:
        cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
        for k in (5, 6):
            held = np.empty(b.num_rows, object)
            held[:] = b.column(k).to_pylist()
            cols.append(held)
        return cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, read):
            links = _links_in_group(*group[3:])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])
        released()

    return staged(rows.mapInArrow(run, "a long, b long"), "near-links")


def _links_in_group(c: np.ndarray, comp: np.ndarray, partners: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Exact comparisons of those that nothing connects yet."""
    place = {x: k for k, x in enumerate(c.tolist())}
    up = {x: x for x in comp.tolist()}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sets = [np.frombuffer(x, np.uint64) for x in numbers]
    links = []
    for k, those in enumerate(partners):
        for x in np.frombuffer(those, np.int64).tolist():
            a, b = top(int(comp[k])), top(int(comp[place[x]]))
            if a != b and alike(sets[k], sets[place[x]]):
                up[max(a, b)] = min(a, b)
                links.append((int(c[k]), x))
    return links


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, in its own columns."""
    stay = staged(near_classes(docs, id_col, text_col).filter("kept").select(F.col("id").alias("stay_id"), F.col("same").alias("stay_same"), "component_id", "n_shingles"), "near-stay")
    again = not stay.groupBy("stay_id", "stay_same").count().filter("count > 1").isEmpty()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col(id_col).alias("own_id"), F.unhex(F.md5(text_or_empty(text_col))).alias("own_same"))
    meets = F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_same") == F.col("stay_same"))
    kept = rows.join(stay, meets, "left_semi")
    if again:
        kept = kept.dropDuplicates(["own_id", "own_same"])
    return kept.select("row.*")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: By comparing all documents that share a shingle; for small tables.
OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM w),
n AS (SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {PART} * inter >= {OF} * (x.n + y.n - inter)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""
