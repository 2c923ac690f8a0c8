r"""URL filter: rules first, then a ratio of character language models.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; the path goes on up to ``?``, ``#`` or the end. A rule (host,
path) fits its host and all subdomains where the url's path starts with the
rule's; of the fitting rules the longest decides.

URLs that no rule decides are judged by two variable-order Markov models of the
whole URL (scheme and host lower-cased, with query and fragment), one of the URLs that rules accept, one of those that rules
block. Each byte's probability is smoothed down to the empty context by the
number of distinct bytes that follow a context (Witten-Bell), contexts of up to
``DEPTH`` bytes have a node if they make up one ``KEPT``-th of the sample. The
log-likelihood difference per byte is held against a threshold that is
calibrated on decided URLs which the models haven't seen: the one with the
greatest mean of the two classes' shares of right verdicts.

The classifier learns from about ``SAMPLE`` URLs of each class, taken by a hash
of the URL (a documented bound); one in ``CALIBRATED`` of these only calibrates.
Distinct URLs count once. All URLs are judged, whole.

Rules are a table. It is joined to the suffixes of the distinct hosts, so that
each host gets the rules of its domains, and these to the URLs by host; so the
plan doesn't grow with the rules. What is joined is sent to every executor up to
``MOST_SENT`` rows and shuffled beyond.

Defined cases: a null url counts as empty; it, and one without ``://``, has an
empty host and no rule, and is judged like any other; without sampled URLs of both
classes every URL that no rule decides is allowed; ties at the threshold are
allowed; repeated rows are judged each; null ids are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contexts
from .common import ascii_lower, small_batches, staged, table

#: host, path, whether URLs that it fits are allowed
RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)]
DEPTH, KEPT, SAMPLE, CALIBRATED = 4, 4096, 20_000, 5
#: Rules, and hosts with rules, that are sent to every executor at most.
MOST_SENT = 100_000


def parted(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*+", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*+([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, bool]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, allowed boolean")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: of the distinct hosts those that a rule's host fits, with their rules as (length, rule, path, allowed)."""
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    domains = hosts.filter("host <> ''").select("host", F.explode(suffixes).alias("domain"))
    own = rules.select(F.col("host").alias("domain"), F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "path", "allowed").alias("r"))
    few = rules.count() <= MOST_SENT
    return domains.join(F.broadcast(own) if few else own, "domain").groupBy("host").agg(F.collect_list("r").alias("rules"))


def ruled(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, allowed (null where no rule fits), url (whole, scheme and host lower-cased)."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = parted(F.col("url"))
    scheme = F.substring_index("url", "://", 1)
    whole = F.concat(ascii_lower(scheme), F.lit("://"), host, F.substr(F.col("url"), F.length(scheme) + 4 + F.length(host)))
    whole = F.when(F.contains(F.col("url"), F.lit("://")), whole).otherwise(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), whole.alias("url"))
    found = staged(host_rules(rows.select("host").distinct(), rules if rules is not None else rule_table(pages.sparkSession)), "url-rules")
    few = found.count() <= MOST_SENT
    # the longest rule that fits; of equally long ones the last by name
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    joined = rows.join(F.broadcast(found) if few else found, "host", "left").withColumn("best", best)
    return joined.select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.allowed").alias("allowed"), "url")


class Ratio:
    """Log-likelihood differences of two smoothed Markov models, and the calibrated threshold."""

    def __init__(self, accepted: list[bytes], rejected: list[bytes], depth: int = DEPTH, kept: int = KEPT):
        sets = [([t for k, t in enumerate(x) if k % CALIBRATED], x[::CALIBRATED]) for x in (accepted, rejected)]
        counts = [contexts.counted(train or [b""], depth, end=True) for train, _ in sets]
        grams, weight = np.concatenate([g for g, _ in counts]), np.concatenate([n / n.sum() / 2 for _, n in counts])
        self.tree = contexts.Tree(contexts.kept_contexts(contexts.context_sums(grams, weight, depth), 1 / kept))
        good, bad = (self._logs(self.tree.counts(g, n.astype(float))) for g, n in counts)
        self.cost = (good - bad).astype(np.float32).ravel()
        self.threshold = self._calibrated(*(self.ratios(x) for _, x in sets))

    def _logs(self, count: np.ndarray) -> np.ndarray:
        tree = self.tree
        p = np.full((tree.nodes, 256), 1 / 256)
        total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        for d in range(tree.depth + 1):
            at = np.arange(len(count))[tree.nodes_of(d)]
            lower = p[tree.parent[at]] if d else p[at]
            with np.errstate(invalid="ignore"):
                p[at] = np.where(total[at] > 0, (count[at] + kinds[at] * lower) / (total[at] + kinds[at]), lower)
        p[tree.rest] = p[tree.parent[tree.rest]]
        return np.log(p)

    def ratios(self, texts: list[bytes]) -> np.ndarray:
        """Per byte (the end is one)."""
        return self.tree.summed(texts, self.cost, end=True) / np.array([len(t) + 1 for t in texts])

    @staticmethod
    def _calibrated(good: np.ndarray, bad: np.ndarray) -> float:
        if not len(good) or not len(bad):
            return 0.0
        cuts = np.unique(np.concatenate([good, bad]))
        cuts = np.concatenate([cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1])
        right = (1 - np.searchsorted(np.sort(good), cuts) / len(good)) + np.searchsorted(np.sort(bad), cuts) / len(bad)
        best = np.flatnonzero(right >= right.max() - 1e-12)
        return float(cuts[best[len(best) // 2]])


def fit(rows: DataFrame, sample: int = SAMPLE) -> Ratio | None:
    """From rows with url and allowed."""
    known = rows.filter(F.col("allowed").isNotNull()).select("url", "allowed")
    sizes = dict(known.groupBy("allowed").count().collect())
    if len(sizes) < 2:
        return None
    part = F.when(F.col("allowed"), min(1.0, sample / sizes[True])).otherwise(min(1.0, sample / sizes[False]))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(0), "url"), F.lit(1 << 20)) < part * (1 << 20)).distinct().toPandas()
    drawn = drawn.assign(key=[hash_of(u) for u in drawn["url"]]).sort_values(["key", "url"])
    good, bad = ([u.encode() for u, a in zip(drawn["url"], drawn["allowed"], strict=True) if a == side] for side in (True, False))
    return Ratio(good, bad) if good and bad else None


def hash_of(url: str) -> int:
    from zlib import crc32

    return crc32(url.encode())


def judged(rows: DataFrame, model: Ratio | None) -> DataFrame:
    """Rows of ``ruled`` with ``ratio`` (per byte) and ``verdict``."""
    spark = rows.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            allowed, url = (b.column(k).to_pylist() for k in (4, 5))
            if model is None or not url:
                ratio = np.zeros(len(url))
            else:
                ratio = model.ratios([u.encode() for u in url])
            limit = model.threshold if model else 0.0
            verdict = ["allow" if (r >= limit if a is None else a) else "block" for a, r in zip(allowed, ratio, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ratio, pa.float64()), pa.array(verdict, pa.string())], names=[*b.schema.names, "ratio", "verdict"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, allowed boolean, url string, ratio double, verdict string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ruled(table(spark, sf_dir, "pages"))
    return judged(rows, fit(rows)).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "ratio")
