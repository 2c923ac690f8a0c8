"""Finding and reading the entity tables, by Spark's own file systems."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError, DataError, FormatError, MissingDataError

ENTITIES = ("clients", "products", "purchases", "uplift_train")
SUFFIXES = (".csv", ".csv.gz", ".parquet")
#: Rows that the types of a CSV file are inferred from.
INFERRED = 10_000


def listed(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, path) of what is in a folder of any file system that Spark knows; nothing if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(str(folder))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted((s.getPath().getName(), s.getPath().toString()) for s in system.listStatus(path))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discover(spark: SparkSession, folder: str, entities: Iterable[str] = ENTITIES) -> dict[str, str]:
    """Per entity the one file whose name has the entity's name in it, in any case."""
    files = [(n, p) for n, p in listed(spark, folder) if n.lower().endswith(SUFFIXES)]
    found = {e: [p for n, p in files if e.lower() in n.lower()] for e in entities}
    many = {e: p for e, p in found.items() if len(p) > 1}
    if many:
        raise DataError(f"ambiguous files: {many}")
    missing = [e for e, p in found.items() if not p]
    if missing:
        raise MissingDataError(f"no file in {folder} for: {', '.join(missing)}")
    return {e: p[0] for e, p in found.items()}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its schema; CSV, also packed, with header, types and dates inferred from its first rows.

    A later value that doesn't fit the inferred type is an error, not a null.
    """
    name = str(path).lower().rstrip("/")
    if name.endswith(".parquet"):
        return spark.read.parquet(str(path))
    if name.endswith((".csv", ".csv.gz")):
        first, *rest = [r[0] for r in spark.read.text(str(path)).limit(INFERRED + 1).collect()] or [""]
        head = [first, *(x for x in rest if x != first)]  # each file of a folder has the header
        schema = spark.read.csv(spark.sparkContext.parallelize(head, 1), header=True, inferSchema=True).schema
        frame = spark.read.csv(str(path), header=True, schema=schema, enforceSchema=False, mode="FAILFAST")
        # a packed file is one split; deal its rows out for what follows
        return frame.repartition(spark.sparkContext.defaultParallelism) if name.endswith(".gz") else frame
    raise FormatError(f"not read: {path} (known: {', '.join(SUFFIXES)})")


def scan_all(spark: SparkSession, folder: str, entities: Iterable[str] = ENTITIES) -> dict[str, DataFrame]:
    return {e: scan(spark, p) for e, p in discover(spark, folder, entities).items()}


def schemas(frames: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
    """Column types by entity; for Parquet no job runs."""
    return {e: dict(f.dtypes) for e, f in frames.items()}


def scan_clean(spark: SparkSession, folder: str, config) -> dict[str, DataFrame]:
    """The cleaned tables that a role mapping needs, and no others."""
    wanted = ["clients", "purchases"] + ["products"] * bool(config.products) + ["uplift_train"] * bool(config.experiment)
    paths = {e: f"{folder}/{e}.parquet" for e in wanted}
    missing = [p for p in paths.values() if not exists(spark, p)]
    if missing:
        raise ConfigError(f"cleaned tables are missing: {missing}")
    return {e: spark.read.parquet(p) for e, p in paths.items()}


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(str(path)) if exists(spark, path) else None
