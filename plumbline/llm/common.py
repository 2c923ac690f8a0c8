"""What the corpus operators share: tables, staging folder, batches of texts."""

from __future__ import annotations

import contextlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, staged  # noqa: F401

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SENT_TO: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send this package to the workers, once an application: they may start in any folder, and have no copy of it."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if context.applicationId in _SENT_TO or not package.is_dir():
        return
    path = f"{tempfile.mkdtemp()}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    _SENT_TO.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound the Arrow batches in which whole texts go to Python workers, which can import this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def released() -> None:
    """At a task's end give freed memory back: workers stay alive, and what one holds counts for its executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def share_of(key: str | Column, parts: int) -> Column:
    """crc32(key as text) mod ``parts``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
