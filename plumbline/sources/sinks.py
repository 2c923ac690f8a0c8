"""Writing files and tables so that readers never see a part of one.

``write_atomic`` renames a complete folder into place; while it replaces one, there
is a moment between two renames in which readers find none. ``Tables`` has no such
moment: its readers go by a manifest, and one new manifest publishes any number of
changed tables at once.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WarehouseError
from .loader import listed

NAME = re.compile(r"[a-z_][a-z0-9_]*")


def write_atomic(df: DataFrame, path: str, small: bool = False) -> str:
    """Parquet in a folder beside, renamed when complete; ``small``: in one file."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        (df.coalesce(1) if small else df).write.parquet(beside)
        _renamed(spark, beside, path)
    finally:
        _removed(spark, beside)
    return path


def _paths(spark: SparkSession, *paths: str):
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return (made[0].getFileSystem(spark._jsc.hadoopConfiguration()), *made)


def _removed(spark: SparkSession, path: str) -> None:
    system, at = _paths(spark, path)
    system.delete(at, True)


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    system, source, target = _paths(spark, old, new)
    aside = None
    if system.exists(target):
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{new}.{uuid.uuid4().hex}.old")
        system.rename(target, aside)
    if not system.rename(source, target):
        if aside is not None:
            system.rename(aside, target)
        raise OSError(f"can't rename {old} to {new}")
    if aside is not None:
        system.delete(aside, True)


def write_csv(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def write_json(spark: SparkSession, value: object, path: str) -> str:
    system, at = _paths(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()))
    finally:
        out.close()
    return path


def identifier(name: str) -> str:
    if not NAME.fullmatch(name):
        raise WarehouseError(f"not a name of lower-case letters, digits and underscores: {name!r}")
    return name


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def nan_to_null(df: DataFrame, infinities: bool = False) -> DataFrame:
    """NaN (and infinities, if asked for) as null in every float column."""
    new = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.col(f"`{f.name}`")
            new[f.name] = finite(c) if infinities else F.when(~F.isnan(c), c)
    return df.withColumns(new) if new else df


def loadable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The target's columns that the frame has, in the target's order."""
    return df.select([c for c in columns if c in df.columns])


class Tables:
    """A set of tables in a folder, which change together or not at all.

    A table is a list of Parquet parts; a part has the rows of one scope (a column's
    value) or of any. ``_manifest/<number>.json`` lists the parts of all tables, and
    readers take the greatest number. A change writes new parts, claims the next
    number by creating a file that must not exist, and publishes the next manifest.
    So a change that fails leaves all tables as they were, and of two writers that
    began with the same manifest the second fails. Replacing a scope writes that
    scope's rows only; an upsert rewrites only parts that have one of its keys.
    ``vacuum`` removes parts that older manifests alone list.
    """

    #: Parts of no scope that a table may have before an upsert makes one of them.
    MOST_PARTS = 16

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._pending: dict[str, list[dict]] | None = None
        self._made: list[str] = []

    def _manifests(self) -> list[int]:
        return sorted(int(name[:-5]) for name, _ in listed(self.spark, f"{self.folder}/_manifest") if name.endswith(".json"))

    def _manifest(self, number: int) -> dict[str, list[dict]]:
        system, path = _paths(self.spark, f"{self.folder}/_manifest/{number}.json")
        stream = system.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self) -> dict[str, list[dict]]:
        if self._pending is not None:
            return self._pending
        numbers = self._manifests()
        return self._manifest(numbers[-1]) if numbers else {}

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Tables]:
        """All changes inside are published at its end, or none; inside an open one it is part of that."""
        if self._pending is not None:
            yield self
            return
        number = max(self._manifests(), default=0)
        before = self._manifest(number) if number else {}
        self._pending, self._made = {k: list(v) for k, v in before.items()}, []
        try:
            yield self
            if self._pending != before:
                self._publish(number + 1, self._pending)
        except BaseException:
            for path in self._made:
                _removed(self.spark, path)
            raise
        finally:
            self._pending, self._made = None, []

    def _publish(self, number: int, state: dict[str, list[dict]]) -> None:
        at = f"{self.folder}/_manifest/{number}"
        system, claim, beside, final = _paths(self.spark, f"{at}.claim", f"{at}.tmp", f"{at}.json")
        if not system.createNewFile(claim):
            raise WarehouseError(f"another load has claimed {at}.claim; if it has died, remove that file")
        try:
            write_json(self.spark, state, f"{at}.tmp")
            if not system.rename(beside, final):
                raise WarehouseError(f"can't publish {at}.json")
        except BaseException:
            system.delete(beside, False)
            system.delete(claim, False)
            raise

    def _write(self, table: str, frame: DataFrame) -> str:
        path = f"{identifier(table)}/{uuid.uuid4().hex}"
        self._made.append(f"{self.folder}/{path}")
        frame.write.parquet(f"{self.folder}/{path}")
        return path

    def _read(self, parts: Sequence[dict]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{p['path']}" for p in parts])

    def read(self, table: str) -> DataFrame | None:
        parts = self._state().get(identifier(table))
        return self._read(parts) if parts else None

    def upsert(self, table: str, frame: DataFrame, keys: Sequence[str]) -> int:
        """New rows override old ones with the same keys; the number of new rows."""
        for name in [*frame.columns, *keys]:
            identifier(name)
        with self.transaction():
            new = {"path": self._write(table, nan_to_null(frame, infinities=True)), "scope": None}
            rows = self._read([new]).count()
            if not rows:
                return 0
            fresh = self._read([new]).select(*keys).alias("n")
            same = reduce(and_, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
            old = self._pending.get(table, [])
            met = [k for k, part in enumerate(old) if not self._read([part]).alias("o").join(fresh, same, "left_semi").isEmpty()] if len(old) <= self.MOST_PARTS else range(len(old))
            parts = [part for k, part in enumerate(old) if k not in met]
            for scope in sorted({json.dumps(old[k]["scope"]) for k in met}):
                own = self._read([old[k] for k in met if json.dumps(old[k]["scope"]) == scope])
                parts.append({"path": self._write(table, own.alias("o").join(fresh, same, "left_anti")), "scope": json.loads(scope)})
            self._pending[table] = [*parts, new]
            return rows

    def replace(self, table: str, frame: DataFrame, scope: str | None = None, value: object = None) -> int:
        """All rows, or those whose ``scope`` column has a value, give way to the frame's."""
        with self.transaction():
            own = [identifier(scope), str(value)] if scope else None
            new = {"path": self._write(table, nan_to_null(frame, infinities=True)), "scope": own}
            rows, kept = self._read([new]), []
            if scope:
                inside = F.col(scope).eqNullSafe(F.lit(value))
                if not rows.filter(~inside).isEmpty():
                    raise WarehouseError(f"{table}: rows whose {scope} isn't {value}")
                for part in self._pending.get(table, []):
                    if part["scope"] == own:
                        continue
                    if not (part["scope"] and part["scope"][0] == scope) and not self._read([part]).filter(inside).isEmpty():
                        part = {"path": self._write(table, self._read([part]).filter(~inside)), "scope": part["scope"]}
                    kept.append(part)
            self._pending[table] = [*kept, new]
            return rows.count()

    def key_of(self, table: str, key: str, name_column: str, name: str, **more: object) -> int:
        """The number of a name: the one it has, or the next one, which is written."""
        with self.transaction():
            old = self.read(table)
            number = 1
            if old is not None:
                found = old.filter(F.col(name_column) == name).select(key).first()
                if found:
                    return found[0]
                number = old.agg(F.max(key)).first()[0] + 1
            values = {key: F.lit(number).cast("long"), name_column: F.lit(name), **{k: v if isinstance(v, Column) else F.lit(v) for k, v in more.items()}}
            self.upsert(table, self.spark.range(1).select(*[v.alias(k) for k, v in values.items()]), [key])
            return number

    def views(self) -> None:
        """A temporary view of each table by its name."""
        for name in self._state():
            self.read(name).createOrReplaceTempView(name)

    def vacuum(self, keep: int = 1) -> int:
        """Remove the parts that none of the last ``keep`` manifests lists, and older manifests; the number of parts."""
        numbers = self._manifests()
        held = {p["path"] for n in numbers[-keep:] for parts in self._manifest(n).values() for p in parts}
        gone = [path for name, _ in listed(self.spark, self.folder) if NAME.fullmatch(name) and not name.startswith("_manifest") for part, path in listed(self.spark, f"{self.folder}/{name}") if f"{name}/{part}" not in held]
        for path in gone:
            _removed(self.spark, path)
        for n in numbers[:-keep]:
            _removed(self.spark, f"{self.folder}/_manifest/{n}.json")
        return len(gone)


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """Each statement of a script, split at semicolons."""
    return [spark.sql(s) for s in script.split(";") if s.strip()]
