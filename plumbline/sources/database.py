"""Loading tables of a database over JDBC: all changes in one transaction."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import WarehouseError
from .settings import read_jdbc
from .sinks import identifier, nan_to_null


@dataclass(frozen=True)
class Change:
    """Rows for a table that is there. They override rows with the same ``keys``, or those of a ``scope`` (column, value), or all."""

    table: str
    frame: DataFrame
    keys: Sequence[str] = ()
    scope: tuple[str, object] | None = None


def connected(spark: SparkSession, url: str, user: str | None = None, password: str | None = None):
    manager = spark._jvm.java.sql.DriverManager
    return manager.getConnection(url, user, password) if user else manager.getConnection(url)


def executed(connection, sql: str, *values: object) -> int:
    statement = connection.prepareStatement(sql)
    try:
        for k, v in enumerate(values):
            statement.setObject(k + 1, v)
        return statement.executeUpdate()
    finally:
        statement.close()


def apply(spark: SparkSession, url: str, changes: Sequence[Change], user: str | None = None, password: str | None = None) -> dict[str, int]:
    """Rows inserted by table. Executors load staging tables; then one transaction moves all rows, or none."""
    options = {"user": user, "password": password} if user else {}
    staging = [f"{identifier(c.table)}_{uuid.uuid4().hex[:8]}" for c in changes]
    for c in changes:
        for name in [*c.frame.columns, *c.keys, *([c.scope[0]] if c.scope else [])]:
            identifier(name)
    connection, done = connected(spark, url, user, password), {}
    try:
        for c, stage in zip(changes, staging, strict=True):
            nan_to_null(c.frame, infinities=True).write.jdbc(url, stage, "overwrite", options)
        connection.setAutoCommit(False)
        try:
            for c, stage in zip(changes, staging, strict=True):
                if c.keys:
                    same = " AND ".join(f's."{k}" = t."{k}"' for k in c.keys)
                    executed(connection, f"DELETE FROM {c.table} t WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same})")
                elif c.scope:
                    executed(connection, f'DELETE FROM {c.table} WHERE "{c.scope[0]}" = ?', c.scope[1])
                else:
                    executed(connection, f"DELETE FROM {c.table}")
                columns = ", ".join(f'"{x}"' for x in c.frame.columns)
                done[c.table] = done.get(c.table, 0) + executed(connection, f"INSERT INTO {c.table} ({columns}) SELECT {columns} FROM {stage}")
            connection.commit()
        except Exception as error:
            connection.rollback()
            raise WarehouseError(f"nothing was loaded: {error}") from error
        connection.setAutoCommit(True)
    finally:
        if not connection.getAutoCommit():
            connection.setAutoCommit(True)
        for stage in staging:
            try:
                executed(connection, f"DROP TABLE {stage}")
            except Exception:  # noqa: BLE001  it was never made
                continue
        connection.close()
    return done


def wait_until_reachable(spark: SparkSession, url: str, probe: str = "(SELECT 1 AS one) probe", attempts: int = 10, wait: float = 1.0, **options: str) -> int:
    """Ask for one row until the database answers; the number of attempts that took."""
    for attempt in range(1, attempts + 1):
        try:
            read_jdbc(spark, url, probe, **options).limit(1).collect()
        except Exception as error:
            if attempt == attempts:
                raise WarehouseError(f"no answer after {attempts} attempts") from error
            time.sleep(wait)
        else:
            return attempt
    raise WarehouseError("attempts must be positive")
