"""Newest row of a key. Ids order rows, never times; ``max_by`` over a struct keeps all columns and combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | list[str], order: str = "id") -> DataFrame:
    """The row of greatest ``order`` for each key, with all columns."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def latest_value(rows: DataFrame, key: str, value: Column, order: str = "id", name: str = "value") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.col(order)).alias(name))


def newest_or_stored(stored: DataFrame, amendments: DataFrame, key: str, column: str, order: str = "id") -> DataFrame:
    """``stored`` with ``column`` replaced by the newest amendment of its key, where there is one."""
    new = latest_value(amendments, key, F.col(column), order, "_new")
    return stored.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def newest_if_open(bindings: DataFrame, ended: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """Newest binding of each key; none if its task has ended. An older binding is not brought back."""
    return latest(bindings, key, order).join(ended.select("task_id"), "task_id", "left_anti")


def newest_first(rows: DataFrame, k: int, order: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(k)


def top_per(rows: DataFrame, key: str, k: int, order: Column, name: str = "top") -> DataFrame:
    """The k greatest ``order`` structs of each key, best first, without a window over the whole group."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order, k).alias(name)) if k > 1 else latest(rows, key)
