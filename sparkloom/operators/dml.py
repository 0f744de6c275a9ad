"""Row-level changes as DataFrame to DataFrame operators, and snapshots of their results.

Files don't change in place: each operator gives the changed table lazily, and :class:`Snapshots` writes it beside the last
version and then switches a pointer.  Keys match null-safely nowhere: a row whose key has a NULL matches no other row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.expr import Expr, Marker, column
from ..plans.cut import cut
from ..plans.spec import condition, ordering


class NotFoundError(LookupError):
    pass


class NotInsertedError(ValueError):
    """Not all rows that had to be new were."""


class PlacementError(ValueError):
    pass


@dataclass(frozen=True)
class Changed:
    """The new table, and a lazy one-row table of counts (matched, changed)."""

    table: DataFrame
    counts: DataFrame


def aligned(rows: DataFrame, base: DataFrame, defaults: dict[str, Any] | None = None) -> DataFrame:
    """rows in the columns and types of base: columns that rows lack get their default (or NULL), unknown ones raise."""
    unknown = [c for c in rows.columns if c not in base.columns]
    if unknown:
        raise KeyError(f"unknown columns: {', '.join(unknown)}")
    defaults = defaults or {}
    types = {f.name: f.dataType for f in base.schema}
    return rows.select(*[(F.col(c) if c in rows.columns else column(defaults.get(c))).cast(types[c]).alias(c) for c in base.columns])


def first_by_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the least of all its columns' values, so reruns agree."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.dropDuplicates(key)
    return rows.groupBy(*key).agg(F.min(F.struct(*[F.struct(F.col(c).isNull(), c) for c in rest])).alias("__r")).select(*[F.col(c) if c in key else F.col(f"__r.col{rest.index(c) + 1}.{c}").alias(c) for c in rows.columns])


def new_rows(base: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, Any] | None = None) -> DataFrame:
    """The rows whose keys base doesn't have; of rows with one key the first."""
    return first_by_key(aligned(rows, base, defaults), key).join(base.select(*key), key, "left_anti").select(*base.columns)


def insert_ignore(base: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, Any] | None = None) -> DataFrame:
    """base and the rows whose keys it doesn't have; of rows with one key the first stays."""
    return base.unionByName(new_rows(base, rows, key, defaults))


def upsert(base: DataFrame, rows: DataFrame, key: list[str], on_match: dict[str, Any], defaults: dict[str, Any] | None = None) -> DataFrame:
    """New keys are inserted; rows of keys there are get the values of ``on_match``, which may name old columns (``this('x')``)
    and the new row's (``this('new.x')``)."""
    new = first_by_key(aligned(rows, base, defaults), key)
    names = {c: f"__new_{c}" for c in base.columns}
    right = new.select(*[F.col(c).alias(names[c]) for c in base.columns], F.lit(True).alias("__right"))
    left = base.withColumn("__left", F.lit(True))
    on = [F.col(k) == F.col(names[k]) for k in key]
    both = left.join(right, on, "full_outer")
    spoken = {}
    for c, v in on_match.items():
        spoken[c] = _of_new(v, names)
    kinds = {f.name: f.dataType for f in base.schema}
    cols = []
    for c in base.columns:
        changed = spoken[c].cast(kinds[c]) if c in spoken else F.col(c)
        cols.append(F.when(F.col("__left").isNull(), F.col(names[c])).when(F.col("__right").isNull(), F.col(c)).otherwise(changed).alias(c))
    return both.select(*cols)


def new(name: str) -> Expr:
    """The new row's column, in the values of an upsert."""
    return Expr(F.col(f"__new_{name}"))


def _of_new(value: Any, names: dict[str, str]) -> Column:
    return value.bare if isinstance(value, Expr) else column(None if isinstance(value, Marker) else value)


def replace(base: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, Any] | None = None) -> DataFrame:
    """Rows take the place of those with their keys; columns they lack go back to their defaults."""
    new_rows = first_by_key(aligned(rows, base, defaults), key)
    return base.join(new_rows.select(*key), key, "left_anti").select(*base.columns).unionByName(new_rows)


def first_hits(base: DataFrame, where: Column, limit: int, key: tuple[str, ...]) -> DataFrame:
    """The first ``limit`` rows, by key and then by all other columns, that the condition holds for: one sort of the matching rows."""
    if not key:
        raise ValueError("a limit needs a key")
    rest = [f.name for f in base.schema if f.name not in key and f.dataType.typeName() not in ("map", "variant")]
    return base.where(F.coalesce(where, F.lit(False))).orderBy(*ordering(key), *ordering(tuple(rest))).limit(limit)


def without(base: DataFrame, chosen: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """base less the chosen rows, each taken off once, so equal keys and equal rows are no matter.

    Only rows that have a chosen row's key are compared with these; all others go past a semi-join on the few keys.
    """
    keys = chosen.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(key)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(key)])
    return base.join(keys, on, "left_anti").unionAll(base.join(keys, on, "left_semi").exceptAll(chosen.select(*base.columns)))


def update(base: DataFrame, values: dict[str, Any], where: Column, limit: int | None = None, key: tuple[str, ...] = (), chosen: DataFrame | None = None) -> Changed:
    """Columns of the rows that the condition holds for get new values, all taken from the old row; of the first ``limit`` by key,
    or of the rows ``chosen``."""
    unknown = [c for c in values if c not in base.columns]
    if unknown:
        raise KeyError(f"unknown columns: {', '.join(unknown)}")
    if limit is not None and chosen is None:
        chosen = first_hits(base, where, limit, key)
    kinds = {f.name: f.dataType for f in base.schema}
    to = {c: (v.bare if isinstance(v, Expr) else column(None if isinstance(v, Marker) else v)).cast(kinds[c]) for c, v in values.items()}
    differs = F.lit(False)
    for c, v in to.items():
        differs = differs | ~F.col(c).eqNullSafe(v)
    hit = F.lit(True) if chosen is not None else F.coalesce(where, F.lit(False))
    rows = base if chosen is None else chosen
    table = rows.select(*[F.when(hit, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in base.columns])
    counts = rows.agg(F.count(F.when(hit, 1)).alias("matched"), F.count(F.when(hit & differs, 1)).alias("changed"))
    return Changed(table if chosen is None else without(base, chosen, key).unionAll(table), counts)


def update_keyed(base: DataFrame, values: dict[str, Any], key: list[str]) -> Changed:
    """Update the rows that agree with ``values`` in the key columns."""
    return update(base, {c: v for c, v in values.items() if c not in key}, condition(base, {k: values[k] for k in key}))


def delete(base: DataFrame, where: Column, limit: int | None = None, key: tuple[str, ...] = (), chosen: DataFrame | None = None) -> Changed:
    """The rows that the condition doesn't hold for; rows for which it is NULL stay.  limit and chosen are as in :func:`update`."""
    if limit is not None and chosen is None:
        chosen = first_hits(base, where, limit, key)
    hit = F.coalesce(where, F.lit(False))
    counts = (base.where(hit) if chosen is None else chosen).agg(F.count("*").alias("matched")).withColumn("changed", F.col("matched"))
    return Changed(base.where(~hit) if chosen is None else without(base, chosen, key), counts)


def with_ids(base: DataFrame, rows: DataFrame, column_name: str) -> DataFrame:
    """rows with increasing ids after base's largest, in the order of their own columns; not safe for concurrent writers.

    A running number over partitions: each partition counts by itself, and only partition counts meet.  The rows are sorted and
    written first, so a lost executor doesn't number them anew.
    """
    rows = cut(rows.orderBy(*rows.columns))
    top = base.agg(F.coalesce(F.max(column_name), F.lit(0)).alias("__top"))
    parts = rows.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__base")
    inner = F.col("__m") - F.shiftleft(F.col("__p").cast("bigint"), 33)
    return parts.join(F.broadcast(before), "__p").join(F.broadcast(top)).select(*rows.columns, (F.col("__top") + F.col("__base") + inner + 1).alias(column_name))


class Snapshots:
    """Versions of one table under a folder: data in ``v-<id>``, and the id in force in a one-row pointer table.

    The pointer is written after the data, so a reader sees either version whole.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[str]:
        try:
            rows = self.spark.read.parquet(f"{self.path}/pointer").orderBy("n").collect()  # one row for each publish
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return [r.version for r in rows]

    def read(self, version: str | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise NotFoundError(f"no version in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{version or known[-1]}")

    def publish(self, table: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        version, n = f"v-{uuid.uuid4().hex}", len(self.versions())
        table.write.partitionBy(*partition_by).parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(n, version)], "n int, version string").coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return version
