"""What one table access asks for, read from an index: names, expressions, conditions and one slice.

``t['a', this('b').rename('c'), {'k': 1}, this('d') > 3, 10:50:('~a', group('k'))]`` - the slice is offset : limit : order
and groups.  A slice (even ``::``) makes the answer a table; without one the access stands for exactly one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import Condition, Expr, Within, aggregates_in, column, is_null


class group:  # noqa: N801
    """Columns or expressions to group by, in a slice's third place."""

    def __init__(self, *keys):
        self.keys = keys


class option:  # noqa: N801
    def __init__(self, name: str):
        self.name = name


NO_CACHE, FOUND_ROWS = option("no_cache"), option("found_rows")


@dataclass(frozen=True)
class QuerySpec:
    columns: tuple = ()
    equals: dict = field(default_factory=dict)
    conditions: tuple[Condition, ...] = ()
    offset: int | dict = 0
    limit: int | None = None
    order: tuple[str, ...] = ()
    groups: tuple = ()
    options: tuple = ()
    single: bool = True
    within: tuple[Within, ...] = ()


def parse(index: Any) -> QuerySpec:
    items = index if isinstance(index, tuple) else (index,)
    columns, equals, conditions, options, within = [], {}, [], [], []
    offset, limit, order, groups, single = 0, None, [], [], True
    for x in _flat(items):
        if isinstance(x, slice):
            if not single:
                raise ValueError("one slice at most")
            single, offset, limit = False, x.start or 0, x.stop
            for y in _flat((x.step,) if x.step is not None else ()):
                if isinstance(y, group):
                    groups.extend(y.keys)
                elif isinstance(y, option):
                    options.append(y)
                else:
                    order.append(y)
        elif isinstance(x, dict):
            equals |= x
        elif isinstance(x, Condition) and not x.name:
            conditions.append(x)
        elif isinstance(x, Within):
            within.append(x)
        elif isinstance(x, option):
            options.append(x)
        elif isinstance(x, (str, Expr, Column)):
            columns.append(x)
        else:
            raise TypeError(f"not a column, a condition or a slice: {x!r}")
    if limit is not None and limit < 0 or isinstance(offset, int) and offset < 0:
        raise ValueError("offset and limit count rows from 0")
    return QuerySpec(tuple(columns), equals, tuple(conditions), offset, limit, tuple(order), tuple(groups), tuple(options), single, tuple(within))


def _flat(items):
    for x in items:
        if isinstance(x, (tuple, list)):
            yield from _flat(x)
        else:
            yield x


def condition(df: DataFrame, equals: dict, conditions=()) -> Column:
    """Equalities and conditions, all of which must hold.  An unknown column raises; it is never left out."""
    unknown = [k for k in equals if k not in df.columns]
    if unknown:
        raise KeyError(f"unknown columns: {', '.join(unknown)}")
    parts = [F.col(k).isNull() if is_null(v) else F.col(k) == column(v) for k, v in equals.items()]
    parts += [c.bare if isinstance(c, Expr) else column(c) for c in conditions]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def ordering(names: tuple[str, ...]) -> list[Column]:
    """``~name`` is descending; NULLs come first ascending and last descending."""
    return [F.col(n[1:]).desc_nulls_last() if n.startswith("~") else F.col(n).asc_nulls_first() for n in names]


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def where(df: DataFrame, spec: QuerySpec) -> DataFrame:
    df = df.where(condition(df, spec.equals, spec.conditions)) if spec.equals or spec.conditions else df
    for w in spec.within:
        rows = w.rows.select(F.col(f"`{w.rows.columns[0]}`").alias("__within"))
        df = df.join(rows, w.value.bare == F.col("__within"), "left_semi")
    return df


def run(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The lazy DataFrame of a spec: filter, group, order, offset, limit, project."""
    df = where(df, spec)
    if spec.groups or (spec.columns and any(_aggregate(c) for c in spec.columns)):
        keys = [F.col(k) if isinstance(k, str) else column(k) for k in spec.groups]
        named = {k for k in spec.groups if isinstance(k, str)} | {k.name for k in spec.groups if isinstance(k, Expr) and k.name}
        aggs = [column(c) for c in spec.columns if not isinstance(c, str) and not (isinstance(c, Expr) and c.name in named)]
        plain = [c for c in spec.columns if isinstance(c, str) and c not in named]
        aggs += [F.min(c).alias(c) for c in plain]
        df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        wanted = [c if isinstance(c, str) else c.name for c in spec.columns if isinstance(c, str) or (isinstance(c, Expr) and c.name)]
        pick = wanted if len(wanted) == len(spec.columns) and spec.columns else None
        df = _paged(df, spec)
        return df.select(*pick) if pick else df
    df = _paged(df, spec)
    return df.select(*([F.col(c) if isinstance(c, str) else column(c) for c in spec.columns] or visible(df)))


def _paged(df: DataFrame, spec: QuerySpec) -> DataFrame:
    if spec.order:
        df = df.orderBy(*ordering(spec.order))
    if isinstance(spec.offset, int) and spec.offset:
        df = df.offset(spec.offset)
    return df if spec.limit is None else df.limit(spec.limit)


def _aggregate(c: Any) -> bool:
    """Whether a column of a spec is an aggregate: expressions say so themselves; of a bare Column its text tells."""
    if isinstance(c, str):
        return False
    return c.aggregate if isinstance(c, Expr) else aggregates_in(str(c))
