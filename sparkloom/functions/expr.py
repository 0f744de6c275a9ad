"""Composable column expressions: ``this('a') + 1``, ``this('a') == null()``, ``cond % (x, y)``, ``func('upper')(...)``.

Every expression is immutable and wraps a Spark ``Column``; values become typed literals and are never put into SQL text.
Division by zero gives NULL; comparing with ``null()`` or ``None`` asks whether the value is NULL.
"""

from __future__ import annotations

import datetime
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


class Marker:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return f"{self.name}()"


_NULL, _DEFAULT = Marker("null"), Marker("default")


def null() -> Marker:
    """SQL NULL, as a value or to compare with."""
    return _NULL


def default() -> Marker:
    """A column's default, as a value to write."""
    return _DEFAULT


def is_null(x: Any) -> bool:
    return x is None or x is _NULL


def column(x: Any) -> Column:
    """A Column of an expression, a value, or any object with ``to_column()``."""
    if isinstance(x, Column):
        return x
    if hasattr(x, "to_column"):
        return x.to_column()
    if is_null(x):
        return F.lit(None)
    if isinstance(x, datetime.datetime):
        return F.lit(x.replace(microsecond=0))
    return F.lit(x)


#: Fixed word list: Spark's aggregate functions.
AGGREGATES = frozenset(
    "any any_value approx_count_distinct approx_percentile array_agg avg bit_and bit_or bit_xor bitmap_construct_agg bitmap_or_agg bool_and "
    "bool_or collect_list collect_set corr count count_distinct count_if count_min_sketch covar_pop covar_samp every first first_value "
    "grouping grouping_id histogram_numeric hll_sketch_agg hll_union_agg kurtosis last last_value listagg max max_by mean median min min_by "
    "mode percentile percentile_approx percentile_cont percentile_disc product regr_avgx regr_avgy regr_count regr_intercept regr_r2 "
    "regr_slope regr_sxx regr_sxy regr_syy schema_of_variant_agg skewness some std stddev stddev_pop stddev_samp string_agg sum try_avg "
    "try_sum var_pop var_samp variance".split()
)
#: Functions that run code of the caller's choice; they have no place in a query.
REFUSED = frozenset("java_method reflect try_reflect".split())


def aggregates_in(sql: str) -> bool:
    """Whether SQL text calls an aggregate; names within quotes don't count."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", sql)
    return any(m.lower() in AGGREGATES for m in re.findall(r"([A-Za-z_]\w*)\s*\(", bare))


class Expr:
    """An expression over one row, or (``aggregate``) over a group: what is made of an aggregate is one, too."""

    def __init__(self, col: Column, name: str | None = None, aggregate: bool = False):
        self._col, self.name, self.aggregate = col, name, aggregate

    def _made(self, col: Column, *others: Any, kind: type | None = None) -> Expr:
        """An expression made of this one and others."""
        return (kind or Expr)(col, aggregate=self.aggregate or any(isinstance(x, Expr) and x.aggregate for x in others))

    def to_column(self) -> Column:
        return self._col.alias(self.name) if self.name else self._col

    @property
    def bare(self) -> Column:
        return self._col

    def _other(self, x: Any) -> Column:
        return x.bare if isinstance(x, Expr) else column(x)

    def __add__(self, x):
        return self._made(self._col + self._other(x), x)

    def __radd__(self, x):
        return self._made(self._other(x) + self._col, x)

    def __sub__(self, x):
        return self._made(self._col - self._other(x), x)

    def __rsub__(self, x):
        return self._made(self._other(x) - self._col, x)

    def __mul__(self, x):
        return self._made(self._col * self._other(x), x)

    def __rmul__(self, x):
        return self._made(self._other(x) * self._col, x)

    def __truediv__(self, x):
        return self._made(F.try_divide(self._col, self._other(x)), x)

    def __rtruediv__(self, x):
        return self._made(F.try_divide(self._other(x), self._col), x)

    def __eq__(self, x):  # type: ignore[override]
        return self._made(self._col.isNull() if is_null(x) else self._col == self._other(x), x, kind=Condition)

    def __ne__(self, x):  # type: ignore[override]
        return self._made(self._col.isNotNull() if is_null(x) else self._col != self._other(x), x, kind=Condition)

    def __gt__(self, x):
        return self._made(self._col > self._other(x), x, kind=Condition)

    def __ge__(self, x):
        return self._made(self._col >= self._other(x), x, kind=Condition)

    def __lt__(self, x):
        return self._made(self._col < self._other(x), x, kind=Condition)

    def __le__(self, x):
        return self._made(self._col <= self._other(x), x, kind=Condition)

    __hash__ = object.__hash__

    def __getitem__(self, part: slice) -> Expr:
        """``e[n:]`` drops n characters, ``e[:n]`` keeps the first n; no other slices."""
        if not isinstance(part, slice) or part.step is not None or (part.start is None) == (part.stop is None):
            raise ValueError("give one bound: e[n:] or e[:n]")
        n = part.start if part.start is not None else part.stop
        if n < 0:
            raise ValueError("a bound is a number of characters from 0")
        return self._made(F.substring(self._col, n + 1, 2**31 - 1) if part.start is not None else F.left(self._col, F.lit(n)))

    def rename(self, name: str) -> Expr:
        return type(self)(self._col, name, self.aggregate)

    def len(self) -> Expr:
        """Length in bytes."""
        return self._made(F.octet_length(self._col))

    def asbinary(self) -> Expr:
        return self._made(self._col.cast("binary"))

    def startswith(self, text: str) -> Condition:
        """An empty prefix holds for every row."""
        return self._made(self._col.startswith(text) if text else F.lit(True), kind=Condition)

    def endswith(self, text: str) -> Condition:
        return self._made(self._col.endswith(text), kind=Condition)

    def hassub(self, text: str) -> Condition:
        return self._made(self._col.contains(text), kind=Condition)

    def lsubby(self, delimiter: str, n: int) -> Expr:
        """The text before the n-th delimiter."""
        return self._made(F.substring_index(self._col, delimiter, n))

    def rsubby(self, delimiter: str, n: int) -> Expr:
        """The text after the n-th delimiter from the right."""
        return self._made(F.substring_index(self._col, delimiter, -n))

    def isin(self, rows) -> Condition | Within:
        """One of some values; or of the first column of a DataFrame, so of another access: ``this('a').isin(t['b', ::])``."""
        if isinstance(rows, DataFrame):
            return Within(self, rows)
        return self._made(self._col.isin(list(rows)), kind=Condition)

    def running(self, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> Expr:
        """An aggregate over the rows up to each one, in an order: the running form of a variable carried from row to row."""
        if not self.aggregate or not order:
            raise ValueError("a running value is an aggregate in an order")
        return Expr(self._col.over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), self.name)


class Within:
    """A condition that a value is among another table's: a semi-join."""

    def __init__(self, value: Expr, rows: DataFrame):
        self.value, self.rows = value, rows


class Condition(Expr):
    """A boolean expression; ``c % (x, y)`` is x where c holds and y elsewhere (also where c is NULL)."""

    def __mod__(self, pair):
        x, y = pair
        return self._made(F.when(self._col, self._other(x)).otherwise(self._other(y)), x, y)

    def __and__(self, x):
        return self._made(self._col & self._other(x), x, kind=Condition)

    def __or__(self, x):
        return self._made(self._col | self._other(x), x, kind=Condition)

    def __invert__(self):
        return self._made(~self._col, kind=Condition)

    def expr(self) -> Expr:
        """The condition as a number: 1, 0 or NULL."""
        return self._made(self._col.cast("int"))


def this(name: str) -> Expr:
    return Expr(F.col(name))


def expr(sql: str) -> Expr:
    """Raw SQL text, for what the API has no form for; never build it from values (use ``spark.sql(..., args=)``)."""
    return Expr(F.expr(sql), aggregate=aggregates_in(sql))


def cond(sql: str) -> Condition:
    return Condition(F.expr(sql))


def var(name: str) -> Expr:
    """A session variable (``DECLARE VARIABLE``)."""
    return Expr(F.expr(f"session.`{name.replace('`', '``')}`"))


def func(name: str):
    """Any of Spark's SQL functions by its name: ``func('upper')(this('a'))``; '*' counts as a value that is never NULL.

    Names that the session's function registry doesn't know are refused, and those that run foreign code (:data:`REFUSED`).
    """
    low = name.lower()
    if not name.replace("_", "").isalnum() or low in REFUSED:
        raise ValueError(f"not a function's name: {name!r}")

    def call(*args) -> Expr:
        spark = SparkSession.getActiveSession()
        if spark is not None and not hasattr(F, low) and not spark.catalog.functionExists(low):
            raise ValueError(f"no such function: {name!r}")
        cols = [F.lit(1) if isinstance(a, str) and a == "*" else (a.bare if isinstance(a, Expr) else column(a)) for a in args]
        return Expr(F.call_function(low, *cols), aggregate=low in AGGREGATES or any(isinstance(a, Expr) and a.aggregate for a in args))

    return call


SUM, COUNT, MAX, MIN, HEX = (func(x) for x in ("sum", "count", "max", "min", "hex"))


def IF(c: Condition, x, y) -> Expr:  # noqa: N802
    return c % (x, y)
