"""Piecewise-constant functions over an ordered axis, as segment tables.

A :class:`Lines` holds many functions at once: rows (key columns, start, end, value), segments of one key ordered, apart and
without gaps unless the function is undefined there.  ``end`` NULL is plus infinity, ``start`` NULL minus infinity.

Everything is a scan in two levels (:mod:`.scan`): breakpoints are dealt by key and block of the axis, windows carry values forward
within a block, and one row for each block hands its last value on; no window is by key alone but over these.  ``width`` is a block's width
on the axis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scan import BLOCK, KEY, blocked, carried, upto, within

A, B = "__a", "__b"


class Lines:
    def __init__(self, df: DataFrame | None, by: tuple[str, ...] = (), breaks: DataFrame | None = None, width: float | None = None):
        self._df, self.by, self.width = df, tuple(by), width
        self.breaks = breaks  # (by, at, value, rank), if each value holds until the next one's place; of one place the last by rank counts

    @property
    def df(self) -> DataFrame:
        """The segments; of breakpoints they are made when they are asked for, as overlays take breakpoints as they are."""
        if self._df is None:
            points = blocked(self.breaks, self.by, F.col("at"), self.width).groupBy(KEY, BLOCK, "at").agg(F.max_by("value", "rank").alias("value"))
            self._df = _segments(points, self.by)
        return self._df

    def _like(self, df: DataFrame, by: tuple[str, ...] | None = None) -> Lines:
        return Lines(df, self.by if by is None else by, width=self.width)

    def _keys(self) -> list[Column]:
        return [F.col(f"{KEY}.{b}").alias(b) for b in self.by]

    # making

    @classmethod
    def of_breaks(cls, df: DataFrame, start: str, value: str, by: tuple[str, ...] = (), tie: tuple[str, ...] = (), width: float | None = None) -> Lines:
        """From breakpoints: the value holds from ``start`` on until the key's next one (of equal starts the last by ``tie``)."""
        rank = F.struct(F.lit(1).alias("one"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie)]).alias("rank")
        breaks = df.select(*by, F.col(start).alias("at"), F.col(value).alias("value"), rank)
        return cls(None, tuple(by), breaks, width)

    # parts and points

    def clip(self, a=None, b=None) -> Lines:
        """What lies in [a, b); None is no bound."""
        start = F.col("start") if a is None else F.greatest(F.col("start"), F.lit(a))
        end = F.col("end") if b is None else F.least(F.col("end"), F.lit(b))
        df = self.df.select(*self.by, start.alias("start"), end.alias("end"), "value")
        return self._like(df.where(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < F.col("end"))))

    def delete(self, a, b) -> Lines:
        """Undefined in [a, b)."""
        left, right = self.clip(None, a), self.clip(b, None)
        return self._like(left.df.unionByName(right.df))

    def set(self, a, b, value) -> Lines:
        """``value`` in [a, b), for every key there is."""
        kinds = {f.name: f.dataType for f in self.df.schema}
        one = self.df.select(*self.by).distinct().select(*self.by, F.lit(a).cast(kinds["start"]).alias("start"), F.lit(b).cast(kinds["end"]).alias("end"), F.lit(value).cast(kinds["value"]).alias("value"))
        return self.update(self._like(one))

    def at(self, points: DataFrame, point: str) -> DataFrame:
        """points with ``value``, ``segment`` (its number among defined segments, from 0) at each: a sweep, not a range join.

        Segments and points of a key pass by in order and each point takes the last segment that began, in its block or handed on
        from those before; points that no segment covers get NULL, as do NULL points.
        """
        kind = dict(self.df.dtypes)["start"]
        segs = self.df.select(*self.by, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.struct("end", "value").alias("__seg"))
        pts = points.withColumns({"__at": F.col(point).cast(kind), "__kind": F.lit(1)})
        both = blocked(pts.where("__at is not null").unionByName(segs, allowMissingColumns=True), self.by, F.col("__at"), self.width)
        place = F.struct(F.col("__at").isNotNull(), "__at")
        both = carried(both, __before=("last", F.max_by(F.when(F.col("__kind") == 0, F.col("__seg")), F.when(F.col("__kind") == 0, place))), __count=("sum", F.count(F.when(F.col("__kind") == 0, 1))))
        w = upto(F.col("__at").asc_nulls_first(), "__kind")
        seen = F.coalesce(F.last("__seg", True).over(w), F.col("__before"))
        n = F.col("__count") + F.count("__seg").over(w)
        out = both.withColumns({"__seen": seen, "__n": n}).where("__kind = 1")
        inside = F.col("__seen").isNotNull() & (F.col("__seen.end").isNull() | (F.col("__at") < F.col("__seen.end")))
        out = out.select(*points.columns, F.when(inside, F.col("__seen.value")).alias("value"), F.when(inside, F.col("__n") - 1).alias("segment"))
        kinds = dict(out.dtypes)
        return out.unionByName(pts.where("__at is null").select(*points.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in ("value", "segment")]))

    def around(self, points: DataFrame, point: str) -> DataFrame:
        """points with ``left``, the greatest end of a segment at or before each, and ``right``, the least one behind it (NULL
        where there is none, and for NULL points): one sweep, as in :meth:`at`."""
        kind = dict(self.df.dtypes)["start"]
        edges = self.df.select(*self.by, F.explode(F.array("start", "end")).alias("__edge")).where(F.col("__edge").isNotNull())
        pts = points.withColumns({"__at": F.col(point).cast(kind), "__kind": F.lit(1)})
        both = pts.where("__at is not null").unionByName(edges.withColumns({"__at": F.col("__edge"), "__kind": F.lit(0)}), allowMissingColumns=True)
        both = carried(blocked(both, self.by, F.col("__at"), self.width), __left=("last", F.max("__edge")), __right=("next", F.min("__edge")))
        left = F.coalesce(F.last("__edge", True).over(upto("__at", "__kind")), F.col("__left"))
        right = F.coalesce(F.last("__edge", True).over(upto(F.desc("__at"), F.desc("__kind"))), F.col("__right"))
        out = both.withColumns({"__l": left, "__r": right}).where("__kind = 1").select(*points.columns, F.col("__l").alias("left"), F.col("__r").alias("right"))
        return out.unionByName(pts.where("__at is null").select(*points.columns, *[F.lit(None).cast(kind).alias(c) for c in ("left", "right")]))

    # overlay

    def overlay(self, other: Lines, f: Callable[[Column, Column], Column]) -> Lines:
        """f(value here, value there) on every stretch of both; NULL results are undefined stretches."""
        one = blocked(self._edges(A).unionByName(other._edges(B), allowMissingColumns=True), self.by, F.col("at"), self.width)
        # what happens at one place of one key, as one row: of each side the event that counts
        at = one.groupBy(KEY, BLOCK, "at").agg(*[F.max_by(side, f"{side}_rank").alias(side) for side in (A, B)])
        order = F.struct(F.col("at").isNotNull(), "at")
        at = carried(at, __a0=("last", F.max_by(A, F.when(F.col(A).isNotNull(), order))), __b0=("last", F.max_by(B, F.when(F.col(B).isNotNull(), order))))
        w = upto(F.col("at").asc_nulls_first())
        now = lambda side, before: F.coalesce(F.last(side, True).over(w), F.col(before))["v"]
        return self._like(_segments(at.select(KEY, BLOCK, "at", now(A, "__a0").alias(A), now(B, "__b0").alias(B)).select(KEY, BLOCK, "at", f(F.col(A), F.col(B)).alias("value")), self.by))

    def _edges(self, side: str) -> DataFrame:
        """Events (at, a struct of the value from there on, rank): where each segment begins, and where each ends; of breakpoints, which
        need no merging first, one for each."""
        if self.breaks is not None:
            return self.breaks.select(*self.by, "at", F.struct(F.col("value").alias("v")).alias(side), F.col("rank").alias(f"{side}_rank"))
        none = F.lit(None).cast(dict(self.df.dtypes)["value"])
        edge = F.array(*[F.struct(at.alias("at"), F.struct(v.alias("v")).alias("e"), F.lit(rank).alias("rank")) for at, v, rank in ((F.col("start"), F.col("value"), 1), (F.col("end"), none, 0))])
        rows = self.df.select(*self.by, F.explode(edge).alias("e")).where((F.col("e.rank") == 1) | F.col("e.at").isNotNull())
        return rows.select(*self.by, F.col("e.at").alias("at"), F.col("e.e").alias(side), F.col("e.rank").alias(f"{side}_rank"))

    def zip(self, other: Lines) -> Lines:
        """Pairs where both are defined."""
        return self.overlay(other, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b"))))

    def xzip(self, other: Lines) -> Lines:
        """Pairs where either is defined."""
        return self.overlay(other, lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.struct(a.alias("a"), b.alias("b"))))

    def update(self, other: Lines) -> Lines:
        return self.overlay(other, lambda a, b: F.coalesce(b, a))

    def merge(self, other: Lines) -> Lines:
        return self.overlay(other, lambda a, b: F.coalesce(a, b))

    def stripby(self, other: Lines) -> Lines:
        """This one where both are defined."""
        return self.overlay(other, lambda a, b: F.when(b.isNotNull(), a))

    def diff(self, other: Lines) -> Lines:
        """This one where the other differs or is undefined."""
        return self.overlay(other, lambda a, b: F.when(~a.eqNullSafe(b), a))

    def __add__(self, other):
        """Undefined where this one is; the other counts 0 where it isn't defined.  A number is added everywhere."""
        if not isinstance(other, Lines):
            return self.map(lambda v: v + other)
        return self.overlay(other, lambda a, b: a + F.coalesce(b, F.lit(0)))

    def __sub__(self, other):
        if not isinstance(other, Lines):
            return self.map(lambda v: v - other)
        return self.overlay(other, lambda a, b: a - F.coalesce(b, F.lit(0)))

    def map(self, value: Callable[[Column], Column] | None = None, point: Callable[[Column], Column] | None = None) -> Lines:
        """Other values, and other places (by an increasing function)."""
        v = value(F.col("value")) if value else F.col("value")
        p = point or (lambda c: c)
        return self._like(_merged(self.df.select(*self.by, p(F.col("start")).alias("start"), p(F.col("end")).alias("end"), v.alias("value")), self.by, self.width))

    def sharded(self, cuts: list, name: str = "_piece") -> Lines:
        """Cut at the given points: pieces become keys, so that one long function is worked on by many tasks."""
        edges = [None, *cuts, None]
        pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
        rows = self.df.withColumn("__p", F.explode(pieces))
        start, end = F.greatest(F.col("start"), F.col("__p.a")), F.least(F.col("end"), F.col("__p.b"))
        rows = rows.select(*self.by, F.col("__p.i").alias(name), start.alias("start"), end.alias("end"), "value").where("start is null or end is null or start < end")
        return self._like(rows, (*self.by, name))

    def joined(self, name: str = "_piece") -> Lines:
        """Pieces of :meth:`sharded` as whole functions again."""
        by = tuple(b for b in self.by if b != name)
        return self._like(_merged(self.df.select(*by, "start", "end", "value"), by, self.width), by)

    # answers, one row for each key

    def defined(self) -> DataFrame:
        return self.df.where(F.col("value").isNotNull())

    def split(self) -> DataFrame:
        """One row for each segment with its number."""
        rows = carried(blocked(self.defined(), self.by, F.col("start"), self.width), __n=("sum", F.count("*")))
        return rows.select(*self.df.columns, (F.col("__n") + F.row_number().over(within(F.col("start").asc_nulls_first())) - 1).alias("segment"))

    def measure(self) -> DataFrame:
        """Total length of the defined segments (NULL if one is unbounded)."""
        length = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.col("end") - F.col("start"))
        bounded = F.count(length) == F.count(F.lit(1))
        return self.defined().groupBy(*self.by).agg(F.when(bounded, F.sum(length)).alias("measure"))

    def integral(self) -> DataFrame:
        """Sum of value times length (NULL if a segment is unbounded)."""
        part = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.col("value") * (F.col("end") - F.col("start")))
        return self.defined().groupBy(*self.by).agg(F.when(F.count(part) == F.count(F.lit(1)), F.sum(part)).alias("integral"))

    def quadrature(self, f: Callable[[Column, Column], Column], precision: float = 0.1) -> DataFrame:
        """Left Riemann sum of f(point, value) in steps of ``precision``."""
        steps = F.ceil((F.col("end") - F.col("start")) / precision - F.lit(1e-9)).cast("int")
        rows = self.defined().where("start is not null and end is not null and start < end").select(*self.by, "start", "end", "value", F.explode(F.sequence(F.lit(0), steps - 1)).alias("i"))
        x = F.col("start") + F.col("i") * precision
        return rows.groupBy(*self.by).agg(F.sum(f(x, F.col("value")) * F.least(F.lit(precision), F.col("end") - x)).alias("integral"))

    def count(self) -> DataFrame:
        return self.defined().groupBy(*self.by).agg(F.count("*").alias("segments"))

    def bounds(self) -> DataFrame:
        """left and right end of each function (NULL if unbounded)."""
        left = F.when(F.count("start") == F.count(F.lit(1)), F.min("start"))
        right = F.when(F.count("end") == F.count(F.lit(1)), F.max("end"))
        return self.defined().groupBy(*self.by).agg(left.alias("left"), right.alias("right"))

    def continuity(self) -> DataFrame:
        """Whether each function is defined on one stretch without gaps."""
        place = F.struct(F.col("start").isNotNull(), "start")
        rows = carried(blocked(self.defined(), self.by, F.col("start"), self.width), __before=("last", F.max_by(F.struct("end"), place)))
        prev = F.coalesce(F.lag(F.struct("end")).over(within(F.col("start").asc_nulls_first())), F.col("__before"))
        fits = F.when(F.col("__prev").isNull(), True).otherwise(F.coalesce(F.col("__prev.end") == F.col("start"), F.lit(False)))
        return rows.withColumn("__prev", prev).groupBy(*self.by).agg(F.every(fits).alias("continuous"))

    def complete(self, a, b) -> DataFrame:
        """Whether each function is defined on all of [a, b)."""
        inner = self.clip(a, b)
        return inner.measure().select(*self.by, (F.col("measure") == F.lit(b) - F.lit(a)).alias("complete"))

    def same(self, other: Lines) -> bool:
        mine, theirs = self.defined().select(*self.by, "start", "end", "value"), other.defined().select(*self.by, "start", "end", "value")
        return mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()

    def to_map(self) -> DataFrame:
        """One array of (start, value) for each key; as large as the function, so for output only."""
        return self.defined().groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("breaks"))


def _segments(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Segments of (key, block, at, value), where each value holds until the next place and a place is one row.

    Equal neighbours go within each block; then one row for each block (its first place, the second one kept, its last value) tells whether
    its first place changes anything, and where the next change behind the block is.
    """
    order = F.col("at").asc_nulls_first()
    local = points.select(KEY, BLOCK, "at", "value", F.lag(F.struct("value")).over(within(order)).alias("__was"))
    local = local.where(F.col("__was").isNull() | ~F.col("__was.value").eqNullSafe(F.col("value"))).withColumn("end", F.lead("at").over(within(order)))
    table = local.groupBy(KEY, BLOCK).agg(
        F.first(F.when(F.col("__was").isNull(), F.struct("at", "value")), True).alias("first"),
        F.min(F.when(F.col("__was").isNotNull(), F.col("at"))).alias("second"),
        F.max_by(F.struct("value"), F.struct(F.col("at").isNotNull(), "at")).alias("last"),
    )
    before, behind = Window.partitionBy(KEY).orderBy(BLOCK), Window.partitionBy(KEY).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("__was", F.lag("last").over(before))
    table = table.withColumn("fresh", F.col("__was").isNull() | ~F.col("__was.value").eqNullSafe(F.col("first.value")))
    table = table.select(KEY, BLOCK, "fresh", F.last(F.when(F.col("fresh"), F.col("first.at")).otherwise(F.col("second")), True).over(behind).alias("next"))
    out = local.where("value is not null").join(table, [KEY, BLOCK]).where(F.col("__was").isNotNull() | F.col("fresh"))
    return out.select(*[F.col(f"{KEY}.{b}").alias(b) for b in by], F.col("at").alias("start"), F.coalesce("end", "next").alias("end"), "value")


def _merged(df: DataFrame, by: tuple[str, ...], width: float | None) -> DataFrame:
    """Neighbours with equal values become one; undefined stretches go."""
    edge = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("rank"), F.col("value").alias("v")), F.struct(F.col("end").alias("at"), F.lit(0).alias("rank"), F.lit(None).cast(dict(df.dtypes)["value"]).alias("v")))
    edges = df.where("value is not null").select(*by, F.explode(edge).alias("e")).where((F.col("e.rank") == 1) | F.col("e.at").isNotNull()).select(*by, "e.*")
    return _segments(blocked(edges, by, F.col("at"), width).groupBy(KEY, BLOCK, "at").agg(F.max_by("v", "rank").alias("value")), by)
