"""Groups of equal content, runs of integers, buckets for charts, trees by level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.cut import cut
from . import scan


def duplicates(df: DataFrame, content: str, by: str) -> DataFrame:
    """digest, copies, first (the least ``by``) of contents that occur more than once."""
    return df.groupBy(F.md5(F.col(content).cast("binary")).alias("digest")).agg(F.count("*").alias("copies"), F.min(by).alias("first")).where("copies > 1")


def shared_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values that several keys have, with how many and the least and greatest of them."""
    return df.groupBy(value).agg(F.count_distinct(key).alias("keys"), F.min(key).alias("low"), F.max(key).alias("high")).where("keys > 1")


def int_ranges(df: DataFrame, column: str, by: tuple[str, ...] = (), width: int = 1 << 16) -> DataFrame:
    """Runs of consecutive integers as (start, end) rows.

    Numbers less their place among the group's numbers are equal within a run and differ between runs.  Places are counted in blocks of
    ``width`` integers with the blocks' totals carried on, and a run's blocks are one row each before they meet.
    """
    rows = scan.blocked(df.select(*by, F.col(column).cast("bigint").alias("x")).where("x is not null"), by, F.col("x"), width)
    rows = scan.carried(rows.select(scan.KEY, scan.BLOCK, "x").distinct(), __n=("sum", F.count("*")))
    run = F.col("x") - F.col("__n") - F.row_number().over(scan.within("x"))
    runs = rows.select(scan.KEY, "x", run.alias("run")).groupBy(scan.KEY, "run").agg(F.min("x").alias("start"), F.max("x").alias("end"))
    return runs.select(*[F.col(f"{scan.KEY}.{b}").alias(b) for b in by], "start", "end")


def chart_buckets(df: DataFrame, value: str, height: int, by: tuple[str, ...] = (), levels: int = 4) -> DataFrame:
    """How many values fall in each of ``levels * height`` steps from 0 to the group's largest."""
    top = df.groupBy(*by).agg(F.max(value).alias("__top"))
    rows = df.join(top, list(by)) if by else df.crossJoin(F.broadcast(top))  # one row
    step = F.when(F.col("__top") > 0, F.floor(F.col(value) * (levels * height) / F.col("__top"))).otherwise(0)
    return rows.groupBy(*by, step.cast("int").alias("step")).agg(F.count("*").alias("n"))


def nice_step(span: float, ticks: int = 5) -> float:
    """The least of 1, 2, 5 times a power of ten that cuts a span into at most ``ticks`` parts."""
    if span <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(span / ticks))
    return next(m * power for m in (1, 2, 5, 10) if span / (m * power) <= ticks)


def bars(values: list[float], height: int = 4) -> list[str]:
    """A small chart of a few values as rows of text, the highest row first."""
    top = max([*values, 0]) or 1
    marks = " ▁▂▃▄▅▆▇█"
    full = [round(max(0, v) / top * height * 8) for v in values]
    return ["".join(marks[min(8, max(0, f - 8 * r))] for f in full) for r in range(height - 1, -1, -1)]


def tree_levels(edges: DataFrame, roots: Column, child: str = "child", parent: str = "parent", most: int = 10_000) -> DataFrame:
    """node, depth, path of a forest, breadth first: one join for each level, until a level is empty.

    Node ids are kept as text in the path, filled up to one width, so the path is also the depth-first order.  A forest of more
    than ``most`` levels, so one with a cycle below a root, raises.
    """
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("parent"))
    width = max(1, e.agg(F.max(F.length(F.col("node").cast("string")))).first()[0] or 1)
    shown = lambda c: F.lpad(c.cast("string"), width, " ")
    level = cut(edges.where(roots).select(F.col(child).alias("node")).select("node", F.lit(0).alias("depth"), shown(F.col("node")).alias("path")))
    done, depth = level, 0
    while not level.isEmpty():
        depth += 1
        if depth > most:
            raise ValueError(f"more than {most} levels")
        up = level.select(F.col("node").alias("__up"), F.col("path").alias("__path"))
        level = cut(e.join(up, F.col("parent") == F.col("__up")).select("node", F.lit(depth).alias("depth"), F.concat("__path", F.lit("/"), shown(F.col("node"))).alias("path")))
        done = done.unionByName(level)
        if depth % 50 == 0:  # else a plan of very many branches
            done = cut(done)
    return done


def range_lookup(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, name: str, gap: str | None = None, broadcast_rows: int = 500_000) -> DataFrame:
    """points with the name of the range (both ends included) they lie in; ranges don't overlap.

    The axis is cut into as many blocks as there are ranges, so ranges lie in two blocks each on average however wide some are, and
    points meet the ranges of their own block.  Up to ``broadcast_rows`` such rows are broadcast, so points stay where they are
    even if all lie in one block; more are joined by a shuffle, which adaptive execution splits where a block is hot.
    """
    r = ranges.select(F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e"), F.col(name).alias("__name")).where("__s <= __e")
    n, low, high = r.agg(F.count("*"), F.min("__s"), F.max("__e")).first()
    width = max(1, -(-(high - low + 1) // n)) if n else 1
    block = lambda c: F.expr(f"{c} div {width}L") - F.when(F.expr(f"{c} < 0 and {c} % {width}L <> 0"), 1).otherwise(0)  # noqa: E731  rounded down, exactly
    r = r.withColumn("__b", F.explode(F.sequence(block("__s"), block("__e"))))
    p = points.withColumn("__p", F.col(point).cast("bigint")).withColumn("__b", block("__p"))
    r = F.broadcast(r) if n <= broadcast_rows // 2 else r
    hit = (p["__b"] == r["__b"]) & (F.col(point) >= F.col("__s")) & (F.col(point) <= F.col("__e"))
    return p.join(r, hit, "left").select(*points.columns, F.coalesce("__name", F.lit(gap)).alias(name))


def with_gaps(ranges: DataFrame, start: str, end: str, name: str, gap: str) -> DataFrame:
    """ranges and, where the next one doesn't follow at once, a row for the gap.  A small dimension: one ordered pass."""
    w = Window.orderBy(start)
    nxt = ranges.withColumn("__n", F.lead(start).over(w)).where(F.col("__n") > F.col(end) + 1)
    return ranges.select(start, end, name).unionByName(nxt.select((F.col(end) + 1).alias(start), (F.col("__n") - 1).alias(end), F.lit(gap).alias(name)))
