"""Running values over an ordered axis, in two levels: blocks of the axis by themselves, then what each block hands on.

A window by key alone is one task for each key, however long its history is.  Here rows are dealt by (key, block of the axis), windows run within
blocks, and one row for each block carries what the blocks before add up to (or those behind begin with).  So a key with a third of
all rows is as many tasks as it has blocks, and only its block rows meet.

The key is one struct, so keys with NULLs are groups like others and joins on them find each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

KEY, BLOCK = "__key", "__block"
#: Rows that a block should have if its width isn't given.
ROWS = 1 << 16
_LEAST = -(1 << 63)
DAY = 86_400


def blocked(df: DataFrame, by: tuple[str, ...], at: Column, width: float | None = None) -> DataFrame:
    """df with its key and the block of the axis, dealt by both.

    width is in units of the axis (seconds for timestamps, days for dates).  Without one, blocks of timestamps and dates are days
    and 32 days; those of numbers follow from the rows' number, least and greatest place, by one look at them in the same plan.  NULL places (minus
    infinity) are a block of their own, before all others.
    """
    kind = df.select(at.alias("at")).schema["at"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        place, width = F.unix_micros(at.cast("timestamp")), int((width or DAY) * 1_000_000)
    elif isinstance(kind, T.DateType):
        place, width = F.unix_date(at), int(width or 32)
    else:
        place = at
    df = df.withColumn(KEY, F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all")))
    place = place.cast("double")  # rounding doesn't change the order, and that is all blocks need
    if width is not None:
        df = df.withColumn(BLOCK, F.coalesce(F.floor(place / width), F.lit(_LEAST)))
    else:
        bounds = df.agg(F.min(place).alias("__low"), F.max(place).alias("__high"), F.count("*").alias("__n"))
        step = F.greatest((F.col("__high") - F.col("__low")) / F.ceil(F.col("__n") / ROWS), F.lit(1e-9))
        df = df.crossJoin(F.broadcast(bounds))  # one row
        df = df.withColumn(BLOCK, F.coalesce(F.floor((place - F.col("__low")) / step), F.lit(_LEAST))).drop("__low", "__high", "__n")
    return df.repartition(KEY, BLOCK)


def within(*order: Column | str) -> Window:
    return Window.partitionBy(KEY, BLOCK).orderBy(*order)


def upto(*order: Column | str) -> Window:
    return within(*order).rowsBetween(Window.unboundedPreceding, 0)


def carried(rows: DataFrame, **parts: tuple[str, Column]) -> DataFrame:
    """rows with what other blocks of their key hand on.  Each part is (how, aggregate of a block): ``last`` is the nearest block's before
    that isn't NULL, ``next`` the nearest one's behind, ``sum`` the sum of all before (0 if there is none)."""
    table = rows.groupBy(KEY, BLOCK).agg(*[a.alias(n) for n, (_, a) in parts.items()])
    before, behind = (Window.partitionBy(KEY).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(BLOCK).asc(), F.col(BLOCK).desc()))
    get = {"last": lambda n: F.last(n, True).over(before), "next": lambda n: F.last(n, True).over(behind), "sum": lambda n: F.coalesce(F.sum(n).over(before), F.lit(0))}
    table = table.select(KEY, BLOCK, *[get[how](n).alias(n) for n, (how, _) in parts.items()])
    return rows.join(table, [KEY, BLOCK])
