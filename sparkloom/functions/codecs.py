"""Column codecs: ``en`` maps a column to its stored form, ``de`` back; both are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Codec:
    en: Callable[[Column], Column]
    de: Callable[[Column], Column]


@dataclass(frozen=True)
class GroupCodec:
    """Several columns (``inputs``) stored as others (``stored``), of any number: ``en`` and ``de`` take columns in that order and
    give columns in the other's."""

    inputs: tuple[str, ...]
    stored: tuple[str, ...]
    en: Callable[..., tuple[Column, ...]]
    de: Callable[..., tuple[Column, ...]]

    def encoded(self, *inputs: Column) -> dict[str, Column]:
        return dict(zip(self.stored, self.en(*inputs), strict=True))

    def decoded(self) -> dict[str, Column]:
        return dict(zip(self.inputs, self.de(*map(F.col, self.stored)), strict=True))


def enum_int(items: list[str]) -> Codec:
    """A value as its place in a list (from 0); values and places outside the list are NULL."""
    table = F.array(*[F.lit(x) for x in items])

    def en(c: Column) -> Column:
        at = F.array_position(table, c)
        return F.when(at > 0, (at - 1).cast("int"))

    return Codec(en, lambda c: F.when(c >= 0, F.get(table, c.cast("int"))))


def bit_set(items: list[str]) -> Codec:
    """An array of listed items as bits, item i as bit i; repeated items count once.  Up to 63 items as BIGINT."""
    if len(items) > 63:
        raise ValueError("at most 63 items")
    table = F.array(*[F.lit(x) for x in items])

    def en(c: Column) -> Column:
        known = F.array_distinct(F.filter(F.transform(c, lambda x: F.array_position(table, x)), lambda i: i > 0))
        return F.aggregate(known, F.lit(0).cast("bigint"), lambda a, i: a + F.call_function("shiftleft", F.lit(1).cast("bigint"), (i - 1).cast("int")))

    def de(c: Column) -> Column:
        return F.filter(table, lambda x, i: F.call_function("shiftright", c.cast("bigint"), i.cast("int")).bitwiseAND(F.lit(1)) == 1)

    return Codec(en, lambda c: F.when(c.isNotNull(), de(c)))


def any_json(schema: str) -> Codec:
    return Codec(F.to_json, lambda c: F.from_json(c, schema))


HEX_BIN = Codec(F.unhex, lambda c: F.lower(F.hex(c)))
BOOL_BIN = Codec(lambda c: F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), lambda c: F.coalesce(c == F.unhex(F.lit("01")), F.lit(False)))
BOOL_NULL = Codec(lambda c: F.when(c, F.unhex(F.lit("01"))), lambda c: c.isNotNull())
DATETIME_SQL = Codec(lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), lambda c: c.cast("timestamp_ntz"))
