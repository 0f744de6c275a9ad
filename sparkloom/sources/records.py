"""Binary records by a layout: fields, groups of fields that repeat, and parts that a tag chooses.

A layout is a list of :class:`Field`, :class:`Group` and :class:`Choice`.  It becomes one struct expression over a binary column, so
records are decoded in the scan, without a parser at run time.  A byte cursor goes from part to part; over a group's records, whose lengths may
differ, it is folded.  Counts and sizes are numbers, names of earlier fields (of the same record or of one around it), or functions of these:
``lambda seen: nz(seen["flag"], seen["size"])``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F

from ..functions.binary import bits, int_be, uint_be, uint_le

Size = int | str | Callable[[dict[str, Column]], Column] | None


@dataclass(frozen=True)
class Field:
    """kind: uint, uint_b, int_b, uint_nz, char, byte, bit, none.  size: bytes; ``less`` is taken off it (a length that counts itself);
    size None is all that is left.  repeat: how often the field stands there; it is an array then."""

    name: str
    kind: str
    size: Size
    less: int = 0
    repeat: Size = None


@dataclass(frozen=True)
class Group:
    """A record within the record: a layout, or the name of one of the layouts given; with ``repeat`` an array of so many, one behind the other.

    The fold appends each record to those before, so its work grows with the square of a count; it is meant for counts of up to some thousands.
    """

    name: str
    layout: list | str
    repeat: Size = None


@dataclass(frozen=True)
class Choice:
    """One of several layouts (or their names), by an earlier field's value: a struct with a field ``b<value>`` for each, of which only the tag's
    isn't NULL.  A tag without a layout takes no bytes."""

    name: str
    tag: Size
    branches: dict[int, Any]


def decode(content: Column, layout: list, layouts: dict[str, list] | None = None) -> Column:
    """A struct of the layout's fields; ``none`` fields are skipped, ``uint_nz`` of size 0 is 0."""
    return _record(content, _resolved(layout, layouts or {}, ()), F.lit(1), {})["record"]


def _resolved(layout: Any, layouts: dict[str, list], within: tuple[str, ...]) -> list:
    """The layout with all names replaced by what they stand for."""
    if isinstance(layout, str):
        if layout in within:
            raise ValueError(f"the layout {layout} contains itself")
        return _resolved(layouts[layout], layouts, (*within, layout))
    out = []
    for f in layout:
        if isinstance(f, Group):
            f = Group(f.name, _resolved(f.layout, layouts, within), f.repeat)
        elif isinstance(f, Choice):
            f = Choice(f.name, f.tag, {k: _resolved(v, layouts, within) for k, v in f.branches.items()})
        out.append(f)
    return out


_KINDS = {"uint": "bigint", "uint_nz": "bigint", "uint_b": "bigint", "int_b": "bigint", "char": "string", "byte": "binary", "bit": "array<int>"}


def shape(layout: list) -> str:
    """The type of a layout's struct (names resolved)."""
    parts = []
    for f in layout:
        if isinstance(f, Field):
            kind = _KINDS.get(f.kind)
        elif isinstance(f, Group):
            kind = shape(f.layout)
        else:
            kind = f"struct<{','.join(f'`b{k}`:{shape(v)}' for k, v in f.branches.items())}>"
        if kind is not None:
            parts.append(f"`{f.name}`:{kind if getattr(f, 'repeat', None) is None else f'array<{kind}>'}")
    return f"struct<{','.join(parts)}>"


def _number(size: Size, seen: dict[str, Column]) -> Column:
    return (size(seen) if callable(size) else seen[size] if isinstance(size, str) else F.lit(size)).cast("int")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _record(content: Column, layout: list, at: Column, outer: dict[str, Column], own: dict[str, Column] | None = None) -> Column:
    """A struct of the record that begins at a byte (from 1), and ``next``, the byte behind it."""
    own = own or {}
    if not layout:
        return F.struct(F.struct(*[v.alias(n) for n, v in own.items()]).alias("record"), at.alias("next"))
    f, rest = layout[0], layout[1:]
    seen = {**outer, **own}

    def go_on(value: Column, after: Column) -> Column:
        kept = own if isinstance(f, Field) and f.kind == "none" else {**own, f.name: value}
        return _record(content, rest, after, outer, kept)

    if isinstance(f, Field) and f.repeat is None:
        n = F.octet_length(content) - at + 1 if f.size is None else _number(f.size, seen) - f.less
        if isinstance(f.size, int):
            return go_on(_value(f.kind, content, at, n), at + n)
        return _bound(F.struct(_value(f.kind, content, at, n).alias("v"), (at + n).alias("next")), lambda x: go_on(x["v"], x["next"]))
    if isinstance(f, Field):
        n = (F.octet_length(content) - at + 1 if f.size is None else _number(f.size, seen) - f.less).cast("int")
        count = _number(f.repeat, seen)
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        all_ = F.transform(places, lambda i: _value(f.kind, content, at + i * n, n))
        return _bound(F.struct(all_.alias("v"), (at + n * count).alias("next")), lambda x: go_on(x["v"], x["next"]))
    if isinstance(f, Choice):
        tag = _number(f.tag, seen)
        taken = {k: F.when(tag == k, _record(content, v, at, seen)) for k, v in f.branches.items()}
        parts = F.struct(*[v.alias(f"b{k}") for k, v in taken.items()])
        value = lambda x: F.struct(*[x[f"b{k}"]["record"].alias(f"b{k}") for k in f.branches])
        return _bound(parts, lambda x: go_on(value(x), F.coalesce(*[x[f"b{k}"]["next"] for k in f.branches], at)))
    if f.repeat is None:
        return _bound(_record(content, f.layout, at, seen), lambda x: go_on(x["record"], x["next"]))
    count = _number(f.repeat, seen)
    turns = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    kind = f"array<{shape(f.layout)}>"
    begin = F.struct(F.array().cast(kind).alias("all"), at.cast("int").alias("next"))

    def fold(done: Column, _: Column) -> Column:
        return _bound(_record(content, f.layout, done["next"], seen), lambda x: F.struct(F.concat(done["all"], F.array(x["record"]).cast(kind)).alias("all"), x["next"].cast("int").alias("next")))

    return _bound(F.aggregate(turns, begin, fold), lambda x: go_on(x["all"], x["next"]))


def _value(kind: str, content: Column, at: Column, n: Column) -> Column:
    raw = F.substr(content, at, n) if kind != "uint_nz" else F.when(n > 0, F.substr(content, at, n))
    return {"uint": uint_le, "uint_nz": lambda b: F.coalesce(uint_le(b), F.lit(0)), "uint_b": uint_be, "int_b": int_be, "char": lambda b: b.cast("string"), "byte": lambda b: b, "bit": bits, "none": lambda b: b}[kind](raw)


def union(tag: Column, branches: dict[int, Column]) -> Column:
    """A tagged union as a struct with one field for each branch; only the tag's one isn't NULL."""
    return F.struct(*[F.when(tag == k, v).alias(f"b{k}") for k, v in branches.items()])


# functions for sizes and counts


def nz(a: Column, b: Column) -> Column:
    """b, or 0 where a is 0."""
    return F.when(a != 0, b).otherwise(0)


def add_nz(a: Column, b: Column) -> Column:
    """a + b, or 0 where a is 0."""
    return F.when(a != 0, a + b).otherwise(0)


def sub_nz(a: Column, b: Column) -> Column:
    """a - b, or 0 where a is 0."""
    return F.when(a != 0, a - b).otherwise(0)


def first(values: Column) -> Column:
    """The first of an array; NULL if it is empty."""
    return F.get(values, F.lit(0))


def last(values: Column) -> Column:
    """The last of an array; NULL if it is empty."""
    return F.get(values, F.size(values) - 1)


def last_default(values: Column, default: Column) -> Column:
    """The last of an array, or the default if it is empty."""
    return F.when(F.size(values) > 0, last(values)).otherwise(default)
