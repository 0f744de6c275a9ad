"""XML from tables: children grouped under their parents, attributes, optional parts, escaping."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import xml_escape


def element(name: str, content: Column | None = None, attributes: dict[str, Column] | None = None, optional: bool = False) -> Column:
    """``<name a="..">content</name>``; content is XML already (see :func:`text`).  An optional element without content is ''."""
    head = F.lit(f"<{name}")
    for k, v in (attributes or {}).items():
        head = F.concat(head, F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), xml_escape(v.cast("string")), F.lit('"'))).otherwise(""))
    body = F.coalesce(content, F.lit("")) if content is not None else F.lit("")
    whole = F.when(body == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), body, F.lit(f"</{name}>")))
    return F.when(body == "", F.lit("")).otherwise(whole) if optional else whole


def text(c: Column) -> Column:
    return xml_escape(F.coalesce(c.cast("string"), F.lit("")))


def children(df: DataFrame, by: list[str], xml: Column, order: list[str], name: str = "xml") -> DataFrame:
    """The elements of each parent, in order, end to end."""
    one = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, xml.alias("__x")))).alias("__l"))
    return one.select(*by, F.array_join(F.transform("__l", lambda x: x["__x"]), "").alias(name))


@dataclass(frozen=True)
class Part:
    """A line of a template: an element or (``attribute``) an attribute, what it takes from which input, and what is within it."""

    name: str
    attribute: bool = False
    optional: bool = False
    source: str | None = None
    key: str = ""
    many: bool = False
    change: str = ""
    within: tuple[Part, ...] = ()

    @property
    def elements(self) -> tuple[Part, ...]:
        return tuple(p for p in self.within if not p.attribute)


def read_template(lines: str) -> Part:
    """A template table.  Its first line names its columns, each behind a ``!``: the target, then the inputs.

    The target column holds names, indented under the element they belong to: ``(a)`` is an attribute, ``[x]`` is left out where its
    value is missing.  One of the input columns may say what the line takes: ``key`` of the input (``$0`` by place, ``@`` all of
    it), ``%`` an element for each of an array's items, ``%key`` of those under a key; ``|f`` is a change of the value by name.
    """
    rows = [x for x in lines.split("\n") if x.strip()]
    shift = len(rows[0]) - len(rows[0].lstrip())
    rows = [x[shift:] for x in rows]
    starts = [m.start() for m in re.finditer("!", rows[0])]
    names = [x.strip() for x in rows[0].split("!")[1:]]
    stack: list[tuple[int, dict]] = []
    root: dict | None = None
    for line in rows[1:]:
        cells = [line[a:z] for a, z in zip(starts, [*starts[1:], None], strict=True)]
        taken = [(n, c.strip()) for n, c in zip(names[1:], cells[1:], strict=True) if c.strip()]
        if len(taken) > 1:
            raise ValueError(f"more than one input: {line!r}")
        depth, label = len(cells[0]) - len(cells[0].lstrip()), cells[0].strip()
        source, what = taken[0] if taken else (None, "")
        key, _, change = (x.strip() for x in what.partition("|"))
        bare = label.strip("[]()")
        node = {"name": bare, "attribute": "(" in label, "optional": label.startswith("["), "source": source, "key": key.lstrip("%"), "many": key.startswith("%"), "change": change, "within": []}
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            stack[-1][1]["within"].append(node)
        elif root is None:
            root = node
        else:
            raise ValueError("a template has one outermost element")
        stack.append((depth, node))
    if root is None:
        raise ValueError("a template without elements")

    def frozen(n: dict) -> Part:
        return Part(**{**n, "within": tuple(map(frozen, n["within"]))})

    return frozen(root)


def rendered(part: Part, inputs: dict[str, Column], changes: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The XML of a template as one expression over input columns (structs, maps, arrays of these); values are escaped."""
    changes = changes or {}

    def value(p: Part) -> Column:
        c = inputs_of[-1][p.source]
        if p.key and p.key != "@":
            c = F.get(c, F.lit(int(p.key[1:]))) if p.key.startswith("$") else c[p.key]
        return changes[p.change](c) if p.change else c

    def bare(p: Part) -> bool:
        """Whether an item is shown itself: nothing stands for parts of it."""
        return not p.within

    inputs_of = [inputs]

    def whole(p: Part) -> Column:
        if p.many:
            items = value(p)

            def each(x: Column) -> Column:
                inputs_of.append(inputs_of[-1] | {p.source: x})
                out = one(p, x if bare(p) else None)
                inputs_of.pop()
                return out

            return F.coalesce(F.array_join(F.transform(items, each), ""), F.lit(""))
        if p.source is None:
            return one(p, None)
        v = value(p)
        if p.elements:
            inputs_of.append(inputs_of[-1] | {p.source: v})
            out = one(p, None)
            inputs_of.pop()
            return out
        out = one(p, v)
        return F.when(v.isNull(), F.lit("")).otherwise(out) if p.optional else out

    def one(p: Part, content: Column | None) -> Column:
        head = [F.lit(f"<{p.name}")]
        for a in p.within:
            if a.attribute:
                v = value(a)
                shown = F.concat(F.lit(f' {a.name}="'), text(v), F.lit('"'))
                head.append(F.when(v.isNull(), F.lit("")).otherwise(shown) if a.optional else shown)
        body = [text(content)] if content is not None else [whole(x) for x in p.elements]
        return F.concat(*head, F.lit(">"), *body, F.lit(f"</{p.name}>"))

    return whole(part)
