"""Validation expressions compiled to boolean columns.

    object(.name: string(+3), #.age: number(>0), string: any)    array(2, string(2))    set(.a | .b)    number(-200)

A type is ``any null bool number string hex ascii alnum object array set``; bounds are ``>n <n +n (at least) -n (at most) n
(exactly)`` on a number or else on a length; ``.word`` or ``"text"`` is that very string; ``a | b`` either; ``#`` marks a part
that must occur.  An array's items must each match one of the checks; an object's pairs are decided by the first check whose
key matches, and a key that none matches is an error.

Values are compiled against a column's Spark type where that is known (structs, arrays, maps, strings, numbers), and against
JSON text by :func:`json_checker`, which reads it as VARIANT.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class Check:
    kind: str
    args: tuple = ()
    required: bool = False
    key: Check | None = None
    bound: tuple = field(default=())


TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|\.\w+)|(?P<num>[<>+\-]?\d+(?:\.\d+)?)|(?P<name>\w+)|(?P<sign>[(),:#|]))""")


class CheckError(ValueError):
    pass


def parse(code: str) -> Check:
    tokens, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = TOKEN.match(code, at)
        if not m:
            raise CheckError(f"not understood at {at}: {code[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    found, rest = _either(tokens, 0)
    if tokens[rest][0] != "end":
        raise CheckError(f"too much at {tokens[rest][1]!r}")
    return found


def _either(tokens, at):
    one, at = _one(tokens, at)
    some = [one]
    while tokens[at] == ("sign", "|"):
        more, at = _one(tokens, at + 1)
        some.append(more)
    return (one if len(some) == 1 else Check("either", tuple(some))), at


def _one(tokens, at):
    kind, text = tokens[at]
    if kind == "str":
        return Check("text", (text[1:] if text[0] == "." else re.sub(r"\\(.)", r"\1", text[1:-1]),)), at + 1
    if kind == "num":
        sign, n = (text[0], text[1:]) if text[0] in "<>+-" else ("=", text)
        return Check("bound", bound=(sign, float(n) if "." in n else int(n))), at + 1
    if kind != "name":
        raise CheckError(f"a check is missing before {text!r}")
    at += 1
    args = []
    if tokens[at] == ("sign", "("):
        at += 1
        while tokens[at] != ("sign", ")"):
            required = tokens[at] == ("sign", "#")
            part, at = _either(tokens, at + required)
            if tokens[at] == ("sign", ":"):
                value, at = _either(tokens, at + 1)
                part = Check(value.kind, value.args, required, part, value.bound)
            elif required:
                part = Check(part.kind, part.args, True, None, part.bound)
            args.append(part)
            if tokens[at] == ("sign", ","):
                at += 1
            elif tokens[at] != ("sign", ")"):
                raise CheckError(f"',' or ')' is missing before {tokens[at][1]!r}")
        at += 1
    return Check(text, tuple(args)), at


def _bound(x: Column, b: tuple) -> Column:
    sign, n = b
    n = F.lit(n)
    return {">": x > n, "<": x < n, "+": x >= n, "-": x <= n, "=": x == n}[sign]


class Json:
    """How a JSON (VARIANT) value is looked at."""

    def __init__(self, v: Column):
        self.v = v
        self.type = F.lower(F.call_function("schema_of_variant", v))

    def is_(self, kind: str) -> Column:
        t = self.type
        if kind == "null":
            return t == "void"
        if kind == "bool":
            return t == "boolean"
        if kind == "number":
            return t.isin("bigint") | (t.startswith("decimal") & t.endswith(",0)"))
        if kind == "string":
            return t == "string"
        if kind == "object":
            return t.startswith("object")
        return t.startswith("array")

    def text(self) -> Column:
        return F.when(self.type == "string", F.try_variant_get(self.v, "$", "string"))

    def number(self) -> Column:
        return F.try_variant_get(self.v, "$", "double")

    def items(self) -> Column:
        return F.try_variant_get(self.v, "$", "array<variant>")

    def pairs(self) -> Column:
        return F.map_entries(F.try_variant_get(self.v, "$", "map<string,variant>"))

    def sub(self, c: Column) -> Json:
        return Json(c)

    def pair(self, e: Column) -> tuple[Column, Json]:
        return e["key"], Json(e["value"])


class Typed:
    """How a value of a known Spark type is looked at."""

    def __init__(self, c: Column, kind: T.DataType):
        self.v, self.kind = c, kind

    def is_(self, kind: str) -> Column:
        k = self.kind
        fits = {"bool": isinstance(k, T.BooleanType), "number": isinstance(k, T.IntegralType) or (isinstance(k, T.DecimalType) and k.scale == 0), "string": isinstance(k, T.StringType), "object": isinstance(k, (T.StructType, T.MapType)), "array": isinstance(k, T.ArrayType)}
        return self.v.isNull() if kind == "null" else F.lit(fits[kind]) & self.v.isNotNull()

    def text(self) -> Column:
        return self.v if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")

    def number(self) -> Column:
        return self.v.cast("double") if isinstance(self.kind, T.NumericType) else F.lit(None).cast("double")

    def items(self) -> Column:
        return self.v if isinstance(self.kind, T.ArrayType) else F.lit(None).cast("array<string>")

    def sub(self, c: Column) -> Typed:
        return Typed(c, self.kind.elementType if isinstance(self.kind, T.ArrayType) else T.StringType())


class _Key:
    """An object's key: a string."""

    def __init__(self, c: Column):
        self.v = c

    def is_(self, kind: str) -> Column:
        return F.lit(kind == "string")

    def text(self) -> Column:
        return self.v

    def number(self) -> Column:
        return F.lit(None).cast("double")


def _matches(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of exactly one argument, as higher-order functions take it."""
    return lambda e: test(e)


def compiled(check: Check, x, own: dict[str, Callable]) -> Column:
    """A condition that is true or false, never NULL."""
    return F.coalesce(_compiled(check, x, own), F.lit(False))


def _compiled(c: Check, x, own) -> Column:
    if c.kind == "either":
        out = F.lit(False)
        for a in c.args:
            out = out | compiled(a, x, own)
        return out
    if c.kind == "text":
        return x.text() == c.args[0]
    if c.kind == "bound":
        return _bound(x.number(), c.bound)
    bounds = [a for a in c.args if a.kind == "bound" and a.key is None]
    rest = [a for a in c.args if a not in bounds]
    if c.kind in own:
        return own[c.kind](x.v, *[a.args[0] if a.kind == "text" else a.bound[1] for a in c.args])
    if c.kind == "any":
        return F.lit(True)
    if c.kind == "null":
        return x.is_("null")
    if c.kind == "number":
        out = x.is_("number")
        for b in bounds:
            out = out & _bound(x.number(), b.bound)
        return out
    if c.kind == "bool":
        return x.is_("bool")
    if c.kind in ("string", "hex", "ascii", "alnum"):
        out = x.is_("string")
        text = x.text()
        pattern = {"hex": "^[0-9A-Fa-f]*$", "ascii": r"^[\x00-\x7f]*$", "alnum": "^[0-9A-Za-z]+$"}.get(c.kind)
        if pattern:
            out = out & text.rlike(pattern)
        for b in bounds:
            out = out & _bound(F.length(text), b.bound)
        return out
    if c.kind in ("array", "set"):
        items = x.items()
        out = x.is_("array")
        for b in bounds:
            out = out & _bound(F.size(items), b.bound)
        if rest:
            out = out & F.forall(items, lambda e: compiled(Check("either", tuple(rest)), x.sub(e), own))
            for r in (r for r in rest if r.required):
                out = out & F.exists(items, _matches(lambda e, r=r: compiled(r, x.sub(e), own)))
        if c.kind == "set":
            texts = F.transform(items, lambda e: F.to_json(e) if isinstance(x, Json) else e)
            out = out & (F.size(F.array_distinct(texts)) == F.size(texts))
        return out
    if c.kind == "object":
        if isinstance(x, Typed):
            return _typed_object(rest, bounds, x, own)
        pairs = x.pairs()
        out = x.is_("object")
        for b in bounds:
            out = out & _bound(F.size(pairs), b.bound)

        def each(e: Column) -> Column:
            key, value = x.pair(e)
            decided = None
            for r in rest:
                hit, good = compiled(r.key or Check("any"), _Key(key), own), compiled(Check(r.kind, r.args, False, None, r.bound), value, own)
                decided = F.when(hit, good) if decided is None else decided.when(hit, good)
            return F.lit(False) if decided is None else decided.otherwise(False)

        if rest:
            out = out & F.forall(pairs, each)
        for r in (r for r in rest if r.required):
            out = out & F.exists(pairs, _matches(lambda e, r=r: compiled(r.key or Check("any"), _Key(x.pair(e)[0]), own) & compiled(Check(r.kind, r.args, False, None, r.bound), x.pair(e)[1], own)))
        return out
    raise CheckError(f"no such type: {c.kind}")


def _typed_object(rest, bounds, x: Typed, own) -> Column:
    """Struct fields are an object's pairs; a NULL field isn't there."""
    out = x.is_("object")
    if not isinstance(x.kind, T.StructType):
        pairs = F.map_entries(x.v)
        kind = x.kind.valueType if isinstance(x.kind, T.MapType) else T.StringType()

        def each(e):
            decided = None
            for r in rest:
                hit, good = compiled(r.key or Check("any"), _Key(e["key"]), own), compiled(Check(r.kind, r.args, False, None, r.bound), Typed(e["value"], kind), own)
                decided = F.when(hit, good) if decided is None else decided.when(hit, good)
            return F.lit(False) if decided is None else decided.otherwise(False)

        for b in bounds:
            out = out & _bound(F.size(pairs), b.bound)
        if rest:
            out = out & F.forall(pairs, each)
        for r in (r for r in rest if r.required):
            out = out & F.exists(pairs, _matches(lambda e, r=r: compiled(r.key or Check("any"), _Key(e["key"]), own)))
        return out
    for f in x.kind.fields:
        value = x.v[f.name]
        decided = None
        for r in rest:
            hit, good = compiled(r.key or Check("any"), _Key(F.lit(f.name)), own), compiled(Check(r.kind, r.args, False, None, r.bound), Typed(value, f.dataType), own)
            decided = F.when(hit, good) if decided is None else decided.when(hit, good)
        if rest:
            out = out & (value.isNull() | decided.otherwise(False))
    for r in (r for r in rest if r.required):
        there = F.lit(False)
        for f in x.kind.fields:
            there = there | (x.v[f.name].isNotNull() & compiled(r.key or Check("any"), _Key(F.lit(f.name)), own))
        out = out & there
    return out


class Checker:
    """``Checker('number(>200)')(F.col('x'), 'int')`` is a boolean column; ``own`` adds types by name (column builders)."""

    def __init__(self, code: str, own: dict[str, Callable[..., Column]] | None = None):
        self.code, self.check, self.own = code, parse(code), own or {}

    def __call__(self, c: Column, kind: str | T.DataType) -> Column:
        return compiled(self.check, Typed(c, T._parse_datatype_string(kind) if isinstance(kind, str) else kind), self.own)

    def json(self, text: Column) -> Column:
        """Of JSON text; NULL and text that isn't JSON are not valid."""
        v = F.try_parse_json(text)
        return F.transform(F.array(v), lambda x: F.when(x.isNotNull(), compiled(self.check, Json(x), self.own)).otherwise(False))[0]


    def failures(self, text: Column) -> Column:
        """Why JSON text isn't valid, as an array of ``path: message``; empty where it is.  NULL and text that isn't JSON fail at $."""
        v = F.try_parse_json(text)
        bad = F.array(F.concat(F.lit("$: "), F.coalesce(_shown(text), F.lit("NULL")), F.lit(" is not JSON")))
        return F.transform(F.array(v), lambda x: F.when(x.isNull(), bad).otherwise(_failures(self.check, Json(x), F.lit("$"), self.own)))[0]


def _shown(text: Column) -> Column:
    """A value within a message, cut to ten characters."""
    return F.when(F.length(text) > 10, F.concat(F.left(text, F.lit(7)), F.lit("..."))).otherwise(text)


def described(c: Check) -> str:
    """A check in words, for messages."""
    if c.kind == "either":
        return " or ".join(map(described, c.args))
    if c.kind == "text":
        return f"'{c.args[0]}'"
    if c.kind == "bound":
        return f"{c.bound[0]}{c.bound[1]}"
    inner = [described(a) for a in c.args if a.kind == "bound" and a.key is None]
    return f"{c.kind}({', '.join(inner)})" if inner else c.kind


def _failures(c: Check, x: Json, path: Column, own) -> Column:
    """Messages for all parts of a value that fail: the innermost ones, where an object or an array has a part to blame."""
    none = F.array().cast("array<string>")
    itself = F.array(F.concat(path, F.lit(": "), F.coalesce(_shown(F.to_json(x.v)), F.lit("NULL")), F.lit(f" is not {described(c)}")))
    rest = [a for a in c.args if a.kind != "bound" or a.key is not None] if c.kind in ("array", "set", "object") else []
    parts = none
    if c.kind in ("array", "set") and rest:
        one = rest[0] if len(rest) == 1 else Check("either", tuple(rest))
        items = F.transform(x.items(), lambda e, i: _failures(Check(one.kind, one.args, False, None, one.bound), Json(e), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), own))
        parts = F.coalesce(F.flatten(items), none)
    if c.kind == "object" and rest:

        def each(e: Column) -> Column:
            key, at = e["key"], F.concat(path, F.lit("."), e["key"])
            out = F.array(F.concat(at, F.lit(": no such key")))
            for r in reversed(rest):
                out = F.when(compiled(r.key or Check("any"), _Key(key), own), _failures(Check(r.kind, r.args, False, None, r.bound), Json(e["value"]), at, own)).otherwise(out)
            return out

        parts = F.coalesce(F.flatten(F.transform(x.pairs(), each)), none)
        for r in (r for r in rest if r.required):
            there = F.exists(x.pairs(), _matches(lambda e, r=r: compiled(r.key or Check("any"), _Key(e["key"]), own)))
            gone = F.array(F.concat(path, F.lit(f": {described(r.key or Check('any'))} is missing")))
            parts = F.concat(parts, F.when(F.coalesce(there, F.lit(True)), none).otherwise(gone))
    return F.when(compiled(c, x, own), none).when(F.size(parts) > 0, parts).otherwise(itself)


def json_checker(code: str, text: Column, own=None) -> Column:
    return Checker(code, own).json(text)


def errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def replacer(ok: Column, value: Column, fallback) -> Column:
    """The value where it is valid, a fallback elsewhere."""
    return F.when(ok, value).otherwise(F.lit(fallback))
