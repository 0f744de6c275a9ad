"""Nested data: column trees, grids, key/value rows, keyed subsets and merges, lookups by path."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..plans.cut import cut


def column_tree(schema: T.DataType, level: int = 2, prefix: str = "") -> list[str]:
    """Paths of a nested schema, ``level`` deep: struct fields by name, looking through arrays."""
    while isinstance(schema, T.ArrayType):
        schema = schema.elementType
    if not isinstance(schema, T.StructType) or level == 0:
        return [prefix] if prefix else []
    return [p for f in schema.fields for p in column_tree(f.dataType, level - 1, f"{prefix}.{f.name}" if prefix else f.name)]


#: Where a part of a name stands, the parts, their weight, and the length of a name without more than the part.
NAME_PARTS = (
    ("whole", ("!", "#"), 150, None),
    ("end", ("id",), 100, 2),
    ("end", ("type",), 81, 4),
    ("end", ("name",), 80, 4),
    ("start", ("last-",), -50, 5),
    ("in", ("data", "time"), -50, 5),
    ("in", ("url", "address"), -30, 5),
)
_STANDS = {"whole": str.__eq__, "end": str.endswith, "start": str.startswith, "in": str.__contains__}


def smart_order(names: list[str]) -> list[str]:
    """Columns in reading order: ids, types and names first, the shorter the earlier; times, data and urls last; ties by name."""

    def weight(name: str) -> int:
        low = name.lower()
        hits = [(w, base) for place, parts, w, base in NAME_PARTS if any(_STANDS[place](low, p) for p in parts)]
        return sum(w - (len(low) - base if base else 0) for w, base in hits)

    return sorted(names, key=lambda n: (-weight(n), n))


def grid(df: DataFrame, arrays: list[str], pad: str = "") -> DataFrame:
    """One row for each place of the sibling arrays, zipped to the longest; what a shorter one lacks is ``pad``.

    Columns that aren't arrays stand in the first row of each record only; ``row`` is the place.
    """
    keep = [c for c in df.columns if c not in arrays]
    rows = df.select(*keep, F.posexplode_outer(F.arrays_zip(*[F.coalesce(F.col(a), F.array()).alias(a) for a in arrays])).alias("row", "__z"))
    first = F.coalesce(F.col("row"), F.lit(0)) == 0
    return rows.select(F.coalesce("row", F.lit(0)).alias("row"), *[F.when(first, F.col(c).cast("string")).otherwise(pad).alias(c) for c in keep], *[F.coalesce(F.col(f"__z.{a}").cast("string"), F.lit(pad)).alias(a) for a in arrays])


def key_values(df: DataFrame, by: list[str]) -> DataFrame:
    """Columns as rows: key and value (as text)."""
    rest = [c for c in df.columns if c not in by]
    return df.select(*by, *[F.col(c).cast("string").alias(c) for c in rest]).unpivot(by, rest, "key", "value")


def _opened(df: DataFrame, by: list[str], column: str, depth: int | None, start: Column, step: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(by, v, at, n) of every leaf of JSON text: by is a struct of those columns, ``at`` is ``start`` taken a step further (by the name, NULL
    in arrays, and the place) at each of n levels.  Empty objects and arrays are rows like leaves.

    Each level is one lateral ``variant_explode`` that leaves pass unopened, so all levels are one pass over the rows.  Without a depth,
    three levels at a time are written, what is left to open apart from what is done, until nothing is.
    """
    keep = F.struct(*by) if by else F.struct(F.lit(0).alias("none"))
    rows = df.select(keep.alias("by"), F.try_parse_json(F.col(column)).alias("v"), start.alias("at"), F.lit(0).alias("n"))

    def level(rows: DataFrame) -> DataFrame:
        inner = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        opened = F.col("pos").isNotNull()
        return inner.select("by", F.when(opened, F.col("value")).otherwise(F.col("v")).alias("v"), F.when(opened, step(F.col("at"), F.col("key"), F.col("pos"))).otherwise(F.col("at")).alias("at"), F.when(opened, F.col("n") + 1).otherwise(F.col("n")).alias("n"))

    if depth is not None:  # text that isn't JSON goes last: asked before, it would be parsed twice
        return reduce(lambda r, _: level(r), range(depth), rows).where("v is not null")
    done, rows = None, rows.where("v is not null")
    while True:
        rows = cut(reduce(lambda r, _: level(r), range(3), rows))
        more = F.call_function("schema_of_variant", "v").rlike("^(OBJECT|ARRAY)") & ~F.to_json("v").isin("{}", "[]")
        done, rows = rows.where(~more) if done is None else done.unionByName(rows.where(~more)), rows.where(more)
        if rows.isEmpty():
            return done


def _valued(rows: DataFrame, depth: int | None) -> DataFrame:
    """Rows with their leaf as text, ``value`` (what wasn't opened as JSON); empty objects and arrays go, but those too deep to be opened."""
    gone = F.to_json("v").isin("{}", "[]")
    rows = rows.where(~gone if depth is None else ~((F.col("n") < depth) & gone))
    return rows.withColumn("value", F.try_variant_get("v", "$", "string"))


def _by(by: list[str]) -> list[Column]:
    return [F.col(f"by.`{b}`") for b in by]


def leaves(df: DataFrame, by: list[str], column: str, depth: int | None = None) -> DataFrame:
    """(path, value) of every leaf of JSON text: names and ``[place]`` of arrays, joined by dots; a dot in a name is written ``\\.``.

    An empty object or array has no leaves; text that isn't JSON gives no rows.  ``depth`` levels are opened if given (what lies below
    is one leaf, as JSON text), else all.  Columns of ``by`` that are called path or value move the result's to other names.
    """
    name = lambda key, pos: F.coalesce(F.replace(key, F.lit("."), F.lit("\\.")), F.concat(F.lit("["), pos.cast("string"), F.lit("]")))
    step = lambda at, key, pos: F.concat_ws(".", at, name(key, pos))
    rows = _valued(_opened(df, by, column, depth, F.lit(None).cast("string"), step), depth)
    path, value = _free(by, "path", "value")
    return rows.select(*_by(by), F.coalesce("at", F.lit("")).alias(path), F.col("value").alias(value))


_STEPS = "array<struct<name:string,pos:int>>"


def _stepped(df: DataFrame, by: list[str], column: str, depth: int | None) -> DataFrame:
    step = lambda at, key, pos: F.concat(at, F.array(F.struct(key.alias("name"), pos.alias("pos"))).cast(_STEPS))
    return _opened(df, by, column, depth, F.array().cast(_STEPS), step)


def cells(df: DataFrame, by: list[str], column: str, depth: int | None = None, by_path: dict[tuple[str, ...], Callable[[Column], Column]] | None = None, by_type: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(column_path, row_path, value) of every leaf of JSON text: the names on the way to it, and the places in arrays, apart.

    Values (as text) go through the converter of their column path, then through that of their type (``STRING``, ``BIGINT``,
    ``DECIMAL``, ``DOUBLE``, ``BOOLEAN``, ``VOID``; ``OBJECT`` and ``ARRAY`` below ``depth``).  Empty objects and arrays have no cells.
    """
    rows = _valued(_stepped(df, by, column, depth), depth)
    names = F.transform(F.filter("at", lambda x: x["name"].isNotNull()), lambda x: x["name"])
    places = F.transform(F.filter("at", lambda x: x["name"].isNull()), lambda x: x["pos"])
    value = F.col("value")
    for at, f in (by_path or {}).items():
        value = F.when(names == F.array(*map(F.lit, at)), f(value)).otherwise(value)
    kind = F.regexp_extract(F.call_function("schema_of_variant", "v"), "^[A-Z]+", 0)
    for name, f in (by_type or {}).items():
        value = F.when(kind == name, f(value)).otherwise(value)
    c, r, v = _free(by, "column_path", "row_path", "value")
    return rows.select(*_by(by), names.alias(c), places.alias(r), value.alias(v))


def column_tree_of(df: DataFrame, column: str, level: int = 2) -> DataFrame:
    """The column tree of JSON text from the rows themselves: path (names), level (0 for the outermost), n (how often it is there), kinds
    (names of the types seen there), for levels up to ``level``; arrays are looked through.

    One grouping by path that combines before the shuffle, so it merges like any sum.
    """
    rows = _stepped(df, [], column, None).withColumn("n", F.size("at"))
    # a node that isn't a leaf counts where the first leaf below it stands
    first = lambda i: F.forall(F.slice("at", i + 2, F.greatest(F.col("n") - i - 1, F.lit(0))), lambda x: x["pos"] == 0)
    kind = F.regexp_extract(F.call_function("schema_of_variant", "v"), "^[A-Z]+", 0)
    below = lambda i: F.when(i == F.col("n") - 1, kind).when(F.get("at", i + 1)["name"].isNull(), "ARRAY").otherwise("OBJECT")
    names = lambda i: F.transform(F.filter(F.slice("at", F.lit(1), i + 1), lambda x: x["name"].isNotNull()), lambda x: x["name"])
    nodes = F.transform("at", lambda x, i: F.when(x["name"].isNotNull() & first(i), F.struct(names(i).alias("path"), below(i).alias("kind"))))
    rows = rows.select(F.explode(F.filter(nodes, lambda x: x.isNotNull())).alias("x")).select("x.*").where(F.size("path") <= level + 1)
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds")).select("path", (F.size("path") - 1).alias("level"), "n", "kinds")


def _free(taken: list[str], *names: str) -> list[str]:
    """The names, with as many ``_`` behind them as make them differ from the taken ones."""
    low = {t.lower() for t in taken}
    return [next(f"{n}{'_' * k}" for k in range(len(low) + 1) if f"{n}{'_' * k}" not in low) for n in names]


def at_path(c: Column, path: list[str], default=None) -> Column:
    """A value of nested maps by its keys, or a default."""
    return F.coalesce(reduce(lambda x, k: F.try_element_at(x, F.lit(k)), path, c), F.lit(default))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The one row with a value; an empty or larger answer raises when it is read."""
    hit = df.where(F.col(column) == value)
    n = F.count("*").over(Window.partitionBy(column))
    return hit.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("not one row")).cast("boolean"))).where("__ok").drop("__n", "__ok")


def subset(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows all of whose key columns (one, or both ends of a pair) are in ``keys`` (its first column)."""
    name = keys.columns[0]
    for c in columns:
        df = df.join(keys.select(F.col(name).alias(c)).distinct(), c, "left_semi")
    return df


def missing_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Keys asked for that no row has."""
    return keys.select(F.col(keys.columns[0]).alias(column)).distinct().join(df, column, "left_anti")


def merge_keyed(mine: DataFrame, other: DataFrame, key: list[str], only: DataFrame | None = None, covered: bool = True) -> DataFrame:
    """The other table's rows by key, else mine; ``only`` restricts the keys taken from the other.

    With ``covered=False`` my rows whose keys the other lacks are left out, too (with ``only``, of those keys alone).
    """
    if only is not None:
        other = other.join(only, key, "left_semi")
    if not covered:
        mine = mine.join(other.select(*key), key, "left_semi") if only is None else mine.join(only.join(other.select(*key), key, "left_anti"), key, "left_anti")
    return mine.join(other.select(*key), key, "left_anti").select(*mine.columns).unionByName(other.select(*mine.columns))


def expand_ranges(df: DataFrame, start: str, end: str, delta: str | None = None, most: int = 65536) -> DataFrame:
    """Range-coded rows as one row for each key: key, and (key + delta) modulo ``most``.  A range that ends before it starts is empty."""
    rows = df.where(F.col(start) <= F.col(end)).withColumn("key", F.explode(F.sequence(F.col(start), F.col(end))))
    return rows if delta is None else rows.withColumn("value", F.pmod(F.col("key") + F.col(delta), F.lit(most)))


def preferred(df: DataFrame, by: list[str], ranks: Column, tie: list[str]) -> DataFrame:
    """The best row of each group: least rank, then least ``tie``; a grouped minimum, so no group is sorted."""
    rest = [c for c in df.columns if c not in by]
    one = df.groupBy(*by).agg(F.min(F.struct(ranks.alias("__rank"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)], *rest)).alias("__b"))
    return one.select(*[F.col(c) if c in by else F.col(f"__b.{c}").alias(c) for c in df.columns])
