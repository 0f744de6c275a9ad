"""Text documents of titled sections.

A title line ``##!# name .type(args) ends En as alias`` begins a section of type ``table``, ``object``, ``object_ex``, ``value`` or
``json``.  It may be indented, and as many characters are then taken off its section's lines; it follows ``sep`` blank lines or begins the document (else it is
a line like others).  The options come in any order.  A section ends at the next title or at the first run of one,
two or three blank lines (``ends E1``, the default, to ``E3``); blank lines at a section's end don't count.

Documents in rows are split by SQL functions within their row.  Files of any size are read in ranges (:func:`read_sections`).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.scan import BLOCK, KEY, carried, upto, within
from ..plans.cut import cut

MARK = "##!#"
OPTIONS = r"((?:\s+(?:ends|as)(?:\s+\S+)?)*)\s*$"
TITLE = r"^(.*)\.(\w+)\s*(?:\((.*)\))?" + OPTIONS
UNTYPED = r"^(.*?)" + OPTIONS


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def _marked(line: Column) -> Column:
    return line.contains(MARK) & line.rlike(rf"^\s*{MARK}")


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _parsed(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, name, type, args, alias, body of rows with a title line and ``lines``, an array of what follows it."""
    df = df.withColumn("__rest", F.trim(F.expr(f"substring(title, locate('{MARK}', title) + {len(MARK)})")))
    typed = F.col("__rest").rlike(TITLE)
    got = lambda k, other=None: F.nullif(F.trim(F.when(typed, F.regexp_extract("__rest", TITLE, k)).otherwise(other if other is not None else F.lit(""))), F.lit(""))
    options = F.when(typed, F.regexp_extract("__rest", TITLE, 4)).otherwise(F.regexp_extract("__rest", UNTYPED, 2))
    df = df.withColumns({"name": got(1, F.regexp_extract("__rest", UNTYPED, 1)), "type": F.coalesce(F.lower(got(2)), F.lit("value")), "args": got(3), "__options": options})
    df = df.withColumns({"alias": F.nullif(F.regexp_extract("__options", r"\sas\s+(?!ends\s)(\S+)", 1), F.lit("")), "__ends": F.coalesce(F.nullif(F.regexp_extract("__options", r"\sends\s+E([123])", 1), F.lit("")), F.lit("1"))})
    # up to the first run of so many blank lines, those behind the last line among them; found in a string of one letter for each line: were it looked
    # up in an array from within a lambda, a condition that Spark moves down here would work the array out again for each line
    marks = F.concat(F.array_join(F.transform("lines", lambda x: F.when(_blank(x), "b").otherwise("t")), ""), F.lit("bbb"))
    df = df.withColumn("__n", F.position(F.repeat(F.lit("b"), F.col("__ends").cast("int")), marks) - 1).withColumn("__indent", F.expr(f"locate('{MARK}', title)"))
    body = F.array_join(F.transform(F.slice("lines", F.lit(1), F.col("__n")), lambda x: F.substr(x, F.col("__indent"))), "\n")
    return df.select(*keep, "name", "type", "args", "alias", body.alias("body"))


def sections(docs: DataFrame, by: str, text: str = "text", sep: int = 1) -> DataFrame:
    """by, ordinal, name, type, args, alias, body of every section, in the document's order; nothing leaves the document's row before it is cut."""
    docs = docs.select(by, F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n").alias("__lines"))
    before = lambda i: _all([F.coalesce(_blank(F.get("__lines", i - k)), F.lit(True)) for k in range(1, sep + 1)])
    at = F.filter(F.transform("__lines", lambda x, i: F.when(_marked(x) & before(i), i)), lambda i: i.isNotNull())
    docs = docs.withColumn("__at", at)
    stage = lambda i, k: F.struct(F.get("__lines", i).alias("title"), F.slice("__lines", i + 2, F.coalesce(F.get("__at", k + 1), F.size("__lines")) - i - 1).alias("lines"))
    return _parsed(docs.select(by, F.posexplode(F.transform("__at", stage)).alias("ordinal", "__s")).select(by, "ordinal", "__s.*"), [by, "ordinal"])


def read_sections(spark: SparkSession, path: str, sep: int = 1) -> DataFrame:
    """path, ordinal, name, type, args, alias, body of every section of text files, each of which is read by many tasks.

    Spark's text source cuts files into ranges at line ends.  Whether a line is a title depends on the ``sep`` lines before it, and
    which section it belongs to on the titles before it; both are carried from range to range, so sections come out as from one range.
    """
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("path")).alias(KEY), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    lines = lines.repartition(KEY, BLOCK).withColumn("nth", F.row_number().over(within("n"))).withColumn("full", F.when(~_blank(F.col("line")), F.col("nth")))
    # of each range: how many lines are before it in the file, and the last of these that isn't blank
    before = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy(KEY, BLOCK).agg(F.count("*").alias("many"), F.max("full").alias("last_full"))
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("many").over(before), F.lit(0))).withColumn("far", F.max(F.col("offset") + F.col("last_full")).over(before))
    lines = lines.join(ranges.select(KEY, BLOCK, "offset", "far"), [KEY, BLOCK])
    near = F.max(F.col("offset") + F.col("full")).over(within("n").rowsBetween(Window.unboundedPreceding, -1))
    since = F.col("offset") + F.col("nth") - 1 - F.coalesce(near, F.col("far"))  # blank lines just before
    lines = cut(lines.select(KEY, BLOCK, "n", "line", (_marked(F.col("line")) & F.coalesce(since >= sep, F.lit(True))).alias("is_title")))
    lines = carried(lines.repartition(KEY, BLOCK), __n=("sum", F.sum(F.col("is_title").cast("int"))))
    lines = lines.withColumn("ordinal", F.coalesce("__n", F.lit(0)) + F.sum(F.col("is_title").cast("int")).over(upto("n")) - 1).where("ordinal >= 0")
    # a section is one row from here on
    whole = lines.groupBy(KEY, "ordinal").agg(F.max(F.when(F.col("is_title"), F.col("line"))).alias("title"), F.array_sort(F.collect_list(F.when(~F.col("is_title"), F.struct(BLOCK, "n", "line")))).alias("at"))
    whole = whole.select(F.col(f"{KEY}.path").alias("path"), F.col("ordinal").cast("int").alias("ordinal"), "title", F.transform("at", lambda x: x["line"]).alias("lines"))
    return _parsed(whole, ["path", "ordinal"])


def object_pairs(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with ``pairs``: a map of ``key: value`` lines; lines that begin with # are comments; the last of equal keys counts."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    entry = F.transform(lines, lambda x, i: F.struct(F.trim(F.split(x, ":", 2)[0]).alias("k"), (-i).alias("i"), F.trim(F.split(x, ":", 2)[1]).alias("v")))
    # sorted by key, the last line of a key first, so each looks at its neighbour only
    ordered = F.array_sort(entry)
    last = F.filter(F.zip_with(ordered, F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda e: e["k"])), lambda e, k: F.when(e["k"].isNotNull() & ~e["k"].eqNullSafe(k), F.struct(e["k"], e["v"]))), lambda e: e.isNotNull())
    # from a generator, else exploding the pairs has Spark ask for their size before any other condition on the rows, thus for those of all sections
    return rows.withColumn("pairs", F.explode(F.array(F.map_from_entries(last))))


def parse_nested(text: str) -> str:
    """Indented ``key: value`` lines as JSON text; a key with children keeps its own value under ''."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        node: dict = {"": value.strip()}
        stack[-1][1][key.strip()] = node
        stack.append((indent, node))

    def plain(node: dict):
        if set(node) == {""}:
            return node[""]
        return {k: v if isinstance(v, str) else plain(v) for k, v in node.items() if k or v}

    return json.dumps({k: plain(v) for k, v in root.items()}, ensure_ascii=False)


def nested_json(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with ``json``: the body's nested object."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else parse_nested(x))

    return rows.withColumn("json", run(body))


def column_starts(lines: list[str]) -> list[tuple[int, str | None]]:
    """Where each column of a fixed-width table begins, and its name: at every ``!`` of a line that begins with one, else from
    columns that are blank in every line."""
    if lines and lines[0].startswith("!"):
        return [(m.start(), m[1].strip()) for m in re.finditer("!([^!]*)", lines[0])]
    width = max((len(x) for x in lines), default=0)
    full = [any(x[i : i + 1].strip() for x in lines) for i in range(width)]
    return [(i, None) for i in range(width) if full[i] and (i == 0 or not full[i - 1])]


def parse_table(text: str, joiner: str = "\r\n") -> list[dict]:
    """Cells of a fixed-width table: row, col, name, value.  A line that begins with ``!`` (not the header) goes on with the row
    before it, cell by cell."""
    lines = [x for x in text.split("\n") if x.strip()]
    starts = column_starts(lines)
    if lines and lines[0].startswith("!"):
        lines = lines[1:]
    rows: list[list[list[str]]] = []
    for line in lines:
        more = line.startswith("!")
        line = (" " + line[1:]) if more else line
        cells = [line[a : starts[i + 1][0] if i + 1 < len(starts) else None].strip() for i, (a, _) in enumerate(starts)]
        if more and rows:
            for cell, x in zip(rows[-1], cells, strict=True):
                cell.append(x)
        else:
            rows.append([[c] for c in cells])
    return [{"row": r, "col": c, "name": starts[c][1], "value": joiner.join(parts)} for r, row in enumerate(rows) for c, parts in enumerate(row)]


def table_cells(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with one row for each cell of the body's table: row, col, column, value."""

    @F.pandas_udf("array<struct<row:int,col:int,name:string,value:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else parse_table(x))

    return rows.withColumn("__c", F.explode(run(body))).select(*rows.columns, F.col("__c.row").alias("row"), F.col("__c.col").alias("col"), F.col("__c.name").alias("column"), F.col("__c.value").alias("value"))
