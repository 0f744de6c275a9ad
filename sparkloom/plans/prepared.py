"""Prepared queries: SQL text with named parameters over tables, and templates whose defaults stand in the text."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SLOT = re.compile(r"/\*\s*%\((?P<name>\w+)\)s\s*\*/\s*(?P<value>'(?:[^']|'')*'|\"[^\"]*\"|-?\d+(?:\.\d+)?)")


class Prepared:
    """``Prepared(spark, 'select {columns} from {table} where x > :low', table, ['a', 'b'])(low=3)``.

    ``{table}`` and ``{columns}`` are names, not values; values go in by ``:name`` parameters and are never put into the text.
    """

    def __init__(self, spark: SparkSession, sql: str, table: DataFrame, columns: list[str] | None = None, defaults: dict[str, Any] | None = None):
        unknown = [c for c in columns or () if c not in table.columns]
        if unknown:
            raise KeyError(f"unknown columns: {', '.join(unknown)}")
        self.spark, self.defaults = spark, defaults or {}
        view = f"prepared_{uuid.uuid4().hex}"
        table.createOrReplaceTempView(view)
        names = ", ".join(f"`{c.replace('`', '``')}`" for c in columns or table.columns)
        self.sql = sql.replace("{table}", view).replace("{columns}", names)

    def __call__(self, **values: Any) -> DataFrame:
        return self.spark.sql(self.sql, args=self.defaults | values)


def template(text: str) -> tuple[str, dict[str, Any]]:
    """``/*%(city)s*/'Paris'`` becomes the parameter ``:city`` with the default ``'Paris'``."""
    defaults: dict[str, Any] = {}

    def slot(m: re.Match) -> str:
        v = m["value"]
        defaults[m["name"]] = v[1:-1].replace("''", "'") if v[0] in "'\"" else (float(v) if "." in v else int(v))
        return f":{m['name']}"

    return SLOT.sub(slot, text), defaults
