"""Named ranges of code points: ``start..end; name`` lines, gaps filled, characters looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.groups import range_lookup, with_gaps


def read_blocks(spark: SparkSession, path: str, gap: str = "No_Block") -> DataFrame:
    return parse_blocks(spark.read.text(path), gap)


def parse_blocks(lines: DataFrame, gap: str = "No_Block") -> DataFrame:
    pattern = r"^([0-9A-Fa-f]+)\.\.([0-9A-Fa-f]+);\s*(.*?)\s*$"
    num = lambda k: F.conv(F.regexp_extract("value", pattern, k), 16, 10).cast("int")
    rows = lines.where(F.col("value").rlike(pattern)).select(num(1).alias("start"), num(2).alias("end"), F.regexp_extract("value", pattern, 3).alias("name"))
    return with_gaps(rows, "start", "end", "name", gap)


def block_of(chars: DataFrame, column: str, blocks: DataFrame, gap: str = "No_Block") -> DataFrame:
    """chars with the block's name of the first character of ``column``."""
    points = chars.withColumn("__point", F.ascii(F.col(column)))
    return range_lookup(points, "__point", blocks, "start", "end", "name", gap).drop("__point")
