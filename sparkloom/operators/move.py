"""Bulk copy from table to table: filtered, renamed, aligned to the destination, duplicates left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def align(source: DataFrame, target: DataFrame, convert: dict[str, str] | None = None, source_columns: tuple[str, ...] = (), target_columns: tuple[str, ...] = ()) -> DataFrame:
    """source in the target's columns, order and types; columns that it lacks are NULL.

    ``convert`` maps a target column to the source column that fills it, for target columns the source doesn't have itself.
    """
    have = [c for c in source.columns if not source_columns or c in source_columns]
    convert = convert or {}
    out = []
    for f in target.schema:
        if target_columns and f.name not in target_columns:
            continue
        name = f.name if f.name in have else convert.get(f.name)
        if name is not None and name not in have:
            raise KeyError(f"no such source column: {name}")
        out.append((F.col(name) if name else F.lit(None)).cast(f.dataType).alias(f.name))
    return source.select(*out)


def datamove(source: DataFrame, target: DataFrame, convert: dict[str, str] | None = None, cond: str | Column | None = None, key: tuple[str, ...] = (), **columns) -> DataFrame:
    """The rows to append: aligned rows of source that ``cond`` (SQL text or a Column over the source) holds for, without keys
    that the target has, one row for each key."""
    rows = source if cond is None else source.where(F.expr(cond) if isinstance(cond, str) else cond)
    rows = align(rows, target, convert, **columns)
    if not key:
        return rows
    rest = [c for c in rows.columns if c not in key]
    if rest:
        one = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r"))
        rows = one.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in rows.columns])
    else:
        rows = rows.distinct()
    return rows.join(target.select(*key), list(key), "left_anti").select(*rows.columns)


def append(rows: DataFrame, path: str, format: str = "parquet", **options) -> dict[str, int]:
    """Append to a dataset; the number of rows written, counted on the way."""
    seen = Observation("moved")
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(format).options(**options).mode("append").save(path)
    return seen.get


class Copy:
    """A copy into ``<path>/rows`` that can be stopped and taken up again, in ranges of a key column.

    The ranges' bounds are written first.  Each range is a folder of its own, written whole or again, and then a line of the progress table
    (range, rows), so a copy that is started anew does what is left, and :meth:`progress` can be read while one runs.  The source should stay
    the same between the runs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def progress(self) -> DataFrame:
        """range, rows of the ranges that are done."""
        if not self._there("progress"):
            return self.spark.createDataFrame([], "range int, rows bigint")
        return self.spark.read.schema("range int, rows bigint").parquet(f"{self.path}/progress").groupBy("range").agg(F.max("rows").alias("rows"))

    def rows(self) -> DataFrame:
        """The rows of the ranges that are done."""
        done = [r.range for r in self.progress().select("range").collect()]  # one for each range
        return self.spark.read.parquet(*[f"{self.path}/rows/{k:06d}" for k in sorted(done)]) if done else self.spark.createDataFrame([], "value string").limit(0)

    def run(self, source: DataFrame, key: str, ranges: int = 16, most: int | None = None) -> int:
        """Copy the ranges that are left, at most ``most`` of them now; how many ranges there are.  Rows with a NULL key are in the first range."""
        if not self._there("bounds/_SUCCESS"):
            cuts = source.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10_000).alias("c")).select(F.explode(F.array_distinct("c")).alias("cut"))
            cuts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bounds")
        cuts = sorted(r.cut for r in self.spark.read.parquet(f"{self.path}/bounds").collect())  # one for each range
        done = {r.range for r in self.progress().select("range").collect()}
        left = [k for k in range(len(cuts) + 1) if k not in done]
        for k in left[:most]:
            part = F.lit(True)
            if k > 0:
                part = part & (F.col(key) > F.lit(cuts[k - 1]))
            if k < len(cuts):
                part = part & (F.col(key) <= F.lit(cuts[k]))
            if k == 0:
                part = F.col(key).isNull() | part
            seen = Observation()
            source.where(part).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/rows/{k:06d}")
            self.spark.createDataFrame([(k, seen.get["rows"])], "range int, rows bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/progress")
        return len(cuts) + 1
