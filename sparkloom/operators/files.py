"""Tables of Parquet files that change file by file: copy-on-write, versions, and writers that don't lose each other's changes.

A version is a manifest, a table with one row for each data file (its name, its rows, the least and greatest value of each key column), and a
version file that names it.  A change reads which files hold rows it concerns (bounds first, then the rows' ``_metadata.file_path``), writes
these anew, and carries all others over in the next manifest.  Nothing is changed in place: until the version file is there, readers have
the version before, and what an interrupted change has written is never referred to.

Commits are optimistic: the next number's version file is created only if no other writer has.  A writer that comes late starts again from the
version it lost to, so both changes are in the result.  The driver holds names and bounds of files, as Spark's own file index does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.expr import Expr, Marker
from ..plans.spec import condition
from . import dml


class ConflictError(RuntimeError):
    """Other writers were faster in every try."""


class FileTable:
    """key: the columns that tell rows apart; files keep their bounds, so those that can't have a key aren't read."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], defaults: dict[str, Any] | None = None, tries: int = 10):
        self.spark, self.path, self.key, self.defaults, self.tries = spark, path.rstrip("/"), list(key), defaults or {}, tries

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: list[str], **how) -> FileTable:
        """A new table with the rows, ranges of the key in files of their own; raises if there is one."""
        table = cls(spark, path, key, **how)
        files, _ = table._written(rows.repartitionByRange(*key))
        if not table._publish(0, files, rows.schema):
            raise ConflictError(f"{path} has a version")
        return table

    # versions

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._hadoop("versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []

    def _version(self, n: int | None) -> tuple[int, dict]:
        n = (self.versions() or [None])[-1] if n is None else n
        if n is None:
            raise dml.NotFoundError(f"no version in {self.path}")
        return n, json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{n:020d}").collect()))

    def files(self, version: int | None = None) -> DataFrame:
        """file, rows, low and high (structs of the key columns) of every data file."""
        n, told = self._version(version)
        return self.spark.read.parquet(f"{self.path}/manifests/{told['manifest']}")

    def read(self, version: int | None = None) -> DataFrame:
        n, told = self._version(version)
        return self._of_files([r.file for r in self.files(n).select("file").collect()], told)

    def _of_files(self, names: list[str], told: dict) -> DataFrame:
        schema = T.StructType.fromJson(told["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{x}" for x in names]) if names else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """New data files of the rows, as manifest rows; and how many rows these are, counted while they are written."""
        folder, seen = uuid.uuid4().hex, Observation()
        if _known_empty(rows):  # such a plan observes nothing
            return self.spark.createDataFrame([], self._manifest(rows.schema)), 0
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/data/{folder}")
        keys = lambda f: F.struct(*[f(k).alias(k) for k in self.key])
        name = F.concat(F.lit(f"{folder}/"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
        files = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{folder}").groupBy(name.alias("file")).agg(F.count("*").alias("rows"), keys(F.min).alias("low"), keys(F.max).alias("high"))
        return files, seen.get["rows"]

    def _manifest(self, schema: T.StructType) -> T.StructType:
        keys = T.StructType([schema[k] for k in self.key])
        return T.StructType().add("file", T.StringType()).add("rows", T.LongType()).add("low", keys).add("high", keys)

    def _publish(self, n: int, files: DataFrame, schema: T.StructType) -> bool:
        """Make version n of these files, unless another writer has: its file appears whole and once."""
        told = json.dumps({"manifest": uuid.uuid4().hex, "schema": schema.jsonValue()})
        files.coalesce(1).write.parquet(f"{self.path}/manifests/{json.loads(told)['manifest']}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, fs = self._hadoop(f"versions/.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(told.encode())
        out.close()
        target, _ = self._hadoop(f"versions/{n:020d}")
        try:
            if new.toUri().getScheme() in (None, "file"):  # a hard link is made whole or not at all, and not over a file
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(new))
            else:  # such a rename doesn't replace a file
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(new, False)
        return True

    # changes

    def _change(self, make: Callable[[int, dict], tuple[list[str], DataFrame, Callable[[int], dict]]]) -> dict[str, int]:
        """make gives, for a version, the files that go, the rows that come, and the counts (of the number of rows written)."""
        for _ in range(self.tries):
            n, told = self._version(None)
            gone, rows, counts = make(n, told)
            if not gone and _known_empty(rows):
                return counts(0)
            new, written = self._written(rows)
            stay = self.files(n).where(~F.col("file").isin(gone)) if gone else self.files(n)
            if self._publish(n + 1, stay.unionByName(new), T.StructType.fromJson(told["schema"])):
                return counts(written)
        raise ConflictError(f"{self.tries} times another writer of {self.path} was faster")

    def _with_rows(self, told: dict, candidates: list[str], pick: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Of these files, those with a row that ``pick`` leaves."""
        if not candidates:
            return []
        rows = self._of_files(candidates, told)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)
        return [r.f for r in pick(rows.withColumn("__file", name)).select(F.col("__file").alias("f")).distinct().collect()]  # names of files

    def _may_have(self, n: int, low: dict[str, Any], high: dict[str, Any]) -> list[str]:
        """Files whose bounds don't rule out keys between low and high, of each column for itself."""
        hold = [F.coalesce((F.col(f"high.{k}") >= F.lit(low[k])) & (F.col(f"low.{k}") <= F.lit(high[k])), F.lit(False)) for k in self.key if low.get(k) is not None and high.get(k) is not None]
        files = self.files(n)
        return [r.file for r in (files.where(reduce(lambda a, b: a & b, hold)) if hold else files).select("file").collect()]

    def _plain(self, equals: dict) -> dict:
        """Equalities of key columns with single values, which bounds can be asked for."""
        return {k: v for k, v in equals.items() if k in self.key and not isinstance(v, (list, tuple, Expr, Marker))}

    def _where(self, where: tuple) -> tuple[dict, list]:
        equals: dict = {}
        for w in where:
            if isinstance(w, dict):
                equals |= w
        return equals, [w for w in where if not isinstance(w, dict)]

    def update(self, values: dict[str, Any], *where: Any) -> dict[str, int]:
        """Rows that the conditions hold for get new values; only files with such rows are written.  Gives matched and changed."""
        equals, others = self._where(where)

        def make(n, told):
            known = self._plain(equals)
            hold = lambda df: F.coalesce(condition(df, equals, others), F.lit(False))
            hit = self._with_rows(told, self._may_have(n, known, known), lambda df: df.where(hold(df)))
            base = self._of_files(hit, told)
            if not hit:
                return [], base, lambda _: {"matched": 0, "changed": 0}
            base = base.withColumn("__hit", hold(base))
            differs = reduce(lambda a, b: a | b, [~F.col(f"__old.{c}").eqNullSafe(F.col(c)) for c in values], F.lit(False))
            out = dml.update(base.withColumn("__old", F.struct(*values)), values, F.col("__hit")).table.withColumn("__differs", differs)
            seen = Observation()
            measured = out.observe(seen, F.count(F.when(F.col("__hit"), 1)).alias("matched"), F.count(F.when(F.col("__hit") & F.col("__differs"), 1)).alias("changed"))
            return hit, measured.drop("__hit", "__old", "__differs"), lambda _: seen.get

        return self._change(make)

    def delete(self, *where: Any) -> dict[str, int]:
        """Rows that the conditions hold for go; only files with such rows are written."""
        equals, others = self._where(where)

        def make(n, told):
            if not where:
                gone = self.files(n).select("file", "rows").collect()  # names of files
                return [r.file for r in gone], self._of_files([], told).limit(0), lambda _: dict.fromkeys(("matched", "changed"), sum(r.rows for r in gone))
            known = self._plain(equals)
            hold = lambda df: F.coalesce(condition(df, equals, others), F.lit(False))
            hit = self._with_rows(told, self._may_have(n, known, known), lambda df: df.where(hold(df)))
            base, seen = self._of_files(hit, told), Observation()
            if not hit:
                return [], base, lambda _: {"matched": 0, "changed": 0}
            measured = base.observe(seen, F.count(F.when(hold(base), 1)).alias("matched"))
            return hit, measured.where(~hold(base)), lambda _: {**seen.get, "changed": seen.get["matched"]}

        return self._change(make)

    def _by_keys(self, rows: DataFrame, n: int, told: dict) -> tuple[list[str], list[str]]:
        """Files that may have, and that have, keys of the rows."""
        ends = rows.agg(*[f(k).alias(f"{name}_{i}") for i, k in enumerate(self.key) for name, f in (("low", F.min), ("high", F.max))]).first()
        near = self._may_have(n, {k: ends[f"low_{i}"] for i, k in enumerate(self.key)}, {k: ends[f"high_{i}"] for i, k in enumerate(self.key)})
        return near, self._with_rows(told, near, lambda df: df.join(rows.select(*self.key).distinct(), self.key, "left_semi"))

    def extend(self, rows: DataFrame) -> dict[str, int]:
        """Rows of new keys are added in files of their own; gives how many, counted as they are written."""

        def make(n, told):
            near, _ = self._by_keys(rows, n, told)
            return [], dml.new_rows(self._of_files(near, told), rows, self.key, self.defaults), lambda n: {"inserted": n}

        return self._change(make)

    def upsert(self, rows: DataFrame, on_match: dict[str, Any]) -> dict[str, int]:
        """Rows of new keys are added, rows of keys there are get the values of ``on_match``; gives how many rows were written."""

        def make(n, told):
            _, hit = self._by_keys(rows, n, told)
            return hit, dml.upsert(self._of_files(hit, told), rows, self.key, on_match, self.defaults), lambda n: {"written": n}

        return self._change(make)

    def replace(self, rows: DataFrame) -> dict[str, int]:
        def make(n, told):
            _, hit = self._by_keys(rows, n, told)
            return hit, dml.replace(self._of_files(hit, told), rows, self.key, self.defaults), lambda n: {"written": n}

        return self._change(make)


def _known_empty(df: DataFrame) -> bool:
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0
