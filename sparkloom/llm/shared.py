"""Where intermediate tables live, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of an Arrow batch: Spark's own bound (64 MB, 10,000 rows) is held by each task at once in the JVM and in its Python worker.
BATCH_BYTES = "4m"

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one of our own for local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends ``BATCH_BYTES`` to a Python worker at a time, or one row if it is longer.

    The setting holds for what runs later too, as a returned DataFrame is run by the caller.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    A lost executor then costs one re-read, never the work before.  The files stay until the folder is cleared.
    """
    return _written(df, new_path(df.sparkSession, name), options)


def _written(df: DataFrame, path: str, options: dict) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """One folder in the shared folder for the intermediate tables of one job; :meth:`drop` deletes it.

    What the job returns is written outside of it before (:func:`written`), so nothing that is still read goes away.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, new_path(spark, name), 0

    def written(self, df: DataFrame, name: str, **options) -> DataFrame:
        """As :func:`written`, within the folder."""
        self.made += 1
        return _written(df, f"{self.path}/{self.made:03d}-{name}", options)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Each wanted name, with as many ``_`` behind it as make it differ from all columns (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text):
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions_for(spark: SparkSession, items: int, per_partition: int, least: int = 1) -> int:
    """Partitions so that each holds about per_partition items; grows with the input without a bound."""
    return max(least, -(-items // per_partition))
