"""Filter interaction audit: what each filter removes, for every order of the filters, from one histogram.

Which filters a document fails is a mask of five bits, so whatever the order, all that matters of a table is how many documents
(and how many labelled good or toxic) of each part have each of the 32 masks.  Spark makes that histogram in one pass over the texts; a
part is a row of 32 numbers, and its outcomes in all 120 orders of 5 steps are the row times integer 32-by-600
matrices (:func:`outcomes`), one for each kind of outcome.

Filter E (a copy of an earlier document) is found without meeting all copies in one task: the least id of each text's digest by
a grouping that combines before the shuffle, joined back by digest *and* id.

Defined results: a null text is empty, a null part or lang the part ``''``; a row without doc_id is nobody's earlier copy and isn't
taken for one; rows repeated with one id aren't copies of each other; of several labels of an id any that says 1 counts; texts are
the same if their SHA-256 is; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import WORD, Scratch, written

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def outcomes(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """0/1 matrices (mask by order and step): whether a document of a mask is kept after the step, removed by it, fails its filter
    but was removed before, or fails its filter only; and ``shapley``, the step's filter's removals summed over all orders."""
    n, names = len(filters), orders(filters)
    mask = np.arange(1 << n)[:, None]
    bit = np.array([[1 << filters.index(f) for f in name] for name in names])  # order, step
    upto = np.bitwise_or.accumulate(bit, axis=1)
    before = (upto ^ bit).reshape(1, -1)
    fails, gone = (mask & bit.reshape(1, -1)) != 0, (mask & before) != 0
    removed = (fails & ~gone).astype(np.int64)
    letter = bit.reshape(-1)
    summed = {b: removed[:, letter == b].sum(1) for b in np.unique(letter)}
    return {
        "kept": ((mask & upto.reshape(1, -1)) == 0).astype(np.int64),
        "removed": removed,
        "redundant": (fails & gone).astype(np.int64),
        "unique_fails": (mask == letter[None, :]).astype(np.int64),
        "shapley": np.stack([summed[b] for b in letter], 1),
    }


def mask_of(failures: Sequence[Column]) -> Column:
    """The bits of the failure conditions that hold; NULL doesn't."""
    total = F.lit(0)
    for i, c in enumerate(failures):
        total = total + F.when(c, 1 << i).otherwise(0)
    return total


def text_failures(text: Column) -> list[Column]:
    """Filters A to D: few words, few different words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, good, toxic of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), mask_of(text_failures(text)).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = scratch.written(rows, "measures")  # texts are read once
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("earliest", F.lit(True))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("earliest").isNull()
    marked = rows.join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    return marked.select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def histograms(rows: DataFrame, filters: int = 5) -> DataFrame:
    """One row for each part: arrays of documents, good and toxic ones by mask."""
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("g"), F.sum("toxic").alias("t"))
    at = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << filters)])
    return cells.groupBy("part").agg(at("n").alias("n"), at("g").alias("g"), at("t").alias("t"))


def audit(parts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of :func:`histograms` times the matrices: one row for each part, order and step."""
    names, steps, many = orders(filters), len(filters), 1 << len(filters)

    def multiply(batches):
        by = outcomes(filters)
        order, step = np.repeat(names, steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                n, g, t = (part.column(c).flatten().to_numpy().reshape(-1, many) for c in ("n", "g", "t"))
                found = [n @ by[k] for k in COUNTS[:4]] + [g @ by["removed"], t @ by["removed"], n @ by["shapley"]]
                k = part.num_rows
                which = pa.array(np.repeat(np.arange(k), len(order)))
                yield pa.RecordBatch.from_arrays([part.column("part").take(which), pa.array(np.tile(order, k)), pa.array(np.tile(step, k)), *[pa.array(x.reshape(-1)) for x in found]], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(multiply, f"part string, filter_order string, step int, {', '.join(f'{c} bigint' for c in COUNTS)}")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "filter-audit")
    parts = written(histograms(masks(docs, labels, scratch)), "filter-histograms")  # one row for each part
    scratch.drop()
    return audit(parts)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
