"""Token-ID output: Parquet files of token lists that can be read selectively.

Each row of the files is one document: ``doc_id``, ``n_tokens``, ``token_ids`` (array<int>) and the metadata columns asked
for.  Files are range-partitioned and sorted by doc_id, so row-group statistics and page indexes narrow a read to the pages
of the wanted documents, and a read of metadata never touches the token pages.  Token ids are dictionary coded (a
vocabulary is small); counts and ids of documents are delta coded (Parquet's version 2 encodings).

Defined results: null texts are empty and get the end id alone; null doc_ids come first; documents with one doc_id (repeated
rows) all stay, next to each other, in the order of their token ids; an empty table gives files without rows.  Metadata
columns that clash with the format's own names are kept under ``meta_<name>``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import textscan as S
from .shared import new_path
from .tokenize import encoder, vocabulary

OWN = ("doc_id", "n_tokens", "token_ids")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, token_ids and metadata of every document, in the order and partitions of ``docs``."""
    kept = [(c, f"meta_{c}" if c in OWN else c) for c in metadata]
    wide = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("__text"), *[F.col(c).alias(n) for c, n in kept])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), *[wide.schema[n] for _, n in kept]])

    def encode(batches):
        enc = encoder(tokenizer)
        for part in S.blocks(batches, "__text"):
            ids, starts = enc.column(part.column("__text"))
            if end_id is not None:
                ids = np.insert(ids, starts[1:], np.uint32(end_id))
                starts = starts + np.arange(len(starts))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            named = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(starts)), "token_ids": lists}
            yield pa.RecordBatch.from_pydict(named | {n: part.column(n) for _, n in kept})

    return wide.mapInArrow(encode, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, metadata: tuple[str, ...] = (), row_group_bytes: int = 16 << 20, page_rows: int = 1000, file_bytes: int = 32 << 20, partitions: int | None = None) -> None:
    """Write the files.  Texts are dealt out by ranges of doc_id before encoding, so nothing is encoded twice.

    A file holds the tokens of about ``file_bytes`` of text, so files and tasks stay alike while the input grows.
    ``row_group_bytes`` and ``page_rows`` bound what a selective read fetches at least.
    """
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0
        partitions = max(1, -(-size // file_bytes))
    ranged = docs.repartitionByRange(partitions, F.col("doc_id")).sortWithinPartitions("doc_id")
    out = encode_documents(ranged, tokenizer, end_id, metadata)
    (
        out.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = (), doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Selected columns of documents whose id is within ``doc_ids`` (both ends included); the filter reaches the scan."""
    df = spark.read.parquet(path)
    if doc_ids is not None:
        df = df.where(F.col("doc_id").between(*doc_ids))
    return df.select(*columns) if columns else df


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts come from counts alone: a running sum within each file, and the sum of all files before it.  Only one row for
    each file meets in one task.
    """
    rows = spark.read.parquet(path).select("doc_id", F.col("_metadata.file_path").alias("file"), "token_ids")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("file", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def sums(batches):
        for b in batches:
            ids = b.column("token_ids")
            flat, offs = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            base = offs[0]
            data = memoryview(flat[base : offs[-1]].tobytes())
            crc = [zlib.crc32(data[4 * (a - base) : 4 * (z - base)]) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "file": b.column("file"), "n_tokens": pa.array(np.diff(offs).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    each = rows.mapInArrow(sums, schema)
    files = spark.read.parquet(path).select("doc_id", F.col("_metadata.file_path").alias("file"), "n_tokens").groupBy("file").agg(F.min("doc_id").alias("low"), F.count("doc_id").alias("known"), F.sum("n_tokens").alias("total"))
    # a file that begins with null doc_ids is the first of all
    before = Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = each.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return out.join(files, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary(tokenizer), end_id, ("lang", "source"))
    return digest(spark, path)
