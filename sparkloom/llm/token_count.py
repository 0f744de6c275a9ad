"""Token counts, with overlap resynchronisation for huge documents.

Documents up to ``chunk`` characters are counted whole.  A longer one is cut into chunks of ``chunk`` characters that
overlap by ``overlap``, dealt out over the cluster and encoded with offsets, each by itself.  Two neighbours are spliced at
a common boundary in their overlap.  Where none exists, the document is cut again with chunks and overlap twice as wide, until
one chunk holds it all, which needs no splice.

A boundary is a single space between two ASCII letters or digits at which both encodings end a token, with ``agree`` tokens on
either side alike.  It is stable, that is, the whole text's encoding has it, too, and is the left chunk's up to it and the right
chunk's from it:

* A tokenizer that drops white space and matches pieces without any (``word_bpe_49k``): no match spans a space, the matcher
  begins anew behind it whatever came before, and no normalisation (NFC, lower case) reaches over it.
* The byte-level matcher (``byte_bpe_50k``): a space before a letter or digit begins the piece `` ?letters`` or `` ?digits``; no
  piece has a space inside but runs of white space, which a single space between others isn't; a match depends on nothing before it.
* sentencepiece without a piece that has a space inside (``piece_bpe_32k``): the space's mark begins a piece, and merges on its
  two sides don't meet.

BPE merges stay within a piece, and special strings hold no space and take none with them.  :class:`~.tokenize.Encoder` checks
a file for these properties; with any other file every document is counted whole.

Defined results: null texts and empty texts have 0 bytes and 0 tokens; every row is counted, repeated rows too; rows with a
null doc_id are counted; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import textscan as S
from .shared import Scratch, partitions_for, written
from .tokenize import encoder, vocabulary

EDGE = "array<struct<at:int,before:int,print:bigint>>"


ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


def boundaries(text: np.ndarray, ids: np.ndarray, begins: np.ndarray, low: int, high: int, agree: int) -> list[dict]:
    """Boundaries from byte ``low`` of the text on and before byte ``high``: place from ``low`` on, tokens before it, and a
    print of the ``agree`` tokens on either side.  ids, begins: as :meth:`~.tokenize.Encoder.marked` gives them."""
    k = np.flatnonzero((begins > low) & (begins < high))
    k = k[(k >= agree) & (k <= len(ids) - agree)]
    at = np.where(text[begins[k]] == 0x20, begins[k], begins[k] - 1)  # the space is the token's own or the last byte before
    ok = (text[at] == 0x20) & (at > 0) & (at + 1 < len(text))
    k, at = k[ok], at[ok]
    ok = ALNUM[text[at - 1]] & ALNUM[text[at + 1]]
    rows = zip(k[ok].tolist(), at[ok].tolist(), strict=True)
    return [{"at": p - low, "before": j, "print": hash(tuple(ids[j - agree : j + agree].tolist()))} for j, p in rows]  # alike in every process


def splice(left: list[dict], right: list[dict]) -> tuple[int, int] | None:
    """Tokens of the left chunk before a common boundary and tokens of the right chunk before it; the middle one wins."""
    there = {(x["at"], x["print"]): x["before"] for x in right}
    both = [(x["before"], there[x["at"], x["print"]]) for x in left if (x["at"], x["print"]) in there]
    return both[len(both) // 2] if both else None


def count_huge(rows: DataFrame, tokenizer: str, chunk: int, overlap: int, agree: int = 4) -> DataFrame:
    """row_id, n_tokens for texts longer than one chunk; rows: row_id, text, n_chars.  n_tokens is null if a splice fails."""
    chunks = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.col("n_chars") - 1, F.lit(chunk).cast("bigint"))).alias("begin"), "text", "n_chars")
    # a chunk that would lie within its predecessor's overlap is left out
    chunks = chunks.where((F.col("begin") == 0) | (F.col("begin") + overlap < F.col("n_chars")))
    piece = lambda n: F.expr(f"substring(text, cast(begin as int) + 1, {n})")
    chunks = chunks.select("row_id", "begin", piece(chunk + overlap).alias("text"), F.octet_length(piece(chunk)).cast("bigint").alias("own"), F.octet_length(piece(overlap)).cast("bigint").alias("lap"))

    def encode(batches):
        enc = encoder(tokenizer)
        for b in S.blocks(batches, "text"):
            cols = {k: [] for k in ("n_tokens", "head", "tail")}
            texts = b.column("text")
            buf, offs = S.raw(texts)
            rows = zip(*[b.column(c).to_pylist() for c in ("begin", "own", "lap")], enc.marked(texts), strict=True)
            for k, (begin, own, lap, (ids, begins)) in enumerate(rows):
                text = buf[offs[k] : offs[k + 1]]
                cols["n_tokens"].append(len(ids))
                cols["head"].append(boundaries(text, ids, begins, 0, lap, agree) if begin else [])
                cols["tail"].append(boundaries(text, ids, begins, own, len(text), agree))
            edge = pa.list_(pa.struct([("at", pa.int32()), ("before", pa.int32()), ("print", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("begin"), pa.array(cols["n_tokens"], pa.int64()), pa.array(cols["head"], edge), pa.array(cols["tail"], edge)], ["row_id", "begin", "n_tokens", "head", "tail"])

    size = rows.agg(F.sum("n_chars")).first()[0] or 0
    spread = chunks.repartition(partitions_for(rows.sparkSession, size, 8 * chunk), F.col("row_id"), F.col("begin"))
    each = spread.mapInArrow(encode, f"row_id string, begin bigint, n_tokens bigint, head {EDGE}, tail {EDGE}")
    by = Window.partitionBy("row_id").orderBy("begin")
    pairs = each.withColumns({"next_head": F.lead("head").over(by)})

    def join(batches):
        for b in batches:
            got, lost = [], []
            for n, tail, head in zip(b.column("n_tokens").to_pylist(), b.column("tail").to_pylist(), b.column("next_head").to_pylist(), strict=True):
                if head is None:
                    got.append(n)
                    lost.append(0)
                    continue
                at = splice(tail, head)
                got.append(at[0] - at[1] if at else None)
                lost.append(int(at is None))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(got, pa.int64()), pa.array(lost, pa.int64())], ["row_id", "part", "lost"])

    parts = pairs.select("row_id", "n_tokens", "tail", "next_head").mapInArrow(join, "row_id string, part bigint, lost bigint")
    return parts.groupBy("row_id").agg(F.when(F.sum("lost") == 0, F.sum("part")).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))

    def whole(batches):
        enc = encoder(tokenizer)
        for part in S.blocks(batches, "text"):
            _, starts = enc.column(part.column("text"))
            offs = S.text_offsets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs)), pa.array(np.diff(starts))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = F.col("n_chars") > (chunk if encoder(tokenizer).cuttable else 2**31)
    short = texts.where(~cut).select("doc_id", "text").mapInArrow(whole, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    # copies of one huge text are encoded once
    huge = texts.where(cut).withColumn("row_id", F.sha2("text", 256))
    owners = written(huge.select("doc_id", "row_id", "n_chars", F.octet_length("text").cast("bigint").alias("n_bytes")), "huge-owners")
    scratch = Scratch(spark, "huge")
    left = scratch.written(huge.groupBy("row_id").agg(F.first("text").alias("text"), F.first("n_chars").alias("n_chars")), "huge-texts")
    done = None
    while not left.isEmpty():
        found = written(count_huge(left, tokenizer, chunk, overlap), "huge-counts")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        left = left.join(found.where("n_tokens is null").select("row_id"), "row_id", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap
    scratch.drop()
    out = short
    if done is not None:
        out = out.unionByName(owners.join(done, "row_id").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_count(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(tokenizer), limit)
