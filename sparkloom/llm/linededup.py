"""Line dedup by a deletion-neighbourhood join, in built-in functions only.

A line is its sequence of words ([^\\x20\\x09-\\x0D]+), and an edit puts in, leaves out or replaces one word.  Two lines may differ
by one edit for every ``words_an_edit`` words of the shorter one, ``edits`` at most (0 or 1: a line of n words has about n**edits
variants).  A line is a duplicate when an earlier line, in the order of doc_id and line number, is within that bound of it; so
lines that are too short for an edit must be equal.  The earliest stays.

1. Equal lines become one, at their earliest place, by a grouped minimum.
2. Two lines within one edit have a half in common, at the front or at the back.  Lines whose halves nobody else has are done.
3. The others emit their deletion neighbourhood as hashed keys: the line without its word i, for every i, and the line itself.
   Lines that agree without word i, at the same i, are a replacement apart: the earliest place of a key's lines is a grouped
   minimum, so no pairs arise however many lines share a key.  A line that equals another without one word is found by a join
   of whole lines with deletions.
4. The edit distance of each line and the earlier line found is verified on the words.

Defined results: null and empty texts have no lines with words; lines without words always stay; rows of one
doc_id are told apart, and ordered, by a hash of their texts, and rows alike in both are one; rows with a null doc_id keep all their lines and
count as no one's earlier line; extra columns pass through :func:`apply_line_dedup`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .quality import trimmed, words
from .shared import Scratch, free_names, written

POS = ("doc_id", "row_no", "line_no")
#: Lines to be read again are picked by a broadcast of their places up to so many, beyond by a shuffle of the lines.
BROADCAST_LINES = 200_000


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_no, a hash of the text: it tells rows of one doc_id apart."""
    return docs.withColumn("row_no", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, line_no, line of every line with a word."""
    each = numbered(docs.where("doc_id is not null and text is not null").select("doc_id", "text"))
    return each.select("doc_id", "row_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(trimmed(F.col("line")) != "")


def half_keys(ws: Column) -> Column:
    """Hashes of the halves by which a line and its neighbours of one edit can meet.

    Lines of n and n, or of n and n + 1, words within one edit have their first or their last n // 2 words in common.
    """
    n = F.size(ws)

    def two(label: Column) -> list[Column]:
        k = F.floor(label / 2).cast("int")
        return [F.xxhash64(F.lit("front"), label, F.slice(ws, 1, k)), F.xxhash64(F.lit("back"), label, F.slice(ws, n - k + 1, k))]

    return F.array(*two(n), *two(n - 1))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word sequences are at most one word's edit apart."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    gap = F.size(long) - F.size(short)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: ~x))
    # the first place where they differ; beyond it the longer one goes on a word later
    at = F.coalesce(F.array_position(F.zip_with(short, F.slice(long, 1, F.size(short)), lambda x, y: x.eqNullSafe(y)), F.lit(False)), F.lit(0))
    cut = F.when(at == 0, F.size(short)).otherwise((at - 1).cast("int"))
    inserted = F.concat(F.slice(long, 1, cut), F.slice(long, cut + 2, F.size(long))) == short
    return F.when(gap == 0, differ <= 1).when(gap == 1, inserted).otherwise(F.lit(False))


def duplicate_lines(docs: DataFrame, edits: int = 1, words_an_edit: int = 5) -> DataFrame:
    """Lines to drop: doc_id, row_no, line_no, and the earlier line (of_doc, of_row, of_line) found for each."""
    if edits not in (0, 1):
        raise ValueError(f"edits must be 0 or 1: {edits}")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    keep = scratch.written
    lines = lines_of(docs)
    at = F.struct(*POS)
    with_words = lines.withColumn("ws", words(F.col("line")))
    # every line once as two hashes of its words, its halves' keys and its length
    keyed = with_words.select(*POS, F.xxhash64("ws").alias("h1"), F.xxhash64(F.lit("second"), F.col("ws")).alias("h2"), F.size("ws").alias("n"), half_keys(F.col("ws")).alias("halves"))
    keyed = keep(keyed, "keyed-lines")
    # one row for each different line; its first place, and its halves, which equal lines have alike
    one = keyed.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.min("n").alias("n"), *[F.min(F.col("halves")[k]).alias(f"half{k}") for k in range(4)])
    one = keep(one, "different-lines")
    long = one.where(F.least(F.lit(edits), F.floor(F.col("n") / words_an_edit)) > 0)
    ends = F.array(*[F.struct(F.col(f"half{k}").alias("half"), F.lit(k % 2 == 0).alias("front")) for k in range(4)])
    halves = long.select("h1", "h2", F.explode(ends).alias("e")).select("h1", "h2", "e.half", "e.front")
    shared = halves.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half")
    near = halves.join(shared, "half").groupBy("h1", "h2").agg(F.max(F.col("front")).alias("front"), F.max(~F.col("front")).alias("back"))
    firsts = keep(long.join(near, ["h1", "h2"]).select("first.*", "n", "front", "back"), "near-firsts")
    # the words of those lines, from the texts; ids in the order of their places
    few = firsts.count() <= BROADCAST_LINES  # rows of six numbers
    texts = lines.join(F.broadcast(firsts) if few else firsts, list(POS)).dropDuplicates(list(POS)).select(at.alias("pos"), "line", "n", "front", "back")
    texts = texts.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("id", F.monotonically_increasing_id())
    texts = keep(texts, "near-lines")
    keys = keep(deletion_keys(texts), "deletions")
    gone, whole = keys.where("i > 0"), keys.where("i = 0").select("id", "h")
    # replaced: the earliest line with the same other words
    least = gone.groupBy("h", "i", "n").agg(F.min("id").alias("of"), F.count("*").alias("k")).where("k > 1").select("h", "i", "n", "of")
    replaced = gone.join(least, ["h", "i", "n"]).where("of < id").select("id", "of")
    # left out: this line is another one without a word; put in: this line without a word is another one
    known = gone.join(whole.select("h", F.col("id").alias("short")), "h")
    left_out = known.where("id < short").select(F.col("short").alias("id"), F.col("id").alias("of"))
    put_in = known.where("short < id").select("id", F.col("short").alias("of"))
    pairs = replaced.unionByName(left_out).unionByName(put_in).groupBy("id").agg(F.min("of").alias("of"))
    pairs = keep(pairs, "line-pairs")
    a, b = texts.select("id", F.col("pos").alias("at"), F.col("line").alias("a")), texts.select(F.col("id").alias("of"), F.col("pos").alias("of_at"), F.col("line").alias("b"))
    verified = pairs.join(a, "id").join(b, "of").where(within_one(words(F.col("a")), words(F.col("b")))).select(F.col("at").alias("pos"), F.col("of_at").alias("of"))
    verified = keep(verified, "near-pairs")
    # equal lines follow their first one
    firsts = one.select("h1", "h2", "first")
    earliest = firsts.join(verified.select(F.col("pos").alias("first"), "of"), "first", "left").select("h1", "h2", "first", F.coalesce(F.least("of", "first"), F.col("first")).alias("of"))
    places = keyed.select("h1", "h2", at.alias("pos"))
    out = places.join(earliest, ["h1", "h2"]).where("of < pos")
    out = written(out.select("pos.*", F.col("of.doc_id").alias("of_doc"), F.col("of.row_no").alias("of_row"), F.col("of.line_no").alias("of_line")), "duplicate-lines")
    scratch.drop()
    return out


def deletion_keys(lines: DataFrame) -> DataFrame:
    """id, n, i, h: for each line (id, line, n, front, back) the hash h of the line without its word i, for the places where an
    edit can be, and with i = 0 that of the whole line.

    A sequence's hash is made of the sums of its words' hashes, each taken with its place; without word i, the words behind i are
    one place further to the front.  So running sums over a line's words, one row for each word, give all its variants, and the
    work grows with the number of words.  Lines that share their front half differ at the back, and the other way round.
    """
    each = lines.repartition("id").select("id", "n", "front", "back", F.posexplode(words(F.col("line"))).alias("k", "w"))
    # hashes with the place (a) and with the place before (b), in two halves of 32 bits, so that sums don't overflow
    half = lambda x, p: (x if p else F.call_function("shiftrightunsigned", x, F.lit(32))).bitwiseAND(F.lit(0xFFFFFFFF))
    each = each.select("id", "n", "front", "back", "k", *[half(F.xxhash64("w", F.col("k") - d), p).alias(f"{name}{p}") for name, d in (("a", 0), ("b", 1)) for p in (0, 1)])
    line = Window.partitionBy("id").orderBy("k")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    total = lambda c: F.sum(c).over(line.rowsBetween(start, end))
    upto = lambda c: F.sum(c).over(line.rowsBetween(start, 0))  # noqa: E731  (frames to the end are recounted for each row)
    without = [upto(f"a{p}") - F.col(f"a{p}") + total(f"b{p}") - upto(f"b{p}") for p in (0, 1)]
    each = each.select("id", "n", "front", "back", (F.col("k") + 1).alias("i"), F.xxhash64(*without).alias("h"), F.xxhash64(total("a0"), total("a1")).alias("whole"))
    n, i = F.col("n"), F.col("i")
    first = F.when(F.col("back"), F.lit(1)).otherwise(F.floor((n - 1) / 2))
    last = F.when(F.col("front"), n).otherwise(F.ceil((n + 1) / 2) + 1)
    variants = F.array(F.when(i == 1, F.struct(F.lit(0).alias("i"), F.col("whole").alias("h"))), F.when(i.between(first, last), F.struct("i", "h")))
    return each.select("id", "n", F.explode(F.array_compact(variants)).alias("d")).select("id", "n", "d.i", "d.h")


def apply_line_dedup(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of ``text``, and n_dropped last (with ``_`` behind it where docs has the name); all
    columns of docs stay."""
    doc, row, lines, mine, count = free_names(docs.columns, "__doc", "__row", "__lines", "__mine", "n_dropped")
    gone = dropped.groupBy(F.col("doc_id").alias(doc), F.col("row_no").alias(row)).agg(F.collect_set("line_no").alias(lines))
    rows = docs.withColumn(mine, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(gone, (F.col("doc_id") == F.col(doc)) & (F.col(mine) == F.col(row)), "left")
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: ~F.array_contains(lines, e["i"])), lambda e: e["x"]), "\n")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept)
    return rows.withColumns({"text": text, count: F.coalesce(F.size(lines), F.lit(0)).cast("long")}).select(*docs.columns, count)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_line_dedup(docs, duplicate_lines(docs))
    return out.select("doc_id", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))
