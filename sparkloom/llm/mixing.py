"""Mixing sources to target weights with a time-varying curriculum, in built-in functions only.

*Targets.*  Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...  and share the words of all documents.  No
target exceeds ``most_repeats`` times its source's size; what is cut off is shared again by weight until none is above.
That ends in min(level * weight, cap) with one level for all, found in one pass over the sources in the order of cap/weight.

*Documents.*  Within a source, documents are in the order of a hash of their id.  A source is gone through whole as often
as its target allows; the rest is filled with whole documents from the front of the order up to the first that is too large, then
``ROUNDS`` times from those of the others that are no larger than what is missing, in the same way, so a large document is stepped over;
and last with the one document whose size comes closest to what is still missing.

*Curriculum.*  A source's weight at time t (0 to 1) is its target times ``1 + slope * (2t - 1)``, so its integral over the
run is the target.  The words that the source has given by time t are the integral up to t; a document whose words begin
``c`` words into the source's stream gets the time at which that integral reaches c, in closed form.  Rows come out
range-sorted by that position.

A running sum within a source is taken over hash buckets first (one row for each source and bucket), then within a bucket, so
a source with a third of all rows is spread over as many tasks as any other rows; the number of buckets grows with the rows.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source; rows with one doc_id are taken
each by itself, in the order of size and text; rows with a null doc_id are in the order of a hash of their text; extra columns pass
through, whatever their names (the operator's own columns take a free name); an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import Scratch, free_names, word_count, written

#: Slopes of the schedules by weight class: the first source's weight falls over the run, the third's rises.
SLOPES = (-0.8, 0.0, 0.8)
#: How often documents that don't fit are stepped over.
ROUNDS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """source, source_size, weight, slope, target of each source.  sizes: source, source_size (one row for each source)."""
    # one row for each source meets here
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.select("source", "source_size", rank.alias("k")).withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1).cast("long"), "slope": F.element_at(F.array(*map(F.lit, slopes)), F.col("k") % len(slopes) + 1), "cap": F.col("source_size") * most_repeats})
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy(F.lit(1))
    w = w.withColumns({"before_cap": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "from_weight": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(all_)})
    # the level if the sources before this one are at their caps; it holds at the first source whose cap it doesn't pass
    w = w.withColumn("level", (F.col("total") - F.col("before_cap")) / F.col("from_weight"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))
    w = w.withColumn("level", F.coalesce(F.min(fits).over(all_)["level"], F.lit(0.0)))
    return w.select("source", "source_size", "weight", "slope", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def keyed(docs: DataFrame, digits: int) -> DataFrame:
    """docs with __size, __key (order within a source), __tie (order of rows with one key) and __bucket."""
    tie = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), tie)
    return docs.withColumns({"__size": word_count(F.col("text")), "__key": key, "__tie": tie}).withColumn("__bucket", F.substring("__key", 1, digits))


def with_starts(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with __before: the sizes before each row in its source's order.  sums: source, __bucket, __sum."""
    over = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("source", "__bucket").orderBy("__key", F.col("doc_id").asc_nulls_first(), "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(bases, rows["source"].eqNullSafe(bases["__s"]) & (rows["__bucket"] == bases["__b"])).drop("__s", "__b")
    return rows.withColumn("__before", F.col("__base") + F.coalesce(F.sum("__size").over(inner), F.lit(0))).drop("__base")


def position(c, target, slope):
    """Time at which a source's schedule has given c of its target words."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / target))
    # (1 - s) t + s t**2 = u
    curved = (-(1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, u).otherwise(curved + F.lit(0.0))  # no minus zero


def _missing(r: int) -> str:
    return "rest" if r == 0 else f"missing{r}"


def _with_source(rows: DataFrame, t: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their source's row in t."""
    t = t.withColumnRenamed("source", "__s")
    return rows.join(t, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def taken_in(r: int, mark: str = ""):
    """Whether a row is one of round r: no larger than what is missing, and no further in the order than the round goes.  Of documents with words, the words before
    them tell the order."""
    return F.coalesce((F.col("__size") > 0) & (F.col("__size") <= F.col(f"{mark}{_missing(r)}")) & (F.col("__before") <= F.col(f"{mark}last{r}")), F.lit(False))


def _may_go_on(r: int):
    """Whether a row wasn't taken in the rounds before r."""
    return reduce(lambda a, b: a & b, [~taken_in(k) for k in range(r)], F.col("__size") > 0)


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, slopes: tuple[float, ...] = SLOPES, per_bucket: int = 50_000) -> tuple[DataFrame, DataFrame, int]:
    """Per source: targets, whole passes and the rest to fill, with the filling document; bucket sums; digits of a bucket."""
    narrow = docs.select("doc_id", "source", "text")
    rows = narrow.count()
    digits = 2
    while rows > per_bucket * 16**digits:
        digits += 1
    scratch = Scratch(docs.sparkSession, "mixing-plan")
    narrow = scratch.written(keyed(narrow, digits).drop("text"), "sized")
    sums = narrow.groupBy("source", "__bucket").agg(F.sum("__size").alias("__sum"))
    sums = written(sums, "bucket-sums")
    sizes = sums.groupBy("source").agg(F.sum("__sum").alias("source_size"))
    targets = source_targets(sizes, weights, most_repeats, slopes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = scratch.written(targets.withColumn("passes", whole).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")), "targets")
    placed = scratch.written(with_starts(narrow, sums), "placed")
    t = targets.select("source", "rest")
    for r in range(ROUNDS + 1):
        # what is missing, and how far in the order this round's documents go
        left = _with_source(placed, t).where(_may_go_on(r)).where(F.col("__size") <= F.col(_missing(r)))
        over = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        bases = left.groupBy("source", "__bucket").agg(F.sum("__size").alias("__sum")).select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__base"))
        left = left.join(bases, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
        upto = F.col("__base") + F.sum("__size").over(Window.partitionBy("source", "__bucket").orderBy("__before"))
        fits = left.where("__size > 0").withColumn("__upto", upto).where(F.col("__upto") <= F.col(_missing(r)))
        got = fits.groupBy("source").agg(F.sum("__size").alias("__got"), F.max("__before").alias(f"last{r}"))
        t = _with_source(t, got, "left").withColumn(_missing(r + 1), F.col(_missing(r)) - F.coalesce("__got", F.lit(0))).drop("__got")
        t = scratch.written(t, "round")
    # the document that fills best what is left
    last = _missing(ROUNDS + 1)
    better = _with_source(placed, t).where(_may_go_on(ROUNDS + 1) & (F.abs(F.col(last) - F.col("__size")) < F.col(last)))
    fill = better.groupBy("source").agg(F.min(F.struct(F.abs(F.col(last) - F.col("__size")).alias("gap"), "__key", F.col("doc_id"), "__size", "__tie", "__before")).alias("fill"))
    fill = fill.select(F.col("source").alias("__s"), F.col("fill.__before").alias("fill_before"), F.col("fill.__key").alias("fill_key"), F.col("fill.__tie").alias("fill_tie"), F.col("fill.__size").alias("fill_size"))
    targets = _with_source(targets.drop("rest"), t)
    out = targets.join(fill, targets["source"].eqNullSafe(fill["__s"]), "left").drop("__s")
    out = written(out, "plan")
    scratch.drop()
    return out, sums, digits


#: Columns that :func:`mixed` adds.
OWN = ("__size", "__source_size", "__target", "__copies", "__position", "__before", "__slope")
NEEDED = ("doc_id", "source", "text")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, slopes: tuple[float, ...] = SLOPES, per_bucket: int = 50_000) -> DataFrame:
    """All rows and columns of docs, and of each: __size, __source_size, __target, __copies, __position (of the first copy),
    __before (words of its source before it) and __slope (each with ``_`` behind it where docs has the name)."""
    sources, sums, digits = plan(docs, weights, most_repeats, slopes, per_bucket)
    kept = {c: c if c in NEEDED else f"x{k}" for k, c in enumerate(docs.columns)}  # so that no name is like ours
    rows = with_starts(keyed(docs.toDF(*kept.values()), digits), sums)
    s = sources.select(F.col("source").alias("__s"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "slope", "target", "passes", *map(_missing, range(ROUNDS + 1)), *[f"last{r}" for r in range(ROUNDS + 1)], "fill_before", "fill_key", "fill_tie", "fill_size")])
    rows = rows.join(s, rows["source"].eqNullSafe(s["__s"])).drop("__s")
    front = reduce(lambda a, b: a | b, [taken_in(r, "__") for r in range(ROUNDS + 1)])
    fills = F.coalesce((F.col("__before") == F.col("__fill_before")) & (F.col("__key") == F.col("__fill_key")) & (F.col("__size") == F.col("__fill_size")) & (F.col("__tie") == F.col("__fill_tie")), F.lit(False))
    copies = F.when(F.col("__size") > 0, F.col("__passes") + (front | fills).cast("long")).otherwise(F.lit(0))
    rows = rows.withColumn("__copies", copies.cast("long")).withColumn("__position", F.when(F.col("__copies") > 0, position(F.col("__before"), F.col("__target"), F.col("__slope"))))
    return rows.select(*[F.col(k).alias(c) for c, k in kept.items()], *[F.col(c).alias(n) for c, n in zip(OWN, free_names(docs.columns, *OWN), strict=True)])


def by_position(rows: DataFrame, at: str, partitions: int | None = None) -> DataFrame:
    """rows range-sorted by the column ``at``, nulls last; rows of one position are dealt out by their id."""
    n = [] if partitions is None else [partitions]
    order = (F.col(at).asc_nulls_last(), F.col("doc_id").asc_nulls_last())
    return rows.repartitionByRange(*n, *order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, partitions: int | None = None, **how) -> DataFrame:
    """The documents that the mix takes, one row for each time it takes one, range-sorted by training position; the columns
    of docs and __position (with ``_`` behind it where docs has the name)."""
    m = mixed(docs, **how)
    _, source_size, target, copies, _, before, slope = m.columns[len(docs.columns) :]
    (turn, at) = free_names(m.columns, "__pass", "__at")
    m = m.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(0), (F.col(copies) - 1).cast("int"))))
    m = m.withColumn(at, position(F.col(before) + F.col(turn) * F.col(source_size), F.col(target), F.col(slope)))
    (name,) = free_names(docs.columns, "__position")
    return by_position(m.select(*docs.columns, F.col(at).alias(name)), name, partitions)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = mixed(docs).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__position").alias("position"))
    return by_position(rows, "position")
