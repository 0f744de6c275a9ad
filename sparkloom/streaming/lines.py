"""Streams of lines: a stateless function for each record, counts by event time, and table changes by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dml


def read_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A TCP stream, one row for each line."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def framed(chunks: DataFrame, channel: str, order: str, data: str, terminator: str = "\n") -> DataFrame:
    """Records of streams that come in chunks: (channel, n, record), n counting each channel's records from 0.

    A record ends with the terminator, which may itself be cut by a chunk's end; what follows the last one waits for the next chunk as the
    channel's state, so a query that goes on from its checkpoint gives each record once.  A channel's chunks of one micro-batch are taken
    by ``order``; those of later ones follow.  NULL chunks are empty.
    """
    kind = chunks.schema[channel].dataType.simpleString()

    def cut(key, frames, state: GroupState):
        rest, n = state.get if state.exists else ("", 0)
        parts = pd.concat(list(frames)).sort_values(order, kind="stable")[data]
        *records, rest = (rest + "".join(x for x in parts if x is not None)).split(terminator)
        state.update((rest, n + len(records)))
        yield pd.DataFrame({channel: [key[0]] * len(records), "n": range(n, n + len(records)), "record": records})

    rows = chunks.select(channel, order, F.col(data).cast("string").alias(data))
    return rows.groupBy(channel).applyInPandasWithState(cut, f"`{channel}` {kind}, n bigint, record string", "rest string, n bigint", "append", GroupStateTimeout.NoTimeout)


def read_files(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def answered(requests: DataFrame, answer: Callable[[Column], Column], column: str = "value") -> DataFrame:
    """Each request with its answer, an expression of the request alone."""
    return requests.withColumn("answer", answer(F.col(column)))


def counted(events: DataFrame, at: str, by: list[str], window: str, late: str) -> DataFrame:
    """Rows by key and event-time window; rows later than ``late`` behind the newest are left out, and state is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def upsert_into(rows: DataFrame, table: dml.Snapshots, key: list[str], on_match: dict, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert each micro-batch into a snapshot table; a batch that is run again has the same result when ``on_match`` replaces
    values by new ones."""

    def one(batch: DataFrame, _: int) -> None:
        base = table.read() if table.versions() else batch.limit(0)
        table.publish(dml.upsert(base, batch, key, on_match))

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
