"""Streaming rollups: windows, distinct counts, top k, sessions and deduplication.

Sketch rows are ordinary aggregates, so a stream keeps them as state; each batch's rows are
what the batch query would give for the input so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sumfold.operators import hll
from sumfold.sources.tables import shared_folder


def timed(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events with a watermark; the column is cast, since timestamps without zone cannot carry one."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed(events: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = (), value: str = "value", ts: str = "ts") -> DataFrame:
    """count, total, low and high of tumbling (or sliding) windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "low", "high")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def registers(events: DataFrame, item: str, keys: tuple[str, ...] = (), precision: int = 14) -> DataFrame:
    """Distinct-count registers as streaming state: (keys, idx, rank)."""
    idx, rank = hll.register(F.col(item), precision)
    return events.where(F.col(item).isNotNull()).select(*keys, idx.alias("idx"), rank.alias("rank")).groupBy(*keys, "idx").agg(F.max("rank").alias("rank"))


def native_distinct(events: DataFrame, item: str, size: str, ts: str = "ts") -> DataFrame:
    """Packed built-in sketches for each window, mergeable later."""
    return events.groupBy(F.window(ts, size)).agg(F.hll_sketch_agg(item).alias("sketch")).select(F.col("window.start").alias("start"), "sketch")


def frequencies(events: DataFrame, item: str) -> DataFrame:
    return events.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.count("*").alias("freq"))


def top_k_sink(k: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in complete mode: hands the k most frequent items of each batch to the sink."""

    def each(df: DataFrame, epoch: int) -> None:
        sink(df.orderBy(F.desc("freq"), "item").limit(k), epoch)

    return each


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """(key, seen): each key once, when it first comes, with state kept for ever."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = sum(len(b) for b in batches)
        if not state.exists:
            yield pd.DataFrame({"key": [k[0]], "seen": [n]})
        state.update((n + (state.get[0] if state.exists else 0),))

    return events.select(F.col(key).alias("key")).groupBy("key").applyInPandasWithState(step, "key long, seen long", "n long", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain what is available into a table of the shared folder and give it back: the last result in complete mode, else all batches.

    Rows are written by the executors; the table and the query's state go with the application.
    """
    spark, epochs = df.sparkSession, []
    path = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{epoch}")
        epochs.append(epoch)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    if not epochs:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{path}/rows/{e}" for e in (epochs[-1:] if mode == "complete" else sorted(set(epochs)))])
