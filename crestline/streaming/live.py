"""Live chat buckets, bursts, sessions and fences.

Streams carry event time and a watermark; sinks write each micro-batch to a folder of its number, so that a replay
overwrites what it wrote before, and readers take the last state of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def chat_buckets(messages: DataFrame, width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Messages and reactions of each tumbling window: messages(broadcast_id, ts, text)."""
    windowed = messages.withWatermark("ts", late).groupBy("broadcast_id", F.window("ts", width).alias("w"))
    return windowed.agg(F.count("*").alias("n_messages"), F.count_if(T.is_reaction(F.col("text"))).alias("n_reactions")).select("broadcast_id", F.col("w.start").alias("start"), "n_messages", "n_reactions")


def sessions(support: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of supporting windows (broadcast_id, ts) that are no more than gap apart."""
    grouped = support.withWatermark("ts", late).groupBy("broadcast_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("n")).select("broadcast_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def fence(events: DataFrame, allowed: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events(event_id, session_id, epoch, ts) of allowed(session_id, epoch), each once within the watermark."""
    held = events.join(allowed, ["session_id", "epoch"])
    return held.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def range_report(messages: DataFrame, durations: DataFrame) -> DataFrame:
    """Messages(broadcast_id, ts_ms) inside, before and after their source, counted as they come."""
    held = messages.join(durations.select("broadcast_id", "duration_ms"), "broadcast_id")
    place = F.when(F.col("ts_ms") < 0, "before").when(F.col("ts_ms") >= F.col("duration_ms"), "after").otherwise("inside")
    return held.groupBy("broadcast_id", place.alias("place")).agg(F.count("*").alias("n"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, path: str, mode: str = "update", rocksdb: bool = False, written: Callable[[int], None] | None = None) -> None:
    """Work off all that is there now; each micro-batch overwrites its own folder under path.

    A batch that is repeated after a stop between its write and its commit replaces what it wrote, so that each row is
    there once. ``rocksdb`` picks the state store that ``ordered`` needs; ``written`` is called after each write.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/epoch={number}")
        if written:
            written(number)

    spark, provider = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if rocksdb:
        spark.conf.set(provider, ROCKSDB)
    try:  # a query keeps the settings it is started with
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        if rocksdb:
            spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    query.awaitTermination()


def run_as_it_comes(rows: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, mode: str = "append", groups: int = 4, disorder_s: int = 3600, rocksdb: bool = False) -> None:
    """Deal rows with a column ts out to files as they might arrive, up to ``disorder_s`` late, and work each group off by
    a stream that is stopped after it and goes on from its checkpoint; a last row far ahead moves the watermark on.

    For replays and tests: ``build`` makes the stream's result from a stream of the rows.
    """
    spark, held = rows.sparkSession, rows.schema
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64(*[c for c in rows.columns if not held[c].dataType.simpleString().startswith("map")]), F.lit(disorder_s))
    timed = rows.withColumn("_at", arrival)
    low, high = timed.agg(F.min("_at"), F.max("_at")).first()
    if low is None:
        low, high = 0, 0
    group = F.floor((F.col("_at") - low) * groups / (high - low + 1)).cast("int")
    last = rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(high + 100 * 366 * 86_400)).cast(held["ts"].dataType))
    for k in range(groups + 1):
        part = timed.where(group == k).drop("_at") if k < groups else last
        part.write.mode("append").parquet(f"{path}/in")
        run_to_table(build(spark.readStream.schema(held).parquet(f"{path}/in")), path, mode, rocksdb)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key in the table that run_to_table wrote."""
    rows = spark.read.parquet(f"{path}/batches")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("epoch")))).where("_n = 1").drop("_n", "epoch")
