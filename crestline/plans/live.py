"""Queries of the streaming operators: each works off the events table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..storage import fresh_path
from ..streaming import live, ordered
from .tables import MESSAGES, read


def _stream(spark, sf_dir):
    """Events as a stream; a clock in milliseconds of the day counts in place of wall time, 24 times as slow."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    return stream.selectExpr("event_id", "user_id", "cast(day(ts) as bigint) as broadcast_id", "cast(ts as timestamp) as ts", "event_type as text", "cast((hour(ts) * 60 + minute(ts)) / 2 as int) as bucket")


def stream_chat_buckets(spark, sf_dir):
    path = fresh_path(spark, "stream-buckets")
    marked = F.when(F.col("event_id") % 3 == 0, F.concat("text", F.lit("!!"))).when(F.col("event_id") % 7 == 1, F.lit("ㅋㅋㅋ")).otherwise(F.col("text"))
    live.run_to_table(live.chat_buckets(_stream(spark, sf_dir).withColumn("text", marked), "120 seconds", "10 minutes"), path)
    found = live.latest(spark, path, ["broadcast_id", "start"])
    return found.select("broadcast_id", ((F.hour("start") * 60 + F.minute("start")) / 2).cast("int").alias("bucket"), "n_messages", "n_reactions")


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "cast(day(ts) as bigint) as broadcast_id", "cast(ts as timestamp) as ts", "event_type as text", "value")


def stream_sessions(spark, sf_dir):
    """Sessions as they end: each is written once, when the watermark has passed it."""
    path = fresh_path(spark, "stream-sessions")
    support = _events(spark, sf_dir).where("text in ('purchase', 'error')").select("broadcast_id", "ts")
    live.run_as_it_comes(support, lambda stream: live.sessions(stream, "5 minutes", "2 hours"), path)
    return spark.read.parquet(f"{path}/batches").groupBy("broadcast_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


def stream_fence(spark, sf_dir):
    """Purchases of the even sessions, each event once."""
    path = fresh_path(spark, "stream-fence")
    events = _stream(spark, sf_dir).where("text = 'purchase'").selectExpr("event_id", "user_id % 10 as session_id", "user_id % 2 as epoch", "ts")
    allowed = read(spark, sf_dir, "events").selectExpr("user_id % 10 as session_id", "cast(0 as bigint) as epoch").distinct()
    live.run_to_table(live.fence(events, allowed), path, "append")
    return spark.read.parquet(f"{path}/batches").select("event_id", "session_id")


def stream_range_report(spark, sf_dir):
    """Messages against a source of 50 minutes that begins five minutes late."""
    path = fresh_path(spark, "stream-ranges")
    late = _stream(spark, sf_dir).selectExpr("broadcast_id", "cast((unix_millis(ts) % 86400000) / 24 as bigint) - 300000 as ts_ms")
    ends = read(spark, sf_dir, "events").selectExpr("cast(day(ts) as bigint) as broadcast_id", "cast(3000000 as bigint) as duration_ms").distinct()
    live.run_to_table(live.range_report(late, ends), path)
    return live.latest(spark, path, ["broadcast_id", "place"])


def stream_audio_windows(spark, sf_dir):
    """Windows of two channels at 64 Hz, a second for each embedding, 50 for a broadcast, as they come."""
    path = fresh_path(spark, "stream-audio")
    chunks = read(spark, sf_dir, "embeddings").selectExpr("cast(floor(vec_id / 50) as bigint) as broadcast_id", "cast(vec_id % 50 as int) as i", "array(embedding, reverse(embedding)) as channels", "timestamp_seconds(1700000000 + vec_id) as ts")
    live.run_as_it_comes(chunks, lambda stream: ordered.sound_windows(stream, 64, "2 minutes", 600_000), path, disorder_s=60, rocksdb=True)
    return spark.read.parquet(f"{path}/batches").drop("epoch")


def stream_bursts(spark, sf_dir):
    """Burst scores of the buckets that have messages, which come up to an hour late."""
    path = fresh_path(spark, "stream-bursts")
    bucket = _events(spark, sf_dir).selectExpr("broadcast_id", "cast((hour(ts) * 60 + minute(ts)) / 2 as int) as bucket", "date_trunc('DAY', ts) as day")
    counted = bucket.groupBy("broadcast_id", "bucket", "day").agg(F.count("*").alias("n"))
    counted = counted.select("broadcast_id", "bucket", "n", F.timestamp_seconds(F.unix_seconds("day") + F.col("bucket") * 120).alias("ts"))
    live.run_as_it_comes(counted, lambda stream: ordered.bursts(stream, "2 hours"), path, rocksdb=True)
    return spark.read.parquet(f"{path}/batches").selectExpr("broadcast_id", "bucket", "n", "floor(score * 1e6 + 0.5) / 1e6 as score")


def stream_edits(spark, sf_dir):
    """The last state of each item whose edit commands come up to an hour late."""
    path = fresh_path(spark, "stream-edits")
    commands = _events(spark, sf_dir).selectExpr("user_id as item", "event_id as seq", "cast(event_id % 4 as bigint) as expected_revision", "cast(floor(value * 1000) as bigint) as start_ms", "cast(floor(value * 1000) + 45000 as bigint) as end_ms", "ts")
    live.run_as_it_comes(commands, lambda stream: ordered.apply_edits(stream, "2 hours", 100 * 86_400_000), path, rocksdb=True)
    verdicts = spark.read.parquet(f"{path}/batches")
    per = verdicts.groupBy("item").agg(F.max(F.struct("revision", "refused", "start_ms", "end_ms")).alias("s"), F.count_if(F.col("status") == "applied").alias("n_applied"), F.count_if(F.col("status") == "stale-revision").alias("n_stale"), F.count_if(F.col("status") == "future-revision").alias("n_future"))
    return per.select("item", "s.*", "n_applied", "n_stale", "n_future")


QUERIES = {
    "stream_audio_windows": (stream_audio_windows, None),
    "stream_range_report": (stream_range_report, f"WITH {MESSAGES} SELECT broadcast_id, CASE WHEN ts_ms - 300000 < 0 THEN 'before' WHEN ts_ms - 300000 >= 3000000 THEN 'after' ELSE 'inside' END AS place, count(*) AS n FROM messages GROUP BY ALL"),
    "stream_chat_buckets": (stream_chat_buckets, f"WITH {MESSAGES} SELECT broadcast_id, CAST(ts_ms // 5000 AS INTEGER) AS bucket, count(*) AS n_messages, count(*) FILTER (WHERE event_id % 3 = 0 OR event_id % 7 = 1) AS n_reactions FROM messages GROUP BY ALL"),
    "stream_sessions": (stream_sessions, """WITH e AS (SELECT day(ts) AS broadcast_id, ts, ts - lag(ts) OVER (PARTITION BY day(ts) ORDER BY ts) AS gap FROM events WHERE event_type IN ('purchase', 'error'))
      SELECT broadcast_id, count(*) FILTER (WHERE gap IS NULL OR gap >= INTERVAL 5 MINUTE) AS n_sessions, count(*) AS n_events FROM e GROUP BY ALL"""),
    "stream_fence": (stream_fence, "SELECT event_id, user_id % 10 AS session_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0"),
    "stream_bursts": (stream_bursts, """WITH c AS (SELECT day(ts) AS broadcast_id, CAST((hour(ts) * 60 + minute(ts)) // 2 AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY ALL),
      l AS (SELECT *, list(n) OVER (PARTITION BY broadcast_id ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 2 PRECEDING) AS b FROM c), m AS (SELECT *, list_median(b) AS c FROM l WHERE len(b) >= 4)
      SELECT broadcast_id, bucket, n, floor(least(8.0, greatest(-3.0, (n - c) / greatest(1.0, 1.4826 * list_median(list_transform(b, lambda x: abs(x - c)))))) * 1e6 + 0.5) / 1e6 AS score FROM m"""),
    "stream_edits": (stream_edits, """WITH RECURSIVE e AS (SELECT user_id AS item, event_id % 4 AS x, CAST(floor(value * 1000) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      f AS (SELECT DISTINCT item, 0::BIGINT AS rn, 0::BIGINT AS revision, 0::BIGINT AS stale, 0::BIGINT AS future, NULL::BIGINT AS start_ms FROM e UNION ALL
        SELECT f.item, e.rn, CASE WHEN x = revision THEN revision + 1 ELSE revision END, CASE WHEN x < revision THEN stale + 1 ELSE stale END, CASE WHEN x > revision THEN future + 1 ELSE future END, CASE WHEN x = revision THEN s ELSE start_ms END FROM f JOIN e ON e.item = f.item AND e.rn = f.rn + 1)
      SELECT item, revision, stale + future AS refused, start_ms, start_ms + 45000 AS end_ms, revision AS n_applied, stale AS n_stale, future AS n_future FROM f QUALIFY row_number() OVER (PARTITION BY item ORDER BY rn DESC) = 1"""),
}
