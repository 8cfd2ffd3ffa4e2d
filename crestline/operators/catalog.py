"""Catalogs of videos: upserts, due queues, retries, retention, libraries, identity.

videos(channel_id, video_id, title, published_at, state, stage, attempts, next_at, artifact) throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hours until the next try by attempt; for missing captions, which seldom appear later.
RETRY_HOURS, CAPTION_HOURS = (3, 6, 12, 24), (24, 72, 168, 336)


def within_window(published: Column, now: Column, days: int) -> Column:
    return (published <= now) & (published >= now - F.make_dt_interval(F.lit(days)))


def next_retry(attempts: Column, permanent: Column, now: Column) -> Column:
    """When to try again after one more failure."""
    pick = lambda hours: F.element_at(F.array(*map(F.lit, hours)), F.least(attempts + 1, F.lit(len(hours))).cast("int"))
    return now + F.make_dt_interval(F.lit(0), F.when(permanent, pick(CAPTION_HOURS)).otherwise(pick(RETRY_HOURS)))


def due_videos(videos: DataFrame, now: Column, days: int, limit: int) -> DataFrame:
    """Work that is due in each channel: fresh videos first, then retries by kind, newest first."""
    retry = F.col("state") == "retryable"
    due = videos.where(within_window(F.col("published_at"), now, days) & (F.col("state") != "published") & (~retry | (F.col("next_at").isNotNull() & (F.col("next_at") <= now))))
    rank = F.when(~retry, 0).when(F.col("permanent"), 3).when(F.col("stage") == "fingerprint", 2).otherwise(1)
    order = W.partitionBy("channel_id").orderBy("rank", F.desc("published_at"), "video_id")
    return due.withColumn("rank", rank).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= limit)


def work_queue(videos: DataFrame, now: Column, days: int) -> DataFrame:
    """Unfinished videos with their phase and whether they are ready, in order of readiness and age."""
    retry = F.when(F.col("stage") == "context", "context").when(F.col("stage").isin("review", "fingerprint"), "review").otherwise("caption")
    phase = F.when(F.col("state") == "retryable", retry).when(F.col("state") == "transcript-ready", "context").when(F.col("state") == "context-ready", "review").otherwise("caption")
    open_ = videos.where(within_window(F.col("published_at"), now, days) & ~F.col("state").isin("published", "review-ready"))
    ready = F.col("next_at").isNull() | (F.col("next_at") <= now)
    order = W.partitionBy("channel_id").orderBy(F.desc("ready"), F.desc("published_at"), "video_id")
    return open_.withColumn("phase", phase).withColumn("ready", ready).withColumn("place", F.row_number().over(order))


def merge_catalog(catalog: DataFrame, feed: DataFrame) -> DataFrame:
    """Catalog after a feed: new videos come in, title and time of known ones follow the feed unless an artifact
    freezes them, and the revision moves only on change."""
    c = catalog.select("video_id", F.col("title").alias("c_title"), F.col("published_at").alias("c_pub"), "artifact", "revision", F.lit(True).alias("known"))
    f = feed.select("video_id", F.col("title").alias("f_title"), F.col("published_at").alias("f_pub"), F.lit(True).alias("fed"))
    both = c.join(f, "video_id", "full_outer")
    frozen = F.col("artifact").isNotNull() | F.col("fed").isNull()
    title, pub = F.when(frozen, F.col("c_title")).otherwise(F.col("f_title")), F.when(frozen, F.col("c_pub")).otherwise(F.col("f_pub"))
    changed = F.col("known").isNotNull() & ~(title.eqNullSafe(F.col("c_title")) & pub.eqNullSafe(F.col("c_pub")))
    revision = F.when(F.col("known").isNull(), 1).otherwise(F.col("revision") + changed.cast("int"))
    return both.select("video_id", title.alias("title"), pub.alias("published_at"), "artifact", revision.alias("revision"), F.when(F.col("known").isNull(), "added").when(changed, "changed").otherwise("same").alias("change"))


def plan_retention(jobs: DataFrame, now_day: Column, keep_days: int, cap: int) -> DataFrame:
    """What goes from each owner's jobs(owner, job_id, status, day, bytes): abandoned ones, completed ones past their
    time, and then the oldest completed ones until the rest fits the cap - if that can be reached at all."""
    first = F.when(F.col("status") == "abandoned", "abandoned").when((F.col("status") == "completed") & (F.datediff(now_day, F.col("day")) >= keep_days), "past_retention")
    df = jobs.withColumn("reason", first)
    whole = W.partitionBy("owner")
    rest = F.sum(F.when(F.col("reason").isNull(), F.col("bytes")).otherwise(0)).over(whole)
    guarded = F.sum(F.when(F.col("reason").isNull() & (F.col("status") != "completed"), F.col("bytes")).otherwise(0)).over(whole)
    evictable = F.col("reason").isNull() & (F.col("status") == "completed")
    before = F.sum(F.when(evictable, F.col("bytes")).otherwise(0)).over(whole.orderBy("day", "job_id").rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("rest", rest).withColumn("guarded", guarded).withColumn("before", F.coalesce(before, F.lit(0)))
    over = evictable & (F.col("guarded") <= cap) & (F.col("rest") - F.col("before") > cap)
    return df.withColumn("reason", F.when(over, "over_cap").otherwise(F.col("reason"))).where("reason is not null").drop("rest", "guarded", "before")


def rotate_sources(sources: DataFrame, hour: int, every: int = 3) -> DataFrame:
    """Fair order of the sources(n, ...): the start moves on by one every few hours."""
    size = sources.agg(F.count("*").alias("size"))
    return sources.crossJoin(F.broadcast(size)).withColumn("turn", F.pmod(F.col("n") - hour // every, F.col("size"))).drop("size")


def _spread(queries: DataFrame, key: str, right: DataFrame, parts: int = 64) -> DataFrame:
    """Left join by key; the many rows without a key, which match nothing, are dealt over parts and do not meet in one task."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64("query_id"), F.lit(parts))).otherwise(0).cast("long")
    return queries.withColumn("_salt", salt).join(right.withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left").drop("_salt")


def titled_alike(queries: DataFrame, videos: DataFrame, tolerance_ms: int) -> DataFrame:
    """query_id, n, found: the number of videos with a query's title whose length in whole milliseconds differs by no more,
    and the video if it is one. Pairs are never made: videos are counted in order of length, up to both ends of a query's
    range, under every bin of lengths that they reach, so that a frequent title is many tasks."""
    bin_ms = 16 * tolerance_ms + 16
    files = videos.where("title is not null and duration_ms is not null").groupBy("title", "duration_ms").agg(F.count("*").alias("n"), F.min("video_id").alias("video_id"))
    at = lambda d: F.floor((F.col("duration_ms") + d) / bin_ms)
    files = files.withColumn("bin", F.explode(F.sequence(at(-tolerance_ms), at(tolerance_ms)))).withColumn("query_id", F.lit(None).cast(queries.schema["query_id"].dataType))
    asked = queries.where("title is not null and duration_ms is not null and query_id is not null").select("title", "duration_ms", F.lit(0).cast("long").alias("n"), F.lit(None).cast(videos.schema["video_id"].dataType).alias("video_id"), at(0).alias("bin"), "query_id")
    order = W.partitionBy("title", "bin").orderBy("duration_ms")
    to_end, to_start = order.rangeBetween(W.unboundedPreceding, tolerance_ms), order.rangeBetween(W.unboundedPreceding, -tolerance_ms - 1)
    counted = files.unionByName(asked).select("query_id", (F.sum("n").over(to_end) - F.coalesce(F.sum("n").over(to_start), F.lit(0))).alias("n"), F.last("video_id", ignorenulls=True).over(to_end).alias("found"))
    return counted.where("query_id is not null and n > 0").groupBy("query_id").agg(F.sum("n").alias("n"), F.min("found").alias("found"))


def match_catalog(queries: DataFrame, videos: DataFrame, tolerance_ms: int = 2000) -> DataFrame:
    """Identity of queries(query_id, video_id, fingerprint, title, duration_ms): by id, else by a registered fingerprint,
    else by a title and length, that only one video of videos(video_id, fingerprint, title, duration_ms) has."""
    by_id = _spread(queries, "video_id", videos.select("video_id").withColumn("direct", F.lit(True)))
    near = titled_alike(queries, videos, tolerance_ms)
    registered = videos.where("fingerprint is not null").groupBy("fingerprint").agg(F.count_distinct("video_id").alias("n_prints"), F.min("video_id").alias("printed"))
    both = _spread(by_id, "fingerprint", registered).join(near, "query_id", "left")
    one_print, one_title = F.coalesce(F.col("n_prints") == 1, F.lit(False)), F.coalesce(F.col("n") == 1, F.lit(False))
    status = F.when(F.col("direct"), "by-id").when(one_print, "by-fingerprint").when(F.col("n_prints") > 1, "ambiguous").when(one_title, "by-title").when(F.col("n") > 1, "ambiguous").otherwise("none")
    match = F.when(F.col("direct"), F.col("video_id")).when(one_print, F.col("printed")).when(F.col("n_prints").isNull() & one_title, F.col("found"))
    return both.select("query_id", status.alias("status"), match.alias("match"))


def library(videos: DataFrame) -> DataFrame:
    """Review-ready videos of each channel, newest first."""
    ready = videos.where("state in ('published', 'review-ready')")
    return ready.withColumn("place", F.row_number().over(W.partitionBy("channel_id").orderBy(F.desc("published_at"), "video_id")))
