"""Caption tracks, feeds, manifests and fingerprints as tables; edit lists as CSV, JSON, Markdown and SRT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

EVENTS = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
MOST_CUES, CUE_CHARS = 120_000, 500


def captions_from_json3(tracks: DataFrame, key: str = "broadcast_id", value: str = "value") -> DataFrame:
    """Cues of caption tracks in JSON: segments joined and cleaned, cues without text or time and repeats of the cue
    before left out."""
    events = tracks.select(key, F.posexplode(F.from_json(value, EVENTS)["events"]).alias("n", "e"))
    text = T.clean_text(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), CUE_CHARS)
    cues = events.select(key, "n", F.col("e.tStartMs").alias("start_ms"), F.coalesce("e.dDurationMs", F.lit(0)).alias("duration_ms"), text.alias("text"))
    cues = cues.where((F.col("start_ms") >= 0) & (F.col("duration_ms") >= 0) & (F.col("text") != ""))
    order = W.partitionBy(key).orderBy("n")
    fresh = cues.withColumn("_s", F.lag("start_ms").over(order)).withColumn("_t", F.lag("text").over(order)).where("_s is null or not (_s = start_ms and _t = text)")
    return fresh.withColumn("cue", F.row_number().over(order)).where(F.col("cue") <= MOST_CUES).select(key, "cue", "start_ms", "duration_ms", "text")


def read_captions_json3(spark: SparkSession, path: str) -> DataFrame:
    return captions_from_json3(spark.read.text(path, wholetext=True).withColumn("broadcast_id", F.input_file_name()))


def read_atom_feed(spark: SparkSession, path: str, most_bytes: int = 2_000_000) -> DataFrame:
    return feed_videos(spark.read.text(path, wholetext=True), most_bytes)


def feed_videos(files: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """Videos of channel feeds(value); oversize feeds and feeds with a document type or entity are left out."""
    files = files.where((F.octet_length("value") <= most_bytes) & ~F.upper("value").rlike("<!DOCTYPE|<!ENTITY"))
    entries = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("e"))
    tag = lambda t: F.regexp_extract("e", rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1)
    return entries.select(tag("yt:videoId").alias("video_id"), tag("yt:channelId").alias("channel_id"), tag("title").alias("title"), F.try_to_timestamp(tag("published")).alias("published_at"), F.try_to_timestamp(tag("updated")).alias("updated_at"))


CATALOG = "struct<videos:array<struct<channelId:string,videoId:string,title:string,durationMs:bigint,publishedAt:string,updatedAt:string,state:string,revision:int,artifactIds:array<string>>>>"
FINGERPRINT = "struct<videoId:string,sourceDurationMs:bigint,anchors:array<struct<timestampMs:bigint,dHash64:string,blockHash64:string,meanLuma:int,edgeEnergy:int>>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_videos(spark.read.text(path, wholetext=True))


def catalog_videos(files: DataFrame) -> DataFrame:
    """One row for each video of catalog manifests(value)."""
    v = files.select(F.explode(F.from_json("value", CATALOG)["videos"]).alias("v")).select("v.*")
    at = lambda c: F.try_to_timestamp(c)
    return v.select(F.col("channelId").alias("channel_id"), F.col("videoId").alias("video_id"), "title", F.col("durationMs").alias("duration_ms"), at("publishedAt").alias("published_at"), at("updatedAt").alias("updated_at"), "state", "revision", F.col("artifactIds").alias("artifact_ids"))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return fingerprint_anchors(spark.read.text(path, wholetext=True))


def fingerprint_anchors(files: DataFrame) -> DataFrame:
    """One row for each anchor of fingerprint files(value); hashes as 64-bit patterns."""
    files = files.select(F.from_json("value", FINGERPRINT).alias("f")).select("f.*")
    bits = lambda c: F.conv(c, 16, -10).cast("bigint")
    return files.select("videoId", F.posexplode("anchors").alias("anchor", "a")).select(F.col("videoId").alias("video_id"), "anchor", F.col("a.timestampMs").alias("ts_ms"), bits(F.col("a.dHash64")).alias("dhash"), bits(F.col("a.blockHash64")).alias("blockhash"), F.col("a.meanLuma").alias("mean_luma"), F.col("a.edgeEnergy").alias("edge"))


def caption_track_ref(pages: DataFrame, language: str = "ko") -> DataFrame:
    """Address of a page's caption track in a language, from the player data in its markup."""
    track = F.regexp_extract("html", rf'"baseUrl":"([^"]+)"[^{{}}]*"languageCode":"{language}"', 1)
    return pages.select("page_id", F.when(track != "", F.regexp_replace(track, r"\\u0026", "&")).alias("caption_url"))


def artifact_rows(df: DataFrame, payload: str, *keys: str) -> DataFrame:
    """Content-addressed rows: digest, length and storage key of a payload."""
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    return df.select(*keys, digest.alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest).alias("storage_key"))


def csv_cells(edits: DataFrame) -> DataFrame:
    """Lines of an edit list: title, start, end, length, reason and note, each quoted and safe for spreadsheets."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(T.csv_safe(c), F.lit('"'), F.lit('""')), F.lit('"'))
    span = (F.col("end_ms") - F.col("start_ms"))
    return edits.withColumn("line", F.concat_ws(",", *map(cell, (F.col("title"), T.timecode(F.col("start_ms")), T.timecode(F.col("end_ms")), T.timecode(span), F.col("reason"), F.col("note")))))


def write_highlights_csv(edits: DataFrame, path: str) -> None:
    csv_cells(edits).select("line").write.text(path)


def highlights_json(edits: DataFrame) -> DataFrame:
    """One JSON object for each edit."""
    return edits.select("broadcast_id", "id", F.to_json(F.struct("id", "title", "start_ms", "end_ms", "reason")).alias("json"))


def write_highlights_json(edits: DataFrame, path: str) -> None:
    highlights_json(edits).select("json").write.text(path)


def highlights_markdown(edits: DataFrame) -> DataFrame:
    """A list in Markdown for each broadcast, in order of time."""
    line = F.concat(F.lit("- "), T.timecode(F.col("start_ms")), F.lit("–"), T.timecode(F.col("end_ms")), F.lit(" "), F.col("title"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "id", line.alias("line")))), lambda x: x["line"])
    return edits.groupBy("broadcast_id").agg(F.array_join(lines, "\n").alias("markdown"))


def clip_srt(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Subtitles of each clip(broadcast_id, clip, start_ms, end_ms), times from the clip's own start."""
    from ..operators.intervals import overlap_join

    hit = overlap_join(clips, cues.select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "cue", "text"), ["broadcast_id"])
    hit = hit.withColumn("a", F.greatest("start_ms", "r_start") - F.col("start_ms")).withColumn("b", F.least("end_ms", "r_end") - F.col("start_ms"))
    rows = hit.groupBy("broadcast_id", "clip").agg(F.array_sort(F.collect_list(F.struct("a", "cue", "b", "text"))).alias("rows"))
    block = lambda r, i: F.concat((i + 1).cast("string"), F.lit("\r\n"), T.srt_time(r["a"]), F.lit(" --> "), T.srt_time(r["b"]), F.lit("\r\n"), r["text"], F.lit("\r\n"))
    return rows.select("broadcast_id", "clip", F.concat(F.array_join(F.transform("rows", block), "\r\n"), F.lit("\r\n")).alias("srt"))
