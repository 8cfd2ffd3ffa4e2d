"""Chat: alignment, five-second buckets, rolling robust baselines, bursts and highlight intervals.

Input is messages(broadcast_id, ts_ms, text, author_id) and durations(broadcast_id, duration_ms). Texts and authors do
not leave the bucket aggregation. Every step is an aggregate or a window by broadcast; a broadcast has at most as many
buckets as its length divided by BUCKET_MS, whatever the number of messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from .greedy import keep_disjoint

#: Width of a bucket, buckets of a baseline and the least of them, length and number of highlights.
BUCKET_MS, BASELINE, LEAST_BASELINE = 5000, 60, 4
WINDOW_MS, MOST = 45_000, 12


def align(messages: DataFrame, durations: DataFrame, offset_ms: int = 0, clamp: bool = False) -> DataFrame:
    """Messages with ts_ms shifted into the source; those outside go, or are clamped to its ends."""
    shifted = messages.join(durations, "broadcast_id").withColumn("shifted", (N.round_half_up(F.col("ts_ms")) + offset_ms).cast("long"))
    inside = F.col("shifted").between(0, F.col("duration_ms") - 1)
    kept = shifted if clamp else shifted.where(inside)
    return kept.withColumn("ts_ms", N.clamp(F.col("shifted"), 0, F.col("duration_ms") - 1)).drop("shifted")


def alignment_counts(messages: DataFrame, durations: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Messages inside, before and after the source, by broadcast."""
    at = (N.round_half_up(F.col("ts_ms")) + offset_ms).cast("long")
    return messages.join(durations, "broadcast_id").groupBy("broadcast_id").agg(
        F.count_if(at.between(0, F.col("duration_ms") - 1)).alias("n_inside"), F.count_if(at < 0).alias("n_before"), F.count_if(at >= F.col("duration_ms")).alias("n_after")
    )


def buckets(messages: DataFrame) -> DataFrame:
    """Counts of each bucket that has messages: messages, reactions, authors, the busiest author, repeated texts.

    Authors and texts are pre-aggregated in turn, so that no bucket's messages meet in one task.
    """
    keyed = messages.select("broadcast_id", F.floor(F.col("ts_ms") / BUCKET_MS).cast("int").alias("bucket"), "author_id", T.norm_repeat(F.col("text")).alias("norm"), T.is_reaction(F.col("text")).alias("reaction"))
    fine = keyed.groupBy("broadcast_id", "bucket", "author_id", "norm").agg(F.count("*").alias("n"), F.count_if("reaction").alias("r"))
    by_author = fine.groupBy("broadcast_id", "bucket", "author_id").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    authors = by_author.groupBy("broadcast_id", "bucket").agg(
        F.sum("n").alias("n_messages"), F.sum("r").alias("n_reactions"), F.count_if(F.col("author_id").isNotNull() & (F.col("author_id") != "")).alias("n_authors"),
        F.coalesce(F.max(F.when(F.col("author_id").isNotNull() & (F.col("author_id") != ""), F.col("n"))), F.lit(0)).alias("top_author"),
    )
    by_text = fine.where("norm <> ''").groupBy("broadcast_id", "bucket", "norm").agg(F.sum("n").alias("n"))
    texts = by_text.groupBy("broadcast_id", "bucket").agg(F.sum(F.col("n") - 1).alias("n_repeats"))
    return authors.join(texts, ["broadcast_id", "bucket"], "left").fillna({"n_repeats": 0})


def densify(counts: DataFrame, durations: DataFrame) -> DataFrame:
    """One row for each bucket of the source; those without messages count zero."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / BUCKET_MS)).cast("int")
    axis = durations.select("broadcast_id", "duration_ms", F.explode(F.sequence(F.lit(0), n - 1)).alias("bucket"))
    return axis.join(counts, ["broadcast_id", "bucket"], "left").fillna(0, ["n_messages", "n_reactions", "n_authors", "top_author", "n_repeats"])


def _baselines(dense: DataFrame) -> DataFrame:
    """dense with the rolling counts before each bucket; the first few take all buckets that are not next to them."""
    frame = W.partitionBy("broadcast_id").orderBy("bucket").rowsBetween(-BASELINE, -2)
    rolled = dense.withColumn("m", F.collect_list("n_messages").over(frame)).withColumn("u", F.collect_list("n_authors").over(frame))
    early = dense.where(F.col("bucket") - 1 < LEAST_BASELINE).select("broadcast_id", F.col("bucket").alias("at"))
    rest = early.join(dense, "broadcast_id").where(F.abs(F.col("bucket") - F.col("at")) > 1)
    rest = rest.groupBy("broadcast_id", F.col("at").alias("bucket")).agg(F.collect_list("n_messages").alias("m2"), F.collect_list("n_authors").alias("u2"))
    both = rolled.join(rest, ["broadcast_id", "bucket"], "left")
    return both.withColumn("m", F.coalesce("m2", "m")).withColumn("u", F.coalesce("u2", "u")).drop("m2", "u2")


def _signal(df: DataFrame, name: str, values: str, current: str) -> DataFrame:
    """Baseline, robust score and ratio of a count against its baseline values."""
    df = df.withColumn(f"{name}_base", N.array_median(F.col(values)))
    df = df.withColumn(f"{name}_mad", N.array_mad(F.col(values), F.col(f"{name}_base")))
    none = F.size(values) == 0
    score = F.when(none, 0.0).otherwise(N.robust_score(F.col(current).cast("double"), F.col(f"{name}_base"), F.col(f"{name}_mad"), 1.0))
    ratio = F.when(none, 1.0).otherwise((F.col(current) + 1) / (F.col(f"{name}_base") + 1))
    return df.withColumn(f"{name}_score", score).withColumn(f"{name}_ratio", ratio).drop(values)


def score_buckets(dense: DataFrame) -> DataFrame:
    """Burst evidence, score and eligibility of every bucket."""
    df = _signal(_signal(_baselines(dense), "msg", "m", "n_messages"), "uniq", "u", "n_authors")
    n = F.col("n_messages")
    repetition, single, reaction = N.safe_ratio(F.col("n_repeats"), n), N.safe_ratio(F.col("top_author"), n), N.safe_ratio(F.col("n_reactions"), n)
    df = df.withColumn("repetition", repetition).withColumn("single_author", single).withColumn("reaction_ratio", reaction)
    spam = (F.col("repetition") >= 0.8) & (F.col("single_author") >= 0.75)
    penalty = F.col("repetition") * 3 + F.greatest(F.lit(0.0), F.col("single_author") - 0.5) * 4 + F.when(spam, 2.0).otherwise(0.0)
    df = df.withColumn("spam_penalty", penalty)
    raw = F.greatest(F.lit(0.0), F.col("msg_score")) * 1.1 + F.greatest(F.lit(0.0), F.col("uniq_score")) * 0.8 + F.col("reaction_ratio") * 2.25 + F.log1p(n) * 0.15 - F.col("spam_penalty")
    burst = (n >= 4) & ((F.col("msg_score") >= 2.5) | (F.col("msg_ratio") >= 2.5))
    together = (F.col("n_authors") >= 3) & (F.col("n_reactions") >= 2) & ((F.col("uniq_score") >= 1.5) | (F.col("uniq_ratio") >= 2))
    return df.withColumn("raw", raw).withColumn("eligible", (burst | together) & ~spam & (F.col("raw") >= 2.25)).withColumn("score", N.round_half_up(F.col("raw"), 6)).drop("raw")


def local_peaks(scored: DataFrame) -> DataFrame:
    """Eligible buckets above the one before and not below the one after."""
    w = W.partitionBy("broadcast_id").orderBy("bucket")
    low = F.lit(float("-inf"))
    around = scored.withColumn("before", F.coalesce(F.lag("score").over(w), low)).withColumn("after", F.coalesce(F.lead("score").over(w), low))
    return around.where(F.col("eligible") & (F.col("score") > F.col("before")) & (F.col("score") >= F.col("after"))).drop("before", "after")


def select_highlights(messages: DataFrame, durations: DataFrame, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """Highlight intervals of chat: best peaks first, none overlapping, at most ``most`` for a broadcast."""
    peaks = local_peaks(score_buckets(densify(buckets(align(messages, durations)), durations)))
    peak = F.least(F.col("duration_ms"), F.col("bucket") * BUCKET_MS + BUCKET_MS // 2)
    width = F.least(F.lit(window_ms), F.col("duration_ms"))
    before = int(window_ms * 4 / 9 + 0.5)
    start = N.clamp(peak - before, 0, F.greatest(F.lit(0), F.col("duration_ms") - width))
    ranked = peaks.withColumn("peak_ms", peak.cast("long")).withColumn("start_ms", start.cast("long")).withColumn("end_ms", (start + width).cast("long"))
    return keep_disjoint(ranked, ["broadcast_id"], [F.desc("score"), F.asc("bucket")], most)
