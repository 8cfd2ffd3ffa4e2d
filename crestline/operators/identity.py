"""Which video a broadcast is: fingerprint anchors against sampled frames, and the decision over time offsets.

Videos and broadcasts meet by their length before any frame is compared: the tolerance of a length is bounded, so that
both are filed under lengths and joined by equality. Frames of a pair then meet by time. A pair's anchors are bounded (16),
so that all that is gathered here is; a length that many videos share makes as many pairs as there are candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N

# Limits of the decision.
#: Least and greatest tolerance of a length, and its share of the length.
TOLERANCE_MS, TOLERANCE_SHARE = (2_000, 10_000), 0.001
#: A sample is compared with an anchor within this time; offsets and their step.
SAMPLE_MS, OFFSET_MS, OFFSET_STEP_MS = 2_750, 30_000, 5_000
#: Bits that may differ in the difference hash, the block hash and both; luma that the means may differ.
DHASH_BITS, BLOCK_BITS, BOTH_BITS, LUMA = 18, 20, 32, 56
#: Anchors that must agree, at least and as a share; the median and the ninetieth percentile of their distances at most.
LEAST_ANCHORS, ANCHOR_SHARE, MEDIAN_BITS, P90_BITS = 8, 0.67, 21, 32


def duration_tolerance(duration_ms: Column) -> Column:
    return F.least(F.lit(TOLERANCE_MS[1]), F.greatest(F.lit(TOLERANCE_MS[0]), N.round_half_up(duration_ms * TOLERANCE_SHARE))).cast("long")


def compatible_pairs(videos: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """(video_id, broadcast_id) of videos(video_id, duration_ms) and broadcasts(broadcast_id, duration_ms) of like length.

    A broadcast lies in one bin of twice the greatest tolerance, a video's tolerance reaches into two at most.
    """
    width = 2 * TOLERANCE_MS[1]
    filed = lambda c: F.floor(c / width)
    tolerance = duration_tolerance(F.col("duration_ms"))
    left = videos.select("video_id", F.col("duration_ms").alias("v_ms"), tolerance.alias("tolerance"))
    left = left.withColumn("bin", F.explode(F.sequence(filed(F.col("v_ms") - F.col("tolerance")), filed(F.col("v_ms") + F.col("tolerance")))))
    right = broadcasts.select("broadcast_id", F.col("duration_ms").alias("b_ms"), filed(F.col("duration_ms")).alias("bin"))
    return left.join(right, "bin").where(F.abs(F.col("v_ms") - F.col("b_ms")) <= F.col("tolerance")).select("video_id", "broadcast_id")


def match_offsets(anchors: DataFrame, samples: DataFrame, pairs: DataFrame, offsets_ms: list[int] | None = None) -> DataFrame:
    """For each pair and offset: n_anchors, n_evaluated, n_matched, n_thirds, median_distance, p90_distance.

    anchors(video_id, anchor, ts_ms, dhash, blockhash, mean_luma, duration_ms), samples(broadcast_id, ts_ms, dhash,
    blockhash, mean_luma). Of the samples near an anchor an accepted one comes before any other, then the nearest in bits.
    An offset at which nothing could be compared has a row of zeros; null distances where nothing is accepted.
    """
    offsets_ms = list(range(-OFFSET_MS, OFFSET_MS + 1, OFFSET_STEP_MS)) if offsets_ms is None else offsets_ms
    width = 2 * SAMPLE_MS
    filed = lambda c: F.floor(c / width)
    third = F.least(F.lit(2), F.floor(F.col("ts_ms") / F.col("duration_ms") * 3)).cast("int")
    own = anchors.select("video_id", "anchor", third.alias("third"), F.col("ts_ms").alias("a_ms"), F.col("dhash").alias("a_d"), F.col("blockhash").alias("a_b"), F.col("mean_luma").alias("a_l"))
    grid = pairs.join(own, "video_id").withColumn("offset_ms", F.explode(F.array(*map(F.lit, offsets_ms))))
    key = ["video_id", "broadcast_id", "offset_ms"]
    wanted = grid.withColumn("at", F.col("a_ms") + F.col("offset_ms")).withColumn("bin", F.explode(F.sequence(filed(F.col("at") - SAMPLE_MS), filed(F.col("at") + SAMPLE_MS))))
    near = wanted.join(samples.withColumn("bin", filed(F.col("ts_ms"))), ["broadcast_id", "bin"]).where(F.abs(F.col("ts_ms") - F.col("at")) <= SAMPLE_MS)
    d, b = N.hamming64(F.col("a_d"), F.col("dhash")), N.hamming64(F.col("a_b"), F.col("blockhash"))
    refused = ~((d <= DHASH_BITS) & (b <= BLOCK_BITS) & (d + b <= BOTH_BITS) & (F.abs(F.col("a_l") - F.col("mean_luma")) <= LUMA))
    best = near.groupBy(*key, "anchor").agg(F.min(F.struct(refused.alias("refused"), (d + b).alias("distance"))).alias("best"), F.min("third").alias("third"))
    matched = lambda c: F.when(~F.col("best.refused"), c)
    distances = F.sort_array(F.collect_list(matched(F.col("best.distance"))))
    found = best.groupBy(*key).agg(F.count("*").alias("n_evaluated"), F.count_if(~F.col("best.refused")).alias("n_matched"), F.count_distinct(matched(F.col("third"))).alias("n_thirds"), F.percentile(matched(F.col("best.distance")), 0.5).alias("median_distance"), distances.alias("_d"))
    found = found.withColumn("p90_distance", F.get("_d", (F.ceil(F.col("n_matched") * 0.9) - 1).cast("int"))).drop("_d")
    every = grid.groupBy(*key).agg(F.count("*").alias("n_anchors"))
    return every.join(found, key, "left").na.fill(0, ["n_evaluated", "n_matched", "n_thirds"])


def decide(summary: DataFrame, samples: DataFrame) -> DataFrame:
    """The best offset of each video and broadcast, whether it agrees, and why not: summary of ``match_offsets``."""
    order = W.partitionBy("video_id", "broadcast_id").orderBy(F.desc("n_matched"), F.desc("n_thirds"), F.asc_nulls_last("median_distance"), F.abs(F.col("offset_ms")), "offset_ms")
    best = summary.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    best = best.join(samples.groupBy("broadcast_id").agg(F.count("*").alias("n_samples")), "broadcast_id", "left")
    needed = F.greatest(F.lit(LEAST_ANCHORS), F.ceil(F.col("n_anchors") * ANCHOR_SHARE))
    few = F.coalesce(F.col("n_samples"), F.lit(0)) < LEAST_ANCHORS
    near = F.coalesce((F.col("median_distance") <= MEDIAN_BITS) & (F.col("p90_distance") <= P90_BITS), F.lit(False))
    reason = (
        F.when(few | (F.col("n_evaluated") < needed), "insufficient-local-samples").when(F.col("n_matched") < needed, "anchor-consensus-failed")
        .when(F.col("n_thirds") < 3, "insufficient-temporal-coverage").when(~near, "anchor-consensus-failed").otherwise("multi-anchor-consensus")
    )
    # with too few samples nothing is compared at all
    out = best.withColumn("reason", reason).withColumn("matched", F.col("reason") == "multi-anchor-consensus")
    counts = [F.when(few, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in ("n_evaluated", "n_matched", "n_thirds")]
    rest = [F.when(~few, F.col(c)).alias(c) for c in ("offset_ms", "median_distance", "p90_distance")]
    return out.select("video_id", "broadcast_id", "matched", "reason", *counts, *rest)


def unique_match(broadcasts: DataFrame, decisions: DataFrame) -> DataFrame:
    """For each broadcast: verified if one video agrees, ambiguous if several do, else none. ``decisions`` must be those
    at offset zero, as what has to be shifted is no proof among several."""
    per = decisions.where("matched").groupBy("broadcast_id").agg(F.count("*").alias("n_videos"), F.max("video_id").alias("_v"))
    per = broadcasts.select("broadcast_id").join(per, "broadcast_id", "left").na.fill(0, ["n_videos"])
    status = F.when(F.col("n_videos") == 1, "verified").when(F.col("n_videos") > 1, "ambiguous").otherwise("none")
    return per.select("broadcast_id", "n_videos", status.alias("status"), F.when(F.col("n_videos") == 1, F.col("_v")).alias("video_id"))
