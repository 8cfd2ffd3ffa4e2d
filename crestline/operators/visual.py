"""Pictures: changes between sampled frames, scene peaks, descriptors, fingerprints and their matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import numbers as N
from .greedy import keep_disjoint, keep_spaced

#: Length of a highlight, and the change of luma that counts for a pixel.
WINDOW_MS, PIXEL_CHANGE = 45_000, 28


def scene_changes(frames: DataFrame) -> DataFrame:
    """Each frame against the one before: mean luma difference, share of changed pixels and their 0.65 : 0.35 mix."""
    w = W.partitionBy("broadcast_id").orderBy("ts_ms")
    df = frames.withColumn("_p", F.lag("luma").over(w)).withColumn("previous_ms", F.lag("ts_ms").over(w)).where("_p is not null")
    df = df.withColumn("_d", F.zip_with("luma", "_p", lambda a, b: F.abs(a - b)))
    mean = F.aggregate("_d", F.lit(0), lambda s, x: s + x) / (F.size("_d") * 255)
    changed = F.size(F.filter("_d", lambda x: x >= PIXEL_CHANGE)) / F.size("_d")
    df = df.withColumn("mean_change", mean).withColumn("changed_share", changed)
    return df.withColumn("strength", F.col("mean_change") * 0.65 + F.col("changed_share") * 0.35).drop("_p", "_d", "luma")


def score_scenes(changes: DataFrame) -> DataFrame:
    """Strength against the broadcast's median and MAD; eligible above max(0.08, base + max(3 scales, 0.04))."""
    base = changes.groupBy("broadcast_id").agg(F.percentile("strength", 0.5).alias("base"), F.count("*").alias("_n"))
    df = changes.join(base, "broadcast_id")
    mad = df.groupBy("broadcast_id").agg(F.percentile(F.abs(F.col("strength") - F.col("base")), 0.5).alias("mad"))
    df = df.join(mad, "broadcast_id").withColumn("scale", F.greatest(F.lit(0.01), 1.4826 * F.col("mad")))
    enough = F.col("_n") >= 4
    limit = F.when(enough, F.greatest(F.lit(0.08), F.col("base") + F.greatest(3 * F.col("scale"), F.lit(0.04)))).otherwise(0.08)
    df = df.withColumn("robust", (F.col("strength") - F.col("base")) / F.col("scale"))
    eligible = (F.col("strength") > limit) & (F.col("mean_change") >= 0.04) & (F.col("changed_share") >= 0.08) & (~enough | (F.col("robust") >= 3))
    return df.withColumn("eligible", eligible).drop("_n", "scale")


def scene_highlights(frames: DataFrame, durations: DataFrame, most: int = 12) -> DataFrame:
    w = W.partitionBy("broadcast_id").orderBy("ts_ms")
    scored = score_scenes(scene_changes(frames)).join(durations, "broadcast_id")
    around = scored.withColumn("_b", F.coalesce(F.lag("strength").over(w), F.lit(-1.0))).withColumn("_a", F.coalesce(F.lead("strength").over(w), F.lit(-1.0)))
    peaks = around.where(F.col("eligible") & (F.col("strength") > F.col("_b")) & (F.col("strength") >= F.col("_a")))
    peak = N.round_half_up((F.col("previous_ms") + F.col("ts_ms")) / 2).cast("long")
    width = F.least(F.lit(WINDOW_MS), F.col("duration_ms"))
    start = N.clamp(peak - N.round_half_up(width * 4 / 9).cast("long"), 0, F.greatest(F.lit(0), F.col("duration_ms") - width))
    score = N.round_half_up(N.clamp(F.col("robust"), 0.0, 20.0) + F.col("strength"), 6)
    placed = peaks.select("broadcast_id", peak.alias("peak_ms"), start.cast("long").alias("start_ms"), (start + width).cast("long").alias("end_ms"), score.alias("score"), "robust")
    return keep_disjoint(placed, ["broadcast_id"], [F.desc("score"), F.asc("peak_ms")], most).drop("robust")


_DESCRIPTOR = StructType([StructField("dhash", LongType()), StructField("blockhash", LongType()), StructField("mean_luma", IntegerType()), StructField("edge", IntegerType())])


@F.pandas_udf(_DESCRIPTOR)
def frame_descriptor(lumas: pd.Series) -> pd.DataFrame:
    """Difference hash, block hash, mean luma and edge energy of square planes.

    The plane is averaged to eight by nine for the row-wise difference hash and eight by eight for the block hash,
    whose bits say whether a block is above the median of all.
    """
    rows = []
    for luma in lumas:
        side = int(len(luma) ** 0.5)
        plane = np.asarray(luma, dtype=float).reshape(side, side)
        blocks, wide = _resize(plane, 8, 8), _resize(plane, 8, 9)
        pack = lambda bits: int(np.packbits(bits.ravel()).view(">u8")[0].astype(np.int64))
        edge = (np.abs(np.diff(plane, axis=0)).mean() + np.abs(np.diff(plane, axis=1)).mean()) / 2
        rows.append((pack(wide[:, 1:] > wide[:, :-1]), pack(blocks > np.median(blocks)), int(np.floor(plane.mean() + 0.5)), int(np.floor(edge + 0.5))))
    return pd.DataFrame(rows, columns=["dhash", "blockhash", "mean_luma", "edge"])


def _resize(plane: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Box averages, rounded: each output cell is the mean of all input cells that it touches."""

    def cover(n: int, m: int) -> np.ndarray:
        k = np.arange(m)[:, None]
        low = k * n // m
        high = np.maximum(low + 1, -(-(k + 1) * n // m))
        return ((np.arange(n) >= low) & (np.arange(n) < high)).astype(float)

    tall, wide = cover(plane.shape[0], rows), cover(plane.shape[1], cols)
    return np.floor(tall @ plane @ wide.T / (tall.sum(axis=1)[:, None] * wide.sum(axis=1)) + 0.5)


def describe(frames: DataFrame) -> DataFrame:
    return frames.withColumn("d", frame_descriptor("luma")).select("broadcast_id", "ts_ms", "d.*")


def visual_seeds(descriptors: DataFrame, most: int = 4, gap_ms: int = 60_000, least: float = 0.14) -> DataFrame:
    """Strongest changes between frames, above the 90 percent rank of the broadcast and at least a minute apart."""
    w = W.partitionBy("broadcast_id").orderBy("ts_ms")
    lagged = descriptors
    for c in ("dhash", "blockhash", "mean_luma", "edge"):
        lagged = lagged.withColumn(f"_{c}", F.lag(c).over(w))
    bits = N.hamming64(F.col("dhash"), F.col("_dhash")) + N.hamming64(F.col("blockhash"), F.col("_blockhash"))
    change = N.round_half_up(bits / 128 * 0.8 + F.abs(F.col("mean_luma") - F.col("_mean_luma")) / 255 * 0.12 + F.abs(F.col("edge") - F.col("_edge")) / 255 * 0.08, 6)
    changes = lagged.where("_dhash is not null").select("broadcast_id", "ts_ms", change.alias("change"))
    whole = W.partitionBy("broadcast_id")
    ranked = changes.withColumn("_r", F.row_number().over(whole.orderBy("change")) - 1).withColumn("_n", F.count("*").over(whole))
    limit = F.max(F.when(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.9)), F.col("change"))).over(whole)
    strong = ranked.withColumn("_limit", F.greatest(F.lit(least), limit)).where("change >= _limit").drop("_r", "_n", "_limit")
    return keep_spaced(strong, ["broadcast_id"], [F.desc("change"), F.asc("ts_ms")], most, gap_ms)


def sample_times(durations: DataFrame, target_ms: int = 5000, most: int = 720) -> DataFrame:
    """Sampling instants of a source: about every five seconds, 720 at most, a little off both edges."""
    d = durations.withColumn("pad", F.least(F.lit(250), F.floor(F.col("duration_ms") / 4))).withColumn("last", F.greatest(F.lit(0), F.col("duration_ms") - 1))
    d = d.withColumn("a", F.least("last", "pad")).withColumn("b", F.greatest(F.col("a"), F.col("last") - F.col("pad"))).withColumn("span", F.col("b") - F.col("a"))
    d = d.withColumn("n", F.when(F.col("span") == 0, 1).otherwise(F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.col("span") / target_ms) + 1))).cast("int"))
    at = lambda i: N.round_half_up(F.col("a") + F.when(F.col("n") == 1, 0.0).otherwise(F.col("span") * i / (F.col("n") - 1))).cast("long")
    return d.select("broadcast_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - 1), at))).alias("ts_ms"))
