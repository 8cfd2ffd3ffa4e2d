"""Voices: prototypes, scores against them, open-set decisions, consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N

#: Prototypes that are broadcast at once; more are broadcast block by block.
MOST_PROTOTYPES = 10_000


def prototypes(samples: DataFrame) -> DataFrame:
    """Mean of the unit vectors of each label, as a unit vector: samples(label, embedding)."""
    unit = samples.withColumn("_n", N.norm(F.col("embedding"))).where("_n > 0")
    long = unit.select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / F.col("_n"))).alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg("x").alias("x"))
    vector = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return vector.withColumn("_n", N.norm(F.col("v"))).select("label", F.transform("v", lambda x: x / F.col("_n")).alias("prototype"))


def score(queries: DataFrame, protos: DataFrame) -> DataFrame:
    """Cosine of each query(id, embedding) with each prototype, 0 at least: a row for each of both, in blocks of
    prototypes that are each broadcast."""
    blocks = max(1, -(-protos.count() // MOST_PROTOTYPES))
    sides = [protos.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k) if blocks > 1 else protos for k in range(blocks)]
    return reduce(DataFrame.unionByName, (queries.crossJoin(F.broadcast(side)).select("id", "label", N.cosine(F.col("embedding"), F.col("prototype")).alias("score")) for side in sides))


def speech_cells(logits: DataFrame, frame_ms: int = 1000) -> DataFrame:
    """Softmax of each frame's logits, its winner, and by cell the length and confidence of each class:
    logits(cell, frame, logits)."""
    p = logits.withColumn("p", N.softmax(F.col("logits")))
    won = p.withColumn("confidence", F.array_max("p")).withColumn("winner", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return won.groupBy("cell", "winner").agg((F.count("*") * frame_ms).alias("duration_ms"), F.min("confidence").alias("least_confidence"), F.avg("confidence").alias("mean_confidence"))
