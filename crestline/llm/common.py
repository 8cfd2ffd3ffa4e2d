"""Helpers shared by the corpus operators: shared storage, table access, connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, stored

__all__ = ["code_points", "connected_components", "shared_dir", "stored", "table", "texts_as_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null reads as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.fill_null("").cast(pa.large_binary()).to_pylist()


def code_points(text: bytes, spans: list[tuple]) -> list[tuple]:
    """Spans (start, end, ...) of bytes as spans of code points, in one pass over the text."""
    if not spans or text.isascii():
        return spans
    place, at, points = {}, 0, 0
    for offset in sorted({o for span in spans for o in span[:2]}):
        points += len(text[at:offset].decode())
        place[offset] = points
        at = offset
    return [(place[a], place[b], *rest) for a, b, *rest in spans]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds; each round is two aggregations by node, cut by a checkpoint.
    Neighbourhoods are never gathered: each side only needs the minimum of its neighbours, joined back by node.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())
    before = state_of(pairs)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, is linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
            .checkpoint()
        )
        # a forest of stars: no node is both a child and a root, and no child has two roots
        state, pairs = state_of(small), small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
