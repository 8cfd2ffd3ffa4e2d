"""Joins and algebra of half-open intervals (start_ms, end_ms) within a key.

Overlap joins are equi-joins on key and time bin: each side is filed under the bins it touches, and a pair is kept in
the first bin that both have, so that nothing has to be de-duplicated and no two sides of a key are crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN_MS = 60_000


def _filed(df: DataFrame, start: Column, end: Column, bin_ms: int) -> DataFrame:
    """df under each bin that start..end (inclusive) touches, with its first bin."""
    first, last = F.floor(start / bin_ms), F.floor(end / bin_ms)
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", condition: Column | None = None, reach_ms: int = 0, bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs of the same key whose intervals overlap, or meet ``condition`` within reach_ms of each other.

    left has start_ms and end_ms; right has r_start and r_end. how: inner, left_semi or left_anti.
    """
    lhs = _filed(left, F.col("start_ms") - reach_ms, F.col("end_ms") + reach_ms, bin_ms)
    rhs = _filed(right.withColumnsRenamed({k: f"_r_{k}" for k in keys}), F.col("r_start"), F.col("r_end"), bin_ms).withColumnsRenamed({"_first": "_r_first", "_bin": "_r_bin"})
    met = condition if condition is not None else F.greatest("start_ms", "r_start") < F.least("end_ms", "r_end")
    on = met & (F.col("_bin") == F.col("_r_bin"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if how != "inner":
        unique = [c for c in left.columns]
        hit = lhs.join(rhs, on, "left_semi").select(*unique).distinct()
        return hit if how == "left_semi" else left.join(hit, unique, "left_anti")
    drop = ["_first", "_bin", "_r_first", "_r_bin", *(f"_r_{k}" for k in keys)]
    return lhs.join(rhs, on & (F.col("_bin") == F.greatest("_first", "_r_first"))).drop(*drop)


def islands(df: DataFrame, keys: list[str], gap_ms: int = 0) -> DataFrame:
    """Intervals with the number of their island: those that overlap or touch (gap up to gap_ms) share one."""
    order = W.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(F.col("start_ms") > reach + gap_ms, 1).otherwise(0)).withColumn("island", F.sum("_new").over(order)).drop("_new")


def merge(df: DataFrame, keys: list[str], kind: str | None = None) -> DataFrame:
    """Union of intervals, touching ones merged, with the set of their kinds."""
    aggs = [F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_merged")]
    aggs += [F.sort_array(F.collect_set(kind)).alias("kinds")] if kind else []
    return islands(df, keys).groupBy(*keys, "island").agg(*aggs).drop("island")


def covered_ms(df: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of intervals."""
    return merge(df, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))


def subtract(planned: DataFrame, covered: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Parts of the planned intervals (each named by ident) that no covered interval holds."""
    cover = merge(covered, keys).withColumnsRenamed({"start_ms": "r_start", "end_ms": "r_end"})
    hit = overlap_join(planned, cover, keys).select(*keys, ident, "start_ms", "end_ms", F.greatest("start_ms", "r_start").alias("a"), F.least("end_ms", "r_end").alias("b"))
    ends = planned.select(*keys, ident, "start_ms", "end_ms", F.col("start_ms").alias("a"), F.col("start_ms").alias("b"))
    order = W.partitionBy(*keys, ident, "start_ms", "end_ms").orderBy("a", "b")
    gaps = hit.unionByName(ends).withColumn("next", F.coalesce(F.lead("a").over(order), F.col("end_ms")))
    return gaps.where("next > b").select(*keys, ident, F.col("b").alias("start_ms"), F.col("next").alias("end_ms"))


def coverage(chapters: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """Covered length, share, number of holes and status of each source."""
    parts = merge(chapters, keys)
    order = W.partitionBy(*keys).orderBy("start_ms")
    holes = parts.withColumn("_hole", (F.col("start_ms") > F.coalesce(F.lag("end_ms").over(order), F.lit(0))).cast("int"))
    per = holes.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.sum("_hole").alias("holes"), F.max("end_ms").alias("last"))
    out = durations.join(per, keys, "left").fillna(0, ["covered_ms", "holes", "last"])
    n = F.col("holes") + (F.col("last") < F.col("duration_ms")).cast("int")
    share = F.col("covered_ms") / F.col("duration_ms")
    status = F.when(F.col("covered_ms") == 0, "none").when(n == 0, "complete").otherwise("partial")
    return out.select(*keys, "covered_ms", share.alias("share"), n.cast("long").alias("n_gaps"), status.alias("status"))


def nearest(points: DataFrame, chapters: DataFrame, key: str, at: str = "at_ms", forward: bool = False) -> DataFrame:
    """As-of join: for each point the last chapter that ends by it, or the first that starts at it or later."""
    time = "start_ms" if forward else "end_ms"
    own = points.select(key, F.col(at).alias("_t"), F.lit(0 if forward else 1).alias("_side"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(chapters.select(F.struct(*chapters.columns)).schema[0].dataType).alias("_c"))
    other = chapters.select(key, F.col(time).alias("_t"), F.lit(1 if forward else 0).alias("_side"), F.lit(None).cast(own.schema["_p"].dataType).alias("_p"), F.struct(*chapters.columns).alias("_c"))
    order = W.partitionBy(key).orderBy(F.desc("_t") if forward else F.asc("_t"), F.desc("_side") if forward else F.asc("_side")).rowsBetween(W.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("chapter", F.last("_c", ignorenulls=True).over(order))
    return both.where("_p is not null").select("_p.*", "chapter")


def best_overlap(ranges: DataFrame, chapters: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """For each range the chapter (r_start, r_end, r_id) that overlaps it most, the earliest of equals."""
    hit = overlap_join(ranges, chapters, keys).withColumn("overlap_ms", F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start"))
    order = W.partitionBy(*keys, ident).orderBy(F.desc("overlap_ms"), "r_start", "r_id")
    return hit.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def text_in_range(ranges: DataFrame, cues: DataFrame, keys: list[str], ident: str, inclusive: bool = True, most: int = 4000) -> DataFrame:
    """Texts of the cues (r_start, r_end, r_id, text) in each range, in order, joined and cut.

    inclusive: a cue that ends exactly at the start of the range still counts.
    """
    met = (F.col("r_start") < F.col("end_ms")) & ((F.col("r_end") >= F.col("start_ms")) if inclusive else (F.col("r_end") > F.col("start_ms")))
    hit = overlap_join(ranges, cues, keys, condition=met, reach_ms=1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("r_start", "r_id", "text"))), lambda c: c["text"])
    return hit.groupBy(*keys, ident).agg(F.left(F.array_join(texts, " "), F.lit(most)).alias("text"), F.count("*").alias("n_cues"))


def containing(points: DataFrame, chapters: DataFrame, keys: list[str], at: str = "at_ms") -> DataFrame:
    """Each point with the chapter (r_start, r_end, ...) that holds it."""
    spots = points.withColumn("start_ms", F.col(at)).withColumn("end_ms", F.col(at))
    return overlap_join(spots, chapters, keys, condition=(F.col(at) >= F.col("r_start")) & (F.col(at) < F.col("r_end"))).drop("start_ms", "end_ms")


def overlap_violations(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Intervals that begin before an earlier one has ended; of equal intervals that with the least ident is the earliest."""
    order = W.partitionBy(*keys).orderBy("start_ms", "end_ms", ident)
    return df.withColumn("_reach", F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))).where("start_ms < _reach").drop("_reach")


def cells(durations: DataFrame, step_ms: int) -> DataFrame:
    """Cells of step_ms over each source; the last one ends with it."""
    n = F.ceil(F.col("duration_ms") / step_ms).cast("int")
    out = durations.where("duration_ms > 0").select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("cell"))
    return out.withColumn("start_ms", F.col("cell").cast("long") * step_ms).withColumn("end_ms", F.least(F.col("duration_ms"), (F.col("cell").cast("long") + 1) * step_ms).cast("long"))
