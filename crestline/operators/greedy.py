"""Greedy choices over ordered intervals in each group, as array folds.

A choice depends on others only where they can clash, so a group is cut at the gaps that no interval crosses, and each
part is gathered in order and folded alone: time and memory go with the longest part, not with the group. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame, keys: list[str], low: Column, high: Column, touch: bool = False) -> DataFrame:
    """df with ``_part``, the number of its part in time: rows of two parts have no moment of low..high in common.

    The ends belong to the intervals if ``touch``. An interval without a low has no beginning, one without a high no end.
    """
    low, high = F.coalesce(low, -F.lit(2**62)), F.coalesce(high, F.lit(2**62))
    order = W.partitionBy(*keys).orderBy("_low")
    df = df.withColumn("_low", low).withColumn("_reach", F.max(high).over(order.rowsBetween(W.unboundedPreceding, -1)))
    new = (F.col("_low") > F.col("_reach")) if touch else (F.col("_low") >= F.col("_reach"))
    df = df.withColumn("_part", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return df.drop("_low", "_reach")


def keep_where(df: DataFrame, keys: list[str], order: list[Column], most: int | None, clashes, fields: list[str], hull: tuple[Column, Column] | None = None, touch: bool = False) -> DataFrame:
    """Rows taken in order unless clashes(taken, row) holds for a row already taken; at most ``most`` in a group, if given.

    Rows clash only if their ``hull``s (from, to) overlap, or touch; without a hull a group is one part. The result has
    the column ``pick``, from 1 in the order taken. clashes may read ``fields`` only.
    """
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    parted = cut(ranked, keys, *hull, touch) if hull else ranked.withColumn("_part", F.lit(0).cast("long"))
    # a part's rows travel whole, so that the input is computed once and nothing is joined back
    item = F.struct("_n", *fields, F.struct(*(F.col(c) for c in df.columns)).alias("_row"))
    lists = parted.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(item), lambda a, b: a["_n"] - b["_n"]).alias("_items"))
    empty = F.slice("_items", 1, 0)
    # the first rows of a group are the first of its parts, so no part needs more than ``most``
    taken = F.aggregate(
        "_items", empty, lambda acc, x: F.when((F.lit(False) if most is None else F.size(acc) >= most) | F.exists(acc, lambda a: clashes(a, x)), acc).otherwise(F.concat(acc, F.array(x)))
    )
    chosen = lists.select(*keys, F.explode(taken).alias("_x")).withColumn("_n", F.col("_x._n"))
    picked = chosen.withColumn("pick", F.row_number().over(W.partitionBy(*keys).orderBy("_n")))
    picked = picked if most is None else picked.where(F.col("pick") <= most)
    return picked.select("_x._row.*", "pick")


def keep_disjoint(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """Rows in order that overlap none taken before (start_ms, end_ms)."""
    clash = lambda a, x: F.greatest(a["start_ms"], x["start_ms"]) < F.least(a["end_ms"], x["end_ms"])
    return keep_where(df, keys, order, most, clash, ["start_ms", "end_ms"], (F.col("start_ms"), F.col("end_ms")))


def suppress(df: DataFrame, keys: list[str], order: list[Column], most: int = 96, threshold: float = 0.5) -> DataFrame:
    """Non-maximum suppression: rows that overlap a better one by threshold of the shorter length go."""

    def clash(a: Column, x: Column) -> Column:
        over = F.least(a["end_ms"], x["end_ms"]) - F.greatest(a["start_ms"], x["start_ms"])
        shorter = F.least(a["end_ms"] - a["start_ms"], x["end_ms"] - x["start_ms"])
        return (over > 0) & (over >= threshold * shorter)

    return keep_where(df, keys, order, most, clash, ["start_ms", "end_ms"], (F.col("start_ms"), F.col("end_ms")))


def keep_spaced(df: DataFrame, keys: list[str], order: list[Column], most: int, gap_ms: int, at: str = "ts_ms") -> DataFrame:
    """Rows in order that are gap_ms or more away from all taken before; a row without a time is near to none."""
    here = F.coalesce(F.col(at), F.lit(0))
    return keep_where(df, keys, order, most, lambda a, x: F.abs(a[at] - x[at]) < gap_ms, [at], (here, here + gap_ms))


def match_pairs(pairs: DataFrame, keys: list[str], order: list[Column], left: str, right: str, at: tuple[str, str] | None = None) -> DataFrame:
    """One-to-one matching: pairs in order, each side used once. at: the columns of both sides' times, by which to cut."""
    hull = (F.least(*at), F.greatest(*at)) if at else None
    return keep_where(pairs, keys, order, None, lambda a, x: (a[left] == x[left]) | (a[right] == x[right]), [left, right], hull, touch=True)
