"""Leads of a broadcast: round-robin merge, slices by topic, refinement picks and plans, scattered and sampled orders.

Each pick changes the next ones, so that the bounded list of a broadcast is folded in one row or worked in one group.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from .greedy import keep_where
from .grouped import pick_rows
from .intervals import cells, merge, overlap_join

#: Where scattered picks begin, leads and topics and refined leads at most, leads of a plan and length of its cells.
GOLDEN = 0.6180339887498948
MERGED, TOPICS, REFINED = 32, 4, 20
PLAN_LEADS, CELL_MS = 4, 60_000


def merge_leads(leads: DataFrame, most: int = MERGED) -> DataFrame:
    """Leads(broadcast_id, group, lead, start_ms, end_ms, confidence, cue) of several groups, by turns: the best of each
    group first. One that has the cue of a lead taken, or its range in like size by 0.8, goes."""
    rank = F.row_number().over(W.partitionBy("broadcast_id", "group").orderBy(F.desc("confidence"), "start_ms", "lead"))
    ranked = leads.withColumn("_rank", rank).withColumn("_cue", F.trim("cue"))

    def clash(a, x):
        over = F.greatest(F.lit(0), F.least(a["end_ms"], x["end_ms"]) - F.greatest(a["start_ms"], x["start_ms"]))
        one, two = a["end_ms"] - a["start_ms"], x["end_ms"] - x["start_ms"]
        shorter, longer = F.least(one, two), F.greatest(one, two)
        return (a["_cue"] == x["_cue"]) | ((shorter > 0) & (shorter >= 0.5 * longer) & (over >= 0.8 * shorter))

    kept = keep_where(ranked, ["broadcast_id"], [F.asc("_rank"), F.asc("group")], most, clash, ["start_ms", "end_ms", "_cue"])
    return kept.drop("_rank", "_cue")


def topic_slices(chapters: DataFrame, topics: DataFrame, most: int = TOPICS) -> DataFrame:
    """Chapters(broadcast_id, n, start_ms, end_ms) of the best topics(broadcast_id, topic, start_ms, end_ms, kind, primary);
    a broadcast without topics is cut into as many even slices."""
    sound = topics.where("kind <> 'context-shift' and end_ms > start_ms")
    best = W.partitionBy("broadcast_id").orderBy(F.desc("primary"), F.desc(F.col("end_ms") - F.col("start_ms")), "start_ms", "topic")
    chosen = sound.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    chosen = chosen.withColumn("slice", F.row_number().over(W.partitionBy("broadcast_id").orderBy("start_ms", "topic")))
    right = chosen.select("broadcast_id", "slice", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    by_topic = overlap_join(chapters, right, ["broadcast_id"]).select("broadcast_id", "n", "slice", F.lit("topic").alias("basis"))
    rest = chapters.join(chosen.select("broadcast_id").distinct(), "broadcast_id", "left_anti")
    w = W.partitionBy("broadcast_id")
    at, size = F.row_number().over(w.orderBy("n")) - 1, F.count("*").over(w)
    even = rest.withColumn("slice", (F.floor(((at + 1) * F.least(F.lit(most), size) - 1) / size) + 1).cast("int"))
    return by_topic.unionByName(even.select("broadcast_id", "n", "slice", F.lit("coverage").alias("basis")))


def refinement_leads(leads: DataFrame, most: int = REFINED) -> DataFrame:
    """Leads to refine: those that the jury selected or left open, then reserves of the same topics, each time of the topic
    that has had the fewest turns for its size, the lead farthest from those taken. leads(broadcast_id, lead, topic,
    start_ms, end_ms, confidence, decision, verdict_confidence)."""

    def choose(rows: pa.RecordBatch) -> tuple[list[int], dict[str, list]]:
        start, end, trust, verdict = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("start_ms", "end_ms", "confidence", "verdict_confidence"))
        jury = np.flatnonzero(pc.is_in(rows.column("decision"), pa.array(["select", "review"])).to_numpy(zero_copy_only=False))
        # rows come in order of start and lead, which decide last
        first = jury[np.lexsort((-trust[jury], -verdict[jury]))][:most].tolist()
        known = rows.column("topic").is_valid().to_numpy(zero_copy_only=False)
        topic = np.full(len(rows), -1)
        topic[known] = np.unique(rows.column("topic").drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        middle, free = (start + end) / 2, known.copy()
        free[first] = False
        groups = {}
        for k in first:
            groups.setdefault(int(topic[k]), []).append(k)
        size, turns = {t: len(g) for t, g in groups.items()}, dict.fromkeys(groups, 0)
        left = {t: np.flatnonzero(free & (topic == t)) for t in groups}
        # how far each of them is from the nearest lead taken of its topic
        far = {t: np.abs(middle[left[t]][:, None] - middle[g][None, :]).min(axis=1) for t, g in groups.items()}
        picks = list(first)
        room = min(most, max(6, 5 * len(first))) if first else 0
        while len(picks) < room:
            open_ = [t for t in groups if len(left[t])]
            if not open_:
                break
            t = min(open_, key=lambda t: (turns[t] * size[t], size[t], t))
            best = int(np.lexsort((-trust[left[t]], -far[t]))[0])
            k = int(left[t][best])
            left[t], near = np.delete(left[t], best), np.delete(far[t], best)
            far[t] = np.minimum(near, np.abs(middle[left[t]] - middle[k]))
            turns[t] += 1
            picks.append(k)
        return picks, {"pick": list(range(1, len(picks) + 1))}

    return pick_rows(leads, "broadcast_id", [F.asc_nulls_last("start_ms"), F.asc_nulls_last("lead")], ["broadcast_id", "lead"], choose, {"pick": pa.int32()})


def farthest_first(at: list[int], rank: list[int], focus: float) -> list[int]:
    """Positions in the sorted list ``at``: the one nearest to focus, then each time the one farthest from all taken.

    Of equally far ones that with the least rank comes first. Each pick halves one gap between picks, and a heap holds the
    best point of each gap, so that n points take n log n steps.
    """
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(low: int, high: int) -> None:
        """The best point strictly between the picks low and high; -1 and len(at) are the open ends."""
        if high - low < 2:
            return
        inner = range(low + 1, high)
        if low < 0:
            ends = [low + 1]
        elif high == len(at):
            ends = [bisect_left(at, at[high - 1], low + 1, high)]
        else:
            # the first point that is no nearer to the left pick than to the right one, and the one before it
            turn = bisect_left(inner, True, key=lambda k: at[k] - at[low] >= at[high] - at[k])
            ends = [inner[k] for k in (turn, turn - 1) if 0 <= k < len(inner)]
            ends = [bisect_left(at, at[k], low + 1, high) for k in ends]
        away = lambda k: min(at[k] - at[low] if low >= 0 else at[-1] - at[0], at[high] - at[k] if high < len(at) else at[-1] - at[0])
        best = min(ends, key=lambda k: (-away(k), rank[k]))
        heappush(heap, (-away(best), rank[best], best, low, high))

    first = min(range(len(at)), key=lambda k: (abs(at[k] - focus), rank[k]))
    picks = [first]
    offer(-1, first)
    offer(first, len(at))
    while heap:
        _, _, best, low, high = heappop(heap)
        picks.append(best)
        offer(low, best)
        offer(best, high)
    return picks


def scattered_order(chunks: DataFrame) -> DataFrame:
    """Order of the chunks(broadcast_id, n, start_ms, end_ms) of a broadcast that spreads early picks: the one nearest to
    the golden section first, then each time the one farthest from all taken."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "end_ms", "n"]).reset_index(drop=True)
        first, last = pdf["start_ms"].iloc[0], pdf["end_ms"].iloc[-1]
        # twice the centers, so that all distances are whole; of equal centers the earlier chunk comes first
        center = (pdf["start_ms"] + pdf["end_ms"] - 2 * first).to_numpy(np.int64)
        place = np.lexsort((np.arange(len(pdf)), center))
        picks = [int(place[k]) for k in farthest_first(center[place].tolist(), place.tolist(), 2 * GOLDEN * max(1, last - first))]
        out = pdf.loc[picks, ["broadcast_id", "n"]].copy()
        out["pick"] = np.arange(1, len(picks) + 1)
        return out

    key, n = (chunks.schema[c].dataType.simpleString() for c in ("broadcast_id", "n"))
    return chunks.select("broadcast_id", "n", "start_ms", "end_ms").groupBy("broadcast_id").applyInPandas(order, f"broadcast_id {key}, n {n}, pick int")


def prioritize_neighbours(pending: DataFrame, current: DataFrame, most: int = 2) -> DataFrame:
    """Pending chunks(broadcast_id, n, place) anew after current(broadcast_id, current): its nearest pending neighbours
    come first, after the first of them one from the whole, so that breadth is kept."""
    at = pending.join(current, "broadcast_id").where("n <> current")
    later = F.when(F.col("current") % 2 == 0, -F.col("n")).otherwise(F.col("n"))
    near = at.withColumn("_k", F.row_number().over(W.partitionBy("broadcast_id").orderBy(F.abs(F.col("n") - F.col("current")), later))).where(F.col("_k") <= most).select("broadcast_id", "n", "_k")
    both = pending.join(near, ["broadcast_id", "n"], "left")
    w = W.partitionBy("broadcast_id")
    both = both.withColumn("_g", F.when(F.col("_k").isNull(), F.row_number().over(W.partitionBy("broadcast_id", F.col("_k").isNull()).orderBy("place"))))
    # neighbours are 1, 3, 4 ...; of the others the first is 2, if there are two neighbours, and the rest follows
    key = F.when(F.col("_k").isNotNull(), F.when(F.col("_k") == 1, F.lit(1)).otherwise(F.col("_k") + 1)).when((F.col("_g") == 1) & (F.count("_k").over(w) > 1), F.lit(2)).otherwise(F.lit(1 << 20) + F.col("_g"))
    return both.withColumn("pick", F.row_number().over(w.orderBy(key))).drop("_k", "_g")


def refinement_plan(leads: DataFrame, budget_ms: int, most: int = PLAN_LEADS, cell_ms: int = CELL_MS) -> DataFrame:
    """Cells to transcribe of the best leads(broadcast_id, lead, start_ms, end_ms, confidence): each has an even part of the
    budget around its middle, and what a better lead has claimed is not claimed again."""
    sound = leads.where("confidence >= 0.55 and start_ms >= 0 and end_ms > start_ms")
    rank = F.row_number().over(W.partitionBy("broadcast_id").orderBy(F.desc("confidence"), "start_ms", "lead"))
    part = F.floor(budget_ms / F.least(F.lit(most), F.count("*").over(W.partitionBy("broadcast_id")))).cast("long")
    ranked = sound.withColumn("rank", rank).withColumn("_part", part)
    mid = N.round_half_up((F.col("start_ms") + F.col("end_ms")) / 2 - F.col("_part") / 2).cast("long")
    fits = F.col("end_ms") - F.col("start_ms") <= F.col("_part")
    bound = ranked.select("broadcast_id", "lead", "rank", F.when(fits, F.col("start_ms")).otherwise(mid).alias("s"), F.when(fits, F.col("end_ms")).otherwise(mid + F.col("_part")).alias("e"))
    lists = bound.groupBy("broadcast_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lead", "s", "e"))).alias("items"))
    free = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))

    def left(x, taken):
        """Parts of x that no taken range has: between consecutive ends of the taken ranges inside x."""
        inside = F.array_sort(F.transform(F.filter(taken, lambda t: (t["s"] < x["e"]) & (t["e"] > x["s"])), lambda t: F.struct(F.greatest(t["s"], x["s"]).alias("s"), F.least(t["e"], x["e"]).alias("e"))))
        starts = F.concat(F.array(x["s"]), F.transform(inside, lambda t: t["e"]))
        ends = F.concat(F.transform(inside, lambda t: t["s"]), F.array(x["e"]))
        return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), b.alias("e"))), lambda r: r["s"] < r["e"])

    none = F.struct(F.slice(F.array(free), 1, 0).alias("taken"), F.slice(F.transform("items", lambda x: F.struct(x["lead"].alias("lead"), x["s"].alias("s"), x["e"].alias("e"))), 1, 0).alias("plan"), F.lit(0).alias("n"))

    def step(acc, x):
        parts = left(x, acc["taken"])
        took = (acc["n"] < most) & (F.size(parts) > 0)
        return F.struct(
            F.when(took, F.concat(acc["taken"], parts)).otherwise(acc["taken"]).alias("taken"), F.when(took, F.concat(acc["plan"], F.transform(parts, lambda p: F.struct(x["lead"].alias("lead"), p["s"].alias("s"), p["e"].alias("e"))))).otherwise(acc["plan"]).alias("plan"),
            (acc["n"] + took.cast("int")).alias("n"),
        )

    plan = lists.select("broadcast_id", F.explode(F.aggregate("items", none, step, lambda a: a["plan"])).alias("p")).select("broadcast_id", "p.*")
    cut = plan.select("broadcast_id", "lead", "e", F.explode(F.sequence("s", F.col("e") - 1, F.lit(cell_ms).cast("long"))).alias("start_ms"))
    return cut.select("broadcast_id", "lead", "start_ms", F.least("e", F.col("start_ms") + cell_ms).alias("end_ms"))


def sampling_plan(peaks: DataFrame, durations: DataFrame, budget_ms: int, event_ms: int = 120_000, cell_ms: int = 600_000, most: int = 12) -> DataFrame:
    """Ranges to listen to within a budget: two minutes around the first peaks, and the rest of the budget spread over cells
    of ten minutes in one to three samples each; a source that fits the budget is taken whole."""
    rows = durations.withColumn("_whole", F.col("duration_ms") <= budget_ms)
    near = peaks.select("broadcast_id", "peak_ms").distinct().withColumn("_n", F.row_number().over(W.partitionBy("broadcast_id").orderBy("peak_ms"))).where(F.col("_n") <= most)
    events = near.join(rows.where("not _whole"), "broadcast_id").where("peak_ms >= 0 and peak_ms < duration_ms")
    events = events.select("broadcast_id", F.greatest(F.lit(0), F.col("peak_ms") - event_ms // 2).cast("double").alias("start_ms"), F.least("duration_ms", F.col("peak_ms") + event_ms // 2).cast("double").alias("end_ms"), F.lit("event").alias("kind"))
    used = merge(events, ["broadcast_id"]).groupBy("broadcast_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_used"))
    axis = cells(rows.where("not _whole"), cell_ms).join(used, "broadcast_id", "left").withColumn("_cells", F.count("*").over(W.partitionBy("broadcast_id")))
    spent = F.greatest(F.lit(0.0), F.least(F.col("duration_ms").cast("double"), F.lit(float(budget_ms)) - F.coalesce("_used", F.lit(0.0)))) / F.col("_cells")
    length = F.col("end_ms") - F.col("start_ms")
    axis = axis.withColumn("_sample", F.least(length.cast("double"), spent)).where("_sample > 0")
    axis = axis.withColumn("_parts", F.when(F.col("_sample") >= length, 1).when(F.col("_sample") >= 90_000, 3).when(F.col("_sample") >= 40_000, 2).otherwise(1))
    axis = axis.withColumn("_one", F.col("_sample") / F.col("_parts")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    center = F.col("start_ms") + F.col("_i") / (F.col("_parts") + 1) * length
    start = F.when(F.col("_sample") >= length, F.col("start_ms").cast("double")).otherwise(F.greatest(F.col("start_ms").cast("double"), F.least(F.col("end_ms") - F.col("_one"), center - F.col("_one") / 2)))
    uniform = axis.select("broadcast_id", start.alias("start_ms"), (start + F.col("_one")).alias("end_ms"), F.lit("uniform").alias("kind"))
    merged = merge(events.unionByName(uniform), ["broadcast_id"], "kind")
    before = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(W.partitionBy("broadcast_id").orderBy("start_ms").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    trimmed = merged.withColumn("_before", before).where(F.col("_before") < budget_ms).withColumn("end_ms", F.least(F.col("end_ms"), F.col("start_ms") + budget_ms - F.col("_before")))
    whole = rows.where("_whole").select("broadcast_id", F.lit(0.0).alias("start_ms"), F.col("duration_ms").cast("double").alias("end_ms"), F.array(F.lit("uniform")).alias("kinds"))
    return trimmed.select("broadcast_id", "start_ms", "end_ms", "kinds").unionByName(whole)


def fingerprint_plan(anchors: DataFrame, durations: DataFrame, reach_ms: int = 30_000, step_ms: int = 5_000) -> DataFrame:
    """Instants to sample for anchors(broadcast_id, ts_ms): each at every offset, once, inside the source."""
    every = anchors.select("broadcast_id", F.explode(F.transform(F.sequence(F.lit(-reach_ms), F.lit(reach_ms), F.lit(step_ms)), lambda o: F.col("ts_ms") + o)).alias("ts_ms")).distinct()
    return every.join(durations.select("broadcast_id", "duration_ms"), "broadcast_id").where("ts_ms >= 0 and ts_ms < duration_ms").drop("duration_ms")


def anchor_frames(durations: DataFrame, fps: float, per_sheet: int, anchors: int = 12, radius: int = 2) -> DataFrame:
    """Frames of a storyboard near evenly spread anchors: within radius of the anchor's frame and on its sheet."""
    total = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / 1000 * fps)).cast("long")
    rows = durations.withColumn("_total", total).withColumn("anchor", F.explode(F.sequence(F.lit(1), F.lit(anchors))))
    target = N.clamp(N.round_half_up((F.col("_total") - 1) * (F.col("anchor") / (anchors + 1))), 0, F.col("_total") - 1).cast("long")
    rows = rows.withColumn("_target", target).withColumn("frame", F.explode(F.sequence(F.col("_target") - radius, F.col("_target") + radius)))
    sheet = lambda c: F.floor(c / per_sheet)
    rows = rows.where((F.col("frame") >= 0) & (F.col("frame") < F.col("_total")) & (sheet(F.col("frame")) == sheet(F.col("_target"))))
    at = F.least(F.col("duration_ms") - 1, N.round_half_up(F.col("frame") / fps * 1000).cast("long"))
    return rows.select("broadcast_id", "anchor", "frame", sheet(F.col("frame")).cast("long").alias("sheet"), (F.col("frame") % per_sheet).alias("tile"), at.alias("ts_ms"))
