"""Density of events, episodes, quotas, diverse selection, ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import numbers as N
from .greedy import cut
from .grouped import pick_rows

#: Width of a density bin, and the longest episode.
BIN_MS, SPAN_MS = 300_000, 90_000


def event_density(points: DataFrame, durations: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Counts by bin with the smoothed expectation, the Poisson tail of bins above it, and quiet, normal or burst;
    mean, variance and dispersion of the source stand in each row."""
    counted = points.join(durations, "broadcast_id").where((F.col("t_ms") >= 0) & (F.col("t_ms") < F.col("duration_ms")))
    counted = counted.groupBy("broadcast_id", F.floor(F.col("t_ms") / bin_ms).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    axis = durations.where("duration_ms > 0").select("broadcast_id", "duration_ms", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration_ms") / bin_ms).cast("int") - 1)).alias("bin"))
    dense = axis.join(counted, ["broadcast_id", "bin"], "left").fillna(0, ["n"])
    whole, order = W.partitionBy("broadcast_id"), W.partitionBy("broadcast_id").orderBy("bin")
    df = dense.withColumn("mean", F.avg("n").over(whole)).withColumn("variance", F.var_pop("n").over(whole))
    df = df.withColumn("before", F.coalesce(F.lag("n").over(order), F.col("n"))).withColumn("after", F.coalesce(F.lead("n").over(order), F.col("n")))
    df = df.withColumn("expected", (F.col("mean") * 2 + 0.25 * F.col("before") + 0.5 * F.col("n") + 0.25 * F.col("after")) / 3)
    df = df.withColumn("tail", F.when((F.col("expected") > 0) & (F.col("n") > F.col("expected")), N.poisson_tail(F.col("n"), F.col("expected"))))
    burst = F.when(F.col("expected") > 0, F.col("tail").isNotNull() & ((F.col("tail") < 0.05) | (F.col("n") / F.col("expected") >= 2.5))).otherwise(F.col("n") > 0)
    quiet = F.when(F.col("expected") > 0, F.col("n") < F.col("expected") * 0.5).otherwise(F.col("n") == 0)
    kind = F.when(burst, "burst").when(quiet, "quiet").otherwise("normal")
    return df.select("broadcast_id", "bin", "n", "expected", "tail", kind.alias("density"), "mean", "variance", F.try_divide("variance", "mean").alias("dispersion"), "duration_ms")


def build_episodes(candidates: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """Candidates of one moment joined, in order of start: the newest episode that a candidate overlaps by 0.35, or
    touches with a peak within 30 seconds, or whose evidence it shares, takes it, if the whole stays within span_ms.

    No episode reaches a candidate that begins more than span_ms after the one before (candidates end no earlier than
    they begin), so a broadcast is cut there and each part folded alone.
    """
    item = F.struct("start_ms", "peak_ms", "id", "end_ms", "score", "kind", "key")
    parts = cut(candidates, ["broadcast_id"], F.col("start_ms"), F.col("start_ms") + span_ms, touch=True)
    rows = parts.groupBy("broadcast_id", "_part").agg(F.array_sort(F.collect_list(item)).alias("items"))
    one = lambda x: F.struct(
        x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.struct((-x["score"]).alias("s"), x["peak_ms"].alias("p"), x["id"].alias("id")).alias("rep"),
        F.array(x["id"]).alias("ids"), F.array(x["kind"]).alias("kinds"), F.array(x["key"]).alias("keys"),
    )

    def meets(e, x):
        fits = F.greatest(e["end_ms"], x["end_ms"]) - F.least(e["start_ms"], x["start_ms"]) <= span_ms
        over = F.greatest(F.lit(0), F.least(e["end_ms"], x["end_ms"]) - F.greatest(e["start_ms"], x["start_ms"]))
        shorter = F.greatest(F.lit(1), F.least(e["end_ms"] - e["start_ms"], x["end_ms"] - x["start_ms"]))
        near = (over >= 0.35 * shorter) | ((over > 0) & (F.abs(x["peak_ms"] - e["rep"]["p"]) <= 30_000))
        return fits & (near | (F.array_contains(e["keys"], x["key"]) & (x["start_ms"] - e["end_ms"] <= span_ms)))

    def step(acc, x):
        last = F.coalesce(F.array_max(F.transform(acc, lambda e, i: F.when(meets(e, x), i + 1))), F.lit(0))
        taken = lambda e: F.struct(
            F.least(e["start_ms"], x["start_ms"]).alias("start_ms"), F.greatest(e["end_ms"], x["end_ms"]).alias("end_ms"), F.least(e["rep"], one(x)["rep"]).alias("rep"),
            F.concat(e["ids"], F.array(x["id"])).alias("ids"), F.array_union(e["kinds"], F.array(x["kind"])).alias("kinds"), F.array_union(e["keys"], F.array(x["key"])).alias("keys"),
        )
        return F.when(last == 0, F.concat(acc, F.array(one(x)))).otherwise(F.transform(acc, lambda e, i: F.when(i + 1 == last, taken(e)).otherwise(e)))

    folded = F.aggregate("items", F.slice(F.transform("items", one), 1, 0), step)
    before = F.coalesce(F.sum("_made").over(W.partitionBy("broadcast_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    made = rows.select("broadcast_id", "_part", folded.alias("_all")).withColumn("_made", F.size("_all")).withColumn("_before", before)
    out = made.select("broadcast_id", "_before", F.posexplode("_all").alias("_pos", "e")).withColumn("episode", (F.col("_before") + F.col("_pos")).cast("int"))
    return out.select("broadcast_id", "episode", "e.start_ms", "e.end_ms", F.col("e.rep.id").alias("representative"), F.col("e.rep.p").alias("peak_ms"), (-F.col("e.rep.s")).alias("score"), F.sort_array("e.ids").alias("ids"), F.sort_array("e.kinds").alias("kinds"), F.sort_array("e.keys").alias("keys"))


def block_quotas(density: DataFrame, budget: int = 12) -> DataFrame:
    """Share of the budget of each block of 15 to 45 minutes, by the square root of what is expected there."""
    block_ms = N.clamp(F.col("duration_ms") / max(1, budget * 2), 900_000.0, 2_700_000.0)
    df = density.withColumn("block_ms", block_ms).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / F.col("block_ms"))))
    center = (F.col("bin") * BIN_MS + F.least(F.col("duration_ms"), (F.col("bin") + 1) * BIN_MS)) / 2
    df = df.withColumn("block", N.clamp(F.floor(center / F.col("block_ms")), 0, F.col("blocks") - 1).cast("int"))
    per = df.groupBy("broadcast_id", "block").agg(F.sum(F.greatest(F.lit(0.0), F.col("expected"))).alias("expected"), F.first("block_ms").alias("block_ms"))
    weight = F.sqrt(F.col("expected") + 0.25)
    return per.withColumn("quota", weight / F.sum(weight).over(W.partitionBy("broadcast_id")) * budget)


def minmax_quality(episodes: DataFrame) -> DataFrame:
    """Score between the least and greatest of the broadcast; the clamped score where all are the same."""
    whole = W.partitionBy("broadcast_id")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    return episodes.withColumn("quality", N.clamp(F.when(high - low > 2.220446049250313e-16, (F.col("score") - low) / (high - low)).otherwise(F.col("score")), 0.0, 1.0))


def episode_similarity(episodes: DataFrame, reach_ms: int = 360_000) -> DataFrame:
    """Likeness of pairs of episodes up to reach_ms apart: overlap, or nearness in time weighed by what they share.

    Beyond the reach the Gaussian is under 2e-7; episodes are filed by time, so a broadcast's are not crossed.
    """
    from .intervals import overlap_join

    right = episodes.select("broadcast_id", F.col("episode").alias("other"), (F.col("start_ms") - reach_ms).alias("r_start"), (F.col("end_ms") + reach_ms).alias("r_end"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"), F.col("peak_ms").alias("p2"), F.col("kinds").alias("k2"), F.col("keys").alias("y2"))
    met = (F.col("episode") < F.col("other")) & (F.greatest("start_ms", "r_start") < F.least("end_ms", "r_end"))
    pairs = overlap_join(episodes, right, ["broadcast_id"], condition=met, bin_ms=600_000)
    over = I.overlap_ratio(F.col("start_ms"), F.col("end_ms"), F.col("s2"), F.col("e2"))
    near = F.exp(-F.pow(F.abs(F.col("peak_ms") - F.col("p2")) / 90_000, 2))
    shared = F.when(F.arrays_overlap("keys", "y2"), 0.8).when(F.arrays_overlap("kinds", "k2"), 0.2).otherwise(0.1)
    return pairs.select("broadcast_id", "episode", "other", N.clamp(F.greatest(over, shared * near), 0.0, 1.0).alias("similarity"))


def select_diverse(episodes: DataFrame, quotas: DataFrame, budget: int = 12, balance: float = 0.75, exploration: float = 0.15) -> DataFrame:
    """Maximal marginal relevance: in turn the episode with the best mix of quality and distance from those taken.

    A block that has had its quota(broadcast_id, block, quota, block_ms) counts less, a recommended episode a little more.
    The last picks are left to exploration: episodes of blocks or signals that no pick has yet. Only eligible episodes
    are taken otherwise. Each pick changes all later scores, so the bounded list of a broadcast is worked in one group.
    episodes as of build_episodes; eligible and recommended (boolean) may be missing.
    """
    for name, value in (("eligible", True), ("recommended", False)):
        episodes = episodes if name in episodes.columns else episodes.withColumn(name, F.lit(value))
    slots = min(budget, int(np.floor(budget * exploration + 0.5)))

    def choose(rows: pa.RecordBatch) -> tuple[list[int], dict[str, list]]:
        start, end, peak, score = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("start_ms", "end_ms", "peak_ms", "score"))
        eligible, advised = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("eligible", "recommended"))
        keys, kinds = _Held(rows.column("keys")), _Held(rows.column("kinds"))
        span = score.max() - score.min()
        quality = (score - score.min()) / span if span > 2.220446049250313e-16 else np.clip(score, 0, 1)
        shares = rows.column("_shares")[0].as_py()
        quota = np.array([s["quota"] for s in shares], dtype=float) if shares else np.array([float(budget)])
        width = float(shares[0]["block_ms"]) if shares else np.inf
        block = np.clip(np.floor(peak / width), 0, len(quota) - 1).astype(int)
        used, likeness, left = np.zeros(len(quota)), np.zeros(len(rows)), np.ones(len(rows), dtype=bool)
        picks, passes, news, shown = [], [], kinds.sizes.copy(), set()

        def pick(pool: np.ndarray, name: str) -> bool:
            nonlocal likeness
            if not pool.any():
                return False
            over = np.maximum(0, used[block] - np.maximum(0.25, quota[block]) + 1)
            value = (balance * quality + (1 - balance) * (1 - likeness)) / (1 + 0.35 * over) + 0.08 * advised
            best = int(np.lexsort((-np.round(quality, 9), -np.round(np.where(pool, value, -np.inf), 9)))[0])
            picks.append(best)
            passes.append(name)
            left[best] = False
            used[block[best]] += 1
            for kind in kinds.of(best):
                if kind not in shown:
                    shown.add(kind)
                    news[kinds.rows(kind)] -= 1
            met = np.maximum(0, np.minimum(end, end[best]) - np.maximum(start, start[best])) / np.maximum(1, np.minimum(end - start, end[best] - start[best]))
            shared = np.full(len(rows), 0.1)
            for held, weight in ((kinds, 0.2), (keys, 0.8)):
                for value in held.of(best):
                    shared[held.rows(value)] = weight
            likeness = np.maximum(likeness, np.maximum(met, shared * np.exp(-(((peak - peak[best]) / 90_000) ** 2))))
            return True

        while len(picks) < budget - slots and pick(left & eligible, "main"):
            pass
        while len(picks) < budget and left.any():
            fresh = left & ((used[block] == 0) | (news > 0))
            if not pick(fresh, "exploration") and not pick(left & eligible, "main"):
                break
        return picks, {"pick": list(range(1, len(picks) + 1)), "pass": passes}

    own = episodes.select("broadcast_id", "episode", "representative", "start_ms", "end_ms", "peak_ms", "score", "keys", "kinds", "eligible", "recommended")
    shares = quotas.groupBy("broadcast_id").agg(F.array_sort(F.collect_list(F.struct("block", "quota", "block_ms"))).alias("_shares"))
    return pick_rows(own.join(shares, "broadcast_id", "left"), "broadcast_id", [F.asc_nulls_last("peak_ms"), F.asc_nulls_last("representative")], ["broadcast_id", "episode", "representative"], choose, {"pick": pa.int32(), "pass": pa.string()})


class _Held:
    """Which rows of a column of lists hold a value, and which values a row holds, each once."""

    def __init__(self, lists: pa.ListArray):
        codes = lists.flatten().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        both = np.unique(row * (1 + codes.max(initial=0)) + codes)
        self.row, self.code = both // (1 + codes.max(initial=0)), both % (1 + codes.max(initial=0))
        self.sizes = np.bincount(self.row, minlength=len(lists))
        self.cuts = np.append(0, np.cumsum(self.sizes))
        self.order = np.argsort(self.code, kind="stable")
        self.begin = np.searchsorted(self.code[self.order], np.arange(2 + codes.max(initial=0)))

    def of(self, row: int) -> list[int]:
        return self.code[self.cuts[row] : self.cuts[row + 1]].tolist()

    def rows(self, code: int) -> np.ndarray:
        return self.row[self.order[self.begin[code] : self.begin[code + 1]]]


def rank_by_evidence(evidence: DataFrame) -> DataFrame:
    """Support points of audio, chat and picture scores and their agreement; the new order and what it moves.

    evidence has broadcast_id, id, previous, peak_ms, audio, chat, visual (null: no such signal) and strength, the
    strongest sound event (0, 0.5 or 1).
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    family = F.when(F.col("strength") == 0, zero("audio")).when(zero("audio") > 0, zero("audio") + 0.1 * F.col("strength") * (1 - zero("audio"))).otherwise(0.35 * F.col("strength"))
    points = lambda w, x: N.round_half_up(w * x).cast("long")
    df = evidence.withColumn("audio_base", points(6000, zero("audio"))).withColumn("audio_points", F.greatest(F.col("audio_base"), points(6000, family)))
    df = df.withColumn("chat_points", points(3000, zero("chat"))).withColumn("visual_points", points(500, zero("visual")))
    df = df.withColumn("agreement", F.when(F.col("audio").isNotNull() & F.col("chat").isNotNull(), 500).otherwise(0).cast("long"))
    df = df.withColumn("total", F.least(F.lit(10_000), F.col("audio_points") + F.col("chat_points") + F.col("visual_points") + F.col("agreement")))
    reasons = F.array_compact(F.array(F.when(F.col("audio").isNotNull(), "audio"), F.when(F.col("strength") > 0, "sound-event"), F.when(F.col("chat").isNotNull(), "chat"), F.when(F.col("visual").isNotNull(), "picture"), F.when(F.col("agreement") > 0, "agreement")))
    order = W.partitionBy("broadcast_id").orderBy(F.desc("total"), "previous", "peak_ms", "id")
    return df.withColumn("reasons", reasons).withColumn("ordinal", F.row_number().over(order)).withColumn("moved", F.col("ordinal") != F.col("previous"))


def even_slices(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Rows in order cut into n slices that differ by one at most: slice k holds rows floor(k * size / n) and on."""
    w = W.partitionBy(*keys)
    at, size = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    parts = F.least(F.lit(n), size)
    return df.withColumn("slice", F.floor(((at + 1) * parts - 1) / size).cast("int"))


def spread_sample(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """k rows at even distances, the first and the last among them; all rows where there are no more."""
    w = W.partitionBy(*keys)
    at, size = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (size - 1) / (k - 1) + 0.5))
    marked = df.withColumn("_at", at).withColumn("_size", size).withColumn("_want", wanted)
    return marked.where((F.col("_size") <= k) | F.array_contains("_want", F.col("_at").cast("bigint"))).drop("_at", "_size", "_want")


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("pick", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("pick") <= k)


def bounded_peaks(df: DataFrame, most: int = 12) -> DataFrame:
    """Distinct peaks of each broadcast in order, at most ``most``."""
    return top_per_group(df.select("broadcast_id", "peak_ms").distinct(), ["broadcast_id"], [F.asc("peak_ms")], most)


def batches(tasks: DataFrame, done: DataFrame, order: list, size: int = 12) -> DataFrame:
    """Tasks that are not done, in order, in batches of size."""
    return tasks.join(done, ["broadcast_id", "id"], "left_anti").withColumn("batch", F.floor((F.row_number().over(W.partitionBy("broadcast_id").orderBy(*order)) - 1) / size).cast("int"))
