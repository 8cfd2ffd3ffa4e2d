"""Fusion of signals: scores normalised within a signal, pairs across signals, one-to-one matching, suppression.

Input is candidates(broadcast_id, kind, id, peak_ms, start_ms, end_ms, score) and durations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import numbers as N
from ..storage import stored
from .greedy import cut, match_pairs, suppress
from .intervals import overlap_join

#: How far apart two peaks may be, and the length of a reaction.
PROXIMITY_MS, WINDOW_MS = 10_000, 45_000


def sanitize(candidates: DataFrame, durations: DataFrame) -> DataFrame:
    """Candidates with an id and finite values, clamped to the source; empty ones go."""
    df = candidates.join(durations, "broadcast_id")
    for c in ("peak_ms", "start_ms", "end_ms"):
        df = df.withColumn(c, N.clamp(N.round_half_up(F.col(c)).cast("long"), 0, F.col("duration_ms")).cast("long"))
    good = F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    return df.where(good & (F.col("end_ms") > F.col("start_ms")))


def normalize_scores(candidates: DataFrame) -> DataFrame:
    """Rank and robust percentile within broadcast and kind, and their 65 : 35 mix as ``norm``."""
    whole = W.partitionBy("broadcast_id", "kind")
    n, rank = F.count("*").over(whole), F.rank().over(whole.orderBy(F.desc("score")))
    center = candidates.groupBy("broadcast_id", "kind").agg(F.percentile("score", 0.5).alias("center"))
    df = candidates.join(center, ["broadcast_id", "kind"])
    mad = df.groupBy("broadcast_id", "kind").agg(F.percentile(F.abs(F.col("score") - F.col("center")), 0.5).alias("mad"))
    df = df.join(mad, ["broadcast_id", "kind"])
    df = df.withColumn("rank_percentile", F.when(n == 1, F.lit(1.0)).otherwise(1 - (rank - 1) / (n - 1)))
    df = df.withColumn("robust_percentile", N.squashed_percentile(F.col("score"), F.col("center"), F.col("mad")))
    return df.withColumn("norm", F.col("rank_percentile") * 0.65 + F.col("robust_percentile") * 0.35).drop("center", "mad")


def pair_signals(left: DataFrame, right: DataFrame, proximity_ms: int = PROXIMITY_MS, bonus: float = 0.16) -> DataFrame:
    """Pairs of two signals that overlap or whose peaks are near, with the fused score.

    Both sides are binned by their interval widened to the peak's reach, so a broadcast's candidates are not crossed.
    """
    l = left.select("broadcast_id", F.col("id").alias("l_id"), F.col("peak_ms").alias("l_peak"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"), F.col("norm").alias("l_norm"))  # noqa: E741
    r = right.select("broadcast_id", F.col("id").alias("r_id"), F.col("peak_ms").alias("r_peak"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"), F.col("norm").alias("r_norm"))
    l = l.withColumn("start_ms", F.least("l_start", F.col("l_peak") - proximity_ms)).withColumn("end_ms", F.greatest("l_end", F.col("l_peak") + proximity_ms))  # noqa: E741
    r = r.withColumn("r_start", F.least("rs", "r_peak")).withColumn("r_end", F.greatest("re", "r_peak"))
    ratio, distance = I.overlap_ratio(F.col("l_start"), F.col("l_end"), F.col("rs"), F.col("re")), F.abs(F.col("l_peak") - F.col("r_peak"))
    pairs = overlap_join(l, r, ["broadcast_id"], condition=(ratio > 0) | (distance <= proximity_ms))
    fused = N.clamp((F.col("l_norm") + F.col("r_norm")) / 2 + bonus, 0.0, 1.0)
    return pairs.withColumn("overlap_ratio", ratio).withColumn("distance_ms", distance).withColumn("fused", fused).drop("start_ms", "end_ms", "r_start", "r_end")


def match(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs: largest overlap first, then nearest peaks, then best score."""
    order = [F.desc("overlap_ratio"), F.asc("distance_ms"), F.desc("fused"), F.asc("l_id"), F.asc("r_id")]
    return match_pairs(pairs, ["broadcast_id"], order, "l_id", "r_id", ("l_peak", "r_peak"))


def reaction_drafts(audio: DataFrame, chat: DataFrame) -> DataFrame:
    """Matched audio and chat candidates as one draft each, and the unmatched of both on their own."""
    pairs = match(pair_signals(audio, chat)).select("broadcast_id", "l_id", "r_id", "fused")
    a = audio.select("broadcast_id", F.col("id").alias("l_id"), "peak_ms", F.col("start_ms").alias("a0"), F.col("end_ms").alias("a1"), "norm", "duration_ms")
    c = chat.select("broadcast_id", F.col("id").alias("r_id"), F.col("peak_ms").alias("c_peak"), F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1"), F.col("norm").alias("c_norm"), F.col("duration_ms").alias("c_dur"))
    with_pair = a.join(pairs, ["broadcast_id", "l_id"], "left").join(c, ["broadcast_id", "r_id"], "full_outer")
    kinds = F.array_compact(F.array(F.when(F.col("l_id").isNotNull(), "audio"), F.when(F.col("r_id").isNotNull(), "chat")))
    return with_pair.select(
        "broadcast_id", F.col("l_id").alias("audio_id"), F.col("r_id").alias("chat_id"), F.coalesce("peak_ms", "c_peak").alias("peak_ms"), F.coalesce("fused", "norm", "c_norm").alias("score"),
        F.least("a0", "c0").alias("anchor_start"), F.greatest("a1", "c1").alias("anchor_end"), kinds.alias("kinds"), F.coalesce("duration_ms", "c_dur").alias("duration_ms"),
    )


def attach_context(drafts: DataFrame, visual: DataFrame, proximity_ms: int = PROXIMITY_MS) -> DataFrame:
    """Drafts with the picture candidate that fits each best, one to one; it adds 0.04 of its score."""
    keyed = drafts.withColumn("draft", F.struct("audio_id", "chat_id"))
    l = keyed.select("broadcast_id", F.col("draft").alias("l_id"), F.col("peak_ms").alias("l_peak"), F.col("anchor_start").alias("l_start"), F.col("anchor_end").alias("l_end"))  # noqa: E741
    pairs = pair_signals(l.select("broadcast_id", F.col("l_id").alias("id"), F.col("l_peak").alias("peak_ms"), F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"), F.lit(0.0).alias("norm")), visual, proximity_ms)
    order = [F.desc("overlap_ratio"), F.asc("distance_ms"), F.desc("r_norm"), F.asc("l_id"), F.asc("r_id")]
    chosen = match_pairs(pairs, ["broadcast_id"], order, "l_id", "r_id", ("l_peak", "r_peak"))
    chosen = chosen.select(F.col("broadcast_id").alias("_b"), F.col("l_id.audio_id").alias("_a"), F.col("l_id.chat_id").alias("_c"), F.col("r_id").alias("visual_id"), "r_norm")
    # a draft has a side that is null, so its ids are compared null-safely
    met = (F.col("broadcast_id") == F.col("_b")) & F.col("audio_id").eqNullSafe(F.col("_a")) & F.col("chat_id").eqNullSafe(F.col("_c"))
    out = drafts.join(chosen, met, "left").drop("_b", "_a", "_c")
    score = F.when(F.col("r_norm").isNotNull(), N.clamp(F.col("score") + 0.04 * F.col("r_norm"), 0.0, 1.0)).otherwise(F.col("score"))
    kinds = F.when(F.col("visual_id").isNotNull(), F.concat("kinds", F.array(F.lit("visual")))).otherwise(F.col("kinds"))
    return out.withColumn("score", score).withColumn("kinds", kinds).drop("r_norm")


def music_like(evidence: DataFrame) -> DataFrame:
    """evidence with ``music_like``: a quiet, band-limited dialogue signal that no chat confirms."""
    lifted = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    present = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    bed = (F.col("kind") == "dialogue-issue-signal") & F.col("chat_id").isNull() & (present("n_active") >= 1) & (present("n_windows") >= 1)
    bed = bed & present("speech").between(0.55, 0.78) & (lifted("lift") <= 1.2) & (lifted("loudness") <= 0.5) & (lifted("click") <= 0.45) & (lifted("background") <= 0.35)
    return evidence.withColumn("music_like", bed)


def fuse_reactions(candidates: DataFrame, durations: DataFrame, most: int = 96) -> DataFrame:
    """Reaction intervals of audio and chat, strengthened by pictures; consensus first, then by score, suppressed at
    half overlap. Without any anchor at most four picture candidates, scores capped at 0.32, stand in."""
    ranked = stored(normalize_scores(sanitize(candidates, durations)), "fusion-ranked")  # read four times
    of = lambda k: ranked.where(F.col("kind") == k)
    anchored = attach_context(reaction_drafts(of("audio"), of("chat")), of("visual")).withColumn("exploration", F.lit(False))
    bare = of("visual").join(ranked.where("kind in ('audio', 'chat')").select("broadcast_id").distinct(), "broadcast_id", "left_anti")
    bare = bare.select("broadcast_id", F.lit(None).cast("long").alias("audio_id"), F.lit(None).cast("long").alias("chat_id"), "peak_ms", (F.col("norm") * 0.32).alias("score"), F.col("start_ms").alias("anchor_start"), F.col("end_ms").alias("anchor_end"), F.array(F.lit("visual")).alias("kinds"), "duration_ms", F.col("id").alias("visual_id"), F.lit(True).alias("exploration"))
    drafts = anchored.unionByName(bare)
    start = F.when(F.col("exploration"), I.window_start(F.col("peak_ms"), F.col("duration_ms"), WINDOW_MS, 0.5)).otherwise(I.window_start(F.col("peak_ms"), F.col("duration_ms"), WINDOW_MS, 0.625))
    placed = drafts.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + WINDOW_MS).withColumn("consensus", (F.col("audio_id").isNotNull() & F.col("chat_id").isNotNull()).cast("int"))
    order = [F.desc("consensus"), F.desc("score"), F.desc(F.size("kinds")), F.asc("peak_ms"), F.asc("start_ms"), F.asc("audio_id"), F.asc("chat_id"), F.asc("visual_id")]
    return suppress(placed, ["broadcast_id"], order, most).where(~F.col("exploration") | (F.col("pick") <= 4)).drop("anchor_start", "anchor_end", "duration_ms", "consensus")


def weighted_peak(pairs: DataFrame) -> DataFrame:
    """Peak of a pair, weighted by the normalised scores, 0.01 at least."""
    a, b = F.greatest(F.lit(0.01), F.col("l_norm")), F.greatest(F.lit(0.01), F.col("r_norm"))
    return pairs.withColumn("peak_ms", N.round_half_up((F.col("l_peak") * a + F.col("r_peak") * b) / (a + b)).cast("long"))


def score_points(candidates: DataFrame) -> DataFrame:
    """Score over the greatest of its broadcast and kind, 0.08 at least."""
    top = F.max("score").over(W.partitionBy("broadcast_id", "kind"))
    return candidates.withColumn("point", F.greatest(F.lit(0.08), F.when(top > 0, F.col("score") / top).otherwise(0.0)))


def fuse_sources(candidates: DataFrame) -> DataFrame:
    """Candidates of several sources merged in order: semantic first, then by score. One joins the first that it
    overlaps by half, or whose focus is within eight seconds, unless both are semantic; scores join as noisy-or.

    A merged candidate keeps the times of its first, so a broadcast is cut where neither intervals nor foci meet, and
    each part is folded alone. A candidate without length overlaps all others by half, and a broadcast with one is whole.
    """
    item_fields = ["id", "kind", "start_ms", "end_ms", "peak_ms", "score"]
    order = W.partitionBy("broadcast_id").orderBy(F.desc((F.col("kind") == "semantic").cast("int")), F.desc("score"), "start_ms", "id")
    bare, farthest = F.col("end_ms") <= F.col("start_ms"), F.lit(2**62)
    low = F.when(bare, -farthest).otherwise(F.least(F.col("start_ms"), F.col("peak_ms") - 4000))
    high = F.when(bare, farthest).otherwise(F.greatest(F.col("end_ms"), F.col("peak_ms") + 4000))
    parts = cut(candidates.withColumn("_n", F.row_number().over(order)), ["broadcast_id"], low, high, touch=True)
    rows = parts.groupBy("broadcast_id", "_part").agg(F.array_sort(F.collect_list(F.struct("_n", *item_fields))).alias("items"))
    one = lambda x: F.struct(x["_n"].alias("first"), F.array(x["id"]).alias("ids"), F.array(x["kind"]).alias("kinds"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["peak_ms"].alias("peak_ms"), x["score"].alias("score"))

    def meets(a, x):
        over = F.greatest(F.lit(0), F.least(a["end_ms"], x["end_ms"]) - F.greatest(a["start_ms"], x["start_ms"]))
        shorter = F.least(a["end_ms"] - a["start_ms"], x["end_ms"] - x["start_ms"])
        near = (over >= 0.5 * shorter) | (F.abs(a["peak_ms"] - x["peak_ms"]) <= 8000)
        return near & ~(F.array_contains(a["kinds"], "semantic") & (x["kind"] == "semantic"))

    def step(acc, x):
        flags = F.transform(acc, lambda a: meets(a, x))
        first = F.coalesce(F.array_position(flags, True), F.lit(0))
        joined = lambda a: F.struct(a["first"].alias("first"), F.concat(a["ids"], F.array(x["id"])).alias("ids"), F.array_union(a["kinds"], F.array(x["kind"])).alias("kinds"), a["start_ms"].alias("start_ms"), a["end_ms"].alias("end_ms"), a["peak_ms"].alias("peak_ms"), F.least(F.lit(1.0), N.noisy_or(a["score"], x["score"])).alias("score"))
        return F.when(first == 0, F.concat(acc, F.array(one(x)))).otherwise(F.transform(acc, lambda a, i: F.when(i + 1 == first, joined(a)).otherwise(a)))

    empty = F.slice(F.transform("items", one), 1, 0)
    out = rows.select("broadcast_id", F.explode(F.aggregate("items", empty, step)).alias("c")).select("broadcast_id", "c.*")
    out = out.withColumn("n", F.row_number().over(W.partitionBy("broadcast_id").orderBy("first")) - 1).drop("first")
    return out.select("broadcast_id", "n", "ids", "kinds", "start_ms", "end_ms", "peak_ms", "score").withColumn("ids", F.sort_array("ids")).withColumn("kinds", F.sort_array("kinds"))


def balanced_pick(candidates: DataFrame, cycle: tuple[tuple[str, int], ...] = (("semantic", 4), ("audio", 1), ("visual", 1)), most: int = 12) -> DataFrame:
    """Round robin over kinds, several of a kind in a turn; each kind by score."""
    order = W.partitionBy("broadcast_id", "kind").orderBy(F.desc("score"), "start_ms", "id")
    turn = spot = None
    before = 0
    for kind, n in cycle:
        here = F.col("kind") == kind
        t, s = F.floor((F.col("_r") - 1) / n), (F.col("_r") - 1) % n + before
        turn, spot = (F.when(here, t), F.when(here, s)) if turn is None else (turn.when(here, t), spot.when(here, s))
        before += n
    ranked = candidates.withColumn("_r", F.row_number().over(order)).withColumn("_t", turn).withColumn("_s", spot).where("_t is not null")
    picked = ranked.withColumn("pick", F.row_number().over(W.partitionBy("broadcast_id").orderBy("_t", "_s")))
    return picked.where(F.col("pick") <= most).drop("_r", "_t", "_s")
