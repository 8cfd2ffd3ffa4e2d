"""Gates and generators: verdicts, range checks, cohorts, effective ranges, sampling windows, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N


#: The status words, categories and gap codes below are fixed values: they stand in the data that is read.


def verdict_gap(decision: Column, material: Column, consistency: Column) -> Column:
    """Why a candidate is not accepted; null if it is. The first matching rule counts."""
    sound = (material == "streamer-event") & (consistency == "consistent")
    return (
        F.when(decision.isNull(), "insight-missing").when(consistency == "insufficient", "context-insufficient")
        .when((decision == "uncertain") & (material == "routine-or-unclear"), "program-material-unclear").when((decision == "uncertain") & sound, "detail-uncertain").when(decision == "uncertain", "detail-verdict-incoherent")
        .when((decision == "recommend") & ~sound, "detail-verdict-incoherent").when(decision == "recommend", F.lit(None))
        .when(consistency == "conflict", "context-conflict").when(material == "music-or-intermission", "program-material-excluded").when(material == "routine-or-unclear", "program-material-unclear")
        .when(sound, "detail-not-recommended").otherwise("detail-verdict-incoherent")
    )


def range_problem(start: Column, end: Column, peak: Column, duration: Column, least: int = 30_000, most: int = 60_000) -> Column:
    """Why a clip's range is refused; null if it is sound."""
    bad = (start < 0) | (start >= end) | (end > duration)
    low = F.least(F.lit(least), duration)
    return F.when(bad, "range_out_of_source").when((peak < start) | (peak > end), "would_exclude_peak").when(end - start < low, "duration_below_minimum").when(end - start > most, "duration_above_maximum")


def publication_gate(details: DataFrame, keys: list[str]) -> DataFrame:
    """A source may be published when its plan is durable, nothing runs or failed and no detail is outstanding:
    details(keys, status, durable)."""
    per = details.groupBy(*keys).agg(F.count_if(F.col("status") == "running").alias("n_running"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "outstanding").alias("n_outstanding"), F.min("durable").alias("durable"))
    return per.withColumn("ready", (F.col("n_running") == 0) & (F.col("n_failed") == 0) & (F.col("n_outstanding") == 0) & F.col("durable"))


def eligible_enrollment(assets: DataFrame) -> DataFrame:
    """Voice samples of pure speech that a person has verified and whose consent is given or not needed."""
    return assets.where((F.col("activity") == "speech") & ~F.col("overlapping") & ~F.col("music") & (F.col("verification") == "verified") & F.col("consent").isin("granted", "not-required"))


def verification_cohort(candidates: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Candidates that are not rejected and are in any of the scheduled(id) sets."""
    return candidates.where("review <> 'rejected'").join(scheduled.select("id").distinct(), "id", "left_semi")


def effective_ranges(proposals: DataFrame, edits: DataFrame) -> DataFrame:
    """The edited range of each proposal(id, revision, start_ms, end_ms) if the edit was made on this revision."""
    e = edits.select("id", F.col("revision").alias("e_rev"), F.col("start_ms").alias("e0"), F.col("end_ms").alias("e1"))
    own = F.col("e_rev").isNotNull() & (F.col("e_rev") == F.col("revision"))
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    return proposals.join(e, "id", "left").select("id", pick("e0", "start_ms").alias("start_ms"), pick("e1", "end_ms").alias("end_ms"), F.when(own, "edit").when(F.col("e_rev").isNotNull(), "stale-edit").otherwise("proposal").alias("source"))


def settle_cells(plan: DataFrame, texts: DataFrame, silent: DataFrame, keys: list[str]) -> DataFrame:
    """Each planned cell: success with a text, resolved if verified as silent, else a gap."""
    both = plan.join(texts.select(*keys, "text"), keys, "left").join(silent.select(*keys).distinct().withColumn("_s", F.lit(True)), keys, "left")
    return both.withColumn("status", F.when(F.col("text").isNotNull(), "success").when(F.col("_s"), "resolved").otherwise("gap")).drop("_s")


def queue_buckets(queue: DataFrame, active: DataFrame, assigned: DataFrame) -> DataFrame:
    """Disjoint parts of a work queue: active, assigned, startable, scheduled."""
    mark = lambda df, c: df.select("video_id").distinct().withColumn(c, F.lit(True))
    both = queue.join(mark(active, "_a"), "video_id", "left").join(mark(assigned, "_q"), "video_id", "left")
    return both.withColumn("part", F.when(F.col("_a"), "active").when(F.col("_q"), "assigned").when(F.col("ready"), "startable").otherwise("scheduled")).drop("_a", "_q")


def frame_times(start: Column, end: Column) -> Column:
    """Four instants inside a clip."""
    return F.array_distinct(F.transform(F.array(*map(F.lit, (0.1, 0.37, 0.63, 0.9))), lambda r: N.round_half_up((end - start - 1) * r).cast("long")))


def event_windows(candidates: DataFrame, width_ms: int = 10_000) -> DataFrame:
    """Windows before, near and after each peak, inside the source, each once."""
    starts = F.array(*(F.struct(F.lit(n).alias("phase"), (F.col("peak_ms") + d).alias("s")) for n, d in (("before", -15_000), ("near", -5_000), ("after", 5_000))))
    # dealt before there are three rows of each, so that a task sends a third of them
    dealt = candidates.select("broadcast_id", "id", "duration_ms", "peak_ms").repartition("broadcast_id", "id")
    rows = dealt.select("broadcast_id", "id", "duration_ms", F.explode(starts).alias("w"))
    start = N.clamp(F.col("w.s"), 0, F.greatest(F.lit(0), F.col("duration_ms") - width_ms))
    rows = rows.select("broadcast_id", "id", F.col("w.phase").alias("phase"), start.cast("long").alias("start_ms"), F.least(F.col("duration_ms"), start + width_ms).cast("long").alias("end_ms"))
    order = W.partitionBy("broadcast_id", "id", "start_ms").orderBy(F.when(F.col("phase") == "near", 0).when(F.col("phase") == "before", 1).otherwise(2))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def planned_samples(duration: Column) -> Column:
    """Number of five-second samples of a source, one at least."""
    return F.greatest(F.lit(1), F.floor(duration / 5000 + 0.5)).cast("long")


def unfinished_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that are not done, those with the most progress first, by owner."""
    order = W.partitionBy("owner").orderBy(F.desc("progress"), F.desc("day"), "job_id")
    return jobs.where("status not in ('completed', 'abandoned')").withColumn("place", F.row_number().over(order))


def cost_envelope(sources: DataFrame, limit: float) -> DataFrame:
    """Planned cost of each source(broadcast_id, audio_ms, images, chars): seconds of speech, tokens of sound, picture
    and text, a reserve of a fifth, and whether the limit holds."""
    tokens = F.ceil(F.col("audio_ms") / 1000) * 25 + F.col("images") * 258 + F.ceil(F.col("chars") / 2)
    cost = F.ceil(F.col("audio_ms") / 1000) * 0.0001 + tokens * 0.0000003
    return sources.select("broadcast_id", F.ceil(F.col("audio_ms") / 1000).alias("speech_seconds"), tokens.alias("tokens"), (cost * 1.2).alias("cost"), (cost * 1.2 <= limit).alias("within"))


def speech_coverage(plan: DataFrame, receipts: DataFrame) -> DataFrame:
    """Planned cells(broadcast_id, cell, duration_ms) by the outcome of their receipts(broadcast_id, cell, outcome)."""
    both = plan.join(receipts, ["broadcast_id", "cell"], "left")
    count = lambda o: F.count_if(F.col("outcome") == o)
    return both.groupBy("broadcast_id").agg(
        F.count("*").alias("n_planned"), count("speech").alias("n_speech"), count("no-speech").alias("n_silent"), count("inconclusive").alias("n_inconclusive"), F.count_if(F.col("outcome").isNull()).alias("n_missing"),
        F.sum(F.when(F.col("outcome") == "speech", F.col("duration_ms")).otherwise(0)).cast("long").alias("speech_ms"),
    )
