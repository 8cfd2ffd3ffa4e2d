"""Queries of gates and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import fusion, gates
from .catalog import NOW, VIDEOS, videos
from .tables import CANDIDATES, CHAPTERS, candidates, chapters, hours, read, rounded

DECISIONS, MATERIALS, CONSISTENCIES = ("recommend", "uncertain", "reject"), ("streamer-event", "music-or-intermission", "routine-or-unclear"), ("consistent", "conflict", "insufficient")


def _pick(column, values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def verdict_gaps(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem")
    found = c.select(_pick(F.col("l_partkey"), DECISIONS).alias("d"), _pick(F.col("l_orderkey"), MATERIALS).alias("m"), _pick(F.col("l_linenumber"), CONSISTENCIES).alias("k"))
    return found.select("d", "m", "k", gates.verdict_gap(F.col("d"), F.col("m"), F.col("k")).alias("gap")).groupBy("d", "m", "k", "gap").agg(F.count("*").alias("n"))


def range_problems(spark, sf_dir):
    c = candidates(spark, sf_dir)
    end = F.col("end_ms") - F.col("peak_ms") % 40_000 + F.col("peak_ms") % 7 * 9000
    return c.select("id", gates.range_problem(F.col("start_ms"), end, F.col("peak_ms"), F.lit(3_600_000)).alias("problem"))


def publication_gate(spark, sf_dir):
    d = videos(spark, sf_dir).select("channel_id", F.when(F.col("state") == "published", "done").when(F.col("attempts") == 4, "failed").when(F.col("stage") == "context", "running").otherwise("outstanding").alias("status"), (F.col("video_id") % 50 != 0).alias("durable"))
    return gates.publication_gate(d, ["channel_id"])


def enrollment_assets(spark, sf_dir):
    a = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, "silence").otherwise("speech").alias("activity"), (F.col("vec_id") % 7 == 0).alias("overlapping"), (F.col("vec_id") % 11 == 0).alias("music"), F.when(F.col("vec_id") % 3 == 0, "pending").otherwise("verified").alias("verification"), _pick(F.col("vec_id"), ("granted", "not-required", "refused")).alias("consent"))
    return gates.eligible_enrollment(a).select("vec_id")


def verification_cohort(spark, sf_dir):
    c = candidates(spark, sf_dir).select("id", F.when(F.col("kind") == "visual", "rejected").otherwise("open").alias("review"))
    return gates.verification_cohort(c, c.where("id % 3 = 0").select("id").unionByName(c.where("id % 4 = 0").select("id"))).select("id")


def effective_ranges(spark, sf_dir):
    c = candidates(spark, sf_dir).select("id", (F.col("id") % 3).alias("revision"), "start_ms", "end_ms").distinct()
    edits = c.where("id % 2 = 0").select("id", (F.col("id") % 5 % 3).alias("revision"), (F.col("start_ms") + 1000).alias("start_ms"), (F.col("end_ms") - 1000).alias("end_ms"))
    return gates.effective_ranges(c, edits)


def settled_cells(spark, sf_dir):
    c = chapters(spark, sf_dir)
    plan = c.select("broadcast_id", "n")
    return gates.settle_cells(plan, c.where("doc_id % 3 = 0").select("broadcast_id", "n", "text"), c.where("doc_id % 3 < 2"), ["broadcast_id", "n"]).groupBy("broadcast_id", "status").agg(F.count("*").alias("cells"))


def queue_parts(spark, sf_dir):
    v = videos(spark, sf_dir).where("state <> 'published'").withColumn("ready", F.coalesce(F.col("next_at") <= F.expr(NOW), F.lit(True)))
    return gates.queue_buckets(v, v.where("video_id % 10 = 0"), v.where("video_id % 5 = 0")).select("video_id", "part")


def clip_frames(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("id", F.array_join(F.transform(gates.frame_times(F.col("start_ms"), F.col("end_ms")), lambda x: x.cast("string")), ",").alias("frames"), gates.planned_samples(F.col("peak_ms")).alias("samples"))


def event_windows(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return gates.event_windows(fusion.sanitize(c, hours(c)))


def unfinished_jobs(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders").selectExpr("o_custkey as owner", "o_orderkey as job_id", "case o_orderstatus when 'F' then 'completed' when 'P' then 'abandoned' else 'running' end as status", "o_orderkey % 100 as progress", "o_orderdate as day")
    return gates.unfinished_jobs(jobs).select("owner", "job_id", "place")


def cost_envelopes(spark, sf_dir):
    s = chapters(spark, sf_dir).groupBy("broadcast_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("audio_ms"), F.count("*").alias("images"), F.sum(F.char_length("text")).alias("chars"))
    return gates.cost_envelope(s, 1.0).select("broadcast_id", "speech_seconds", "tokens", N.round_half_up(F.col("cost"), 6).alias("cost"), "within")


def speech_coverage(spark, sf_dir):
    c = chapters(spark, sf_dir).select("broadcast_id", F.col("n").alias("cell"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "doc_id")
    return gates.speech_coverage(c.drop("doc_id"), c.where("doc_id % 6 <> 5").select("broadcast_id", "cell", _pick(F.col("doc_id"), ("speech", "no-speech", "inconclusive")).alias("outcome")))


def music_like(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_orderkey", "case when l_returnflag = 'N' then 'dialogue-issue-signal' else 'short-loudness-burst' end as kind", "case when l_linenumber = 2 then l_orderkey end as chat_id", "l_linenumber as n_active", "l_linenumber as n_windows", "l_quantity / 50 as speech", "1 + l_discount * 4 as lift", "l_tax * 10 as loudness", "case when l_partkey % 5 > 0 then l_discount * 6 end as click", "l_tax * 6 as background")
    return fusion.music_like(e).groupBy("l_suppkey").agg(F.count_if("music_like").alias("n"))


def _case(column, values):
    return f"{list(values)}[{column} % {len(values)} + 1]"


QUERIES = {
    "verdict_gaps": (verdict_gaps, f"""WITH c AS (SELECT {_case('l_partkey', DECISIONS)} AS d, {_case('l_orderkey', MATERIALS)} AS m, {_case('l_linenumber', CONSISTENCIES)} AS k FROM lineitem),
      v AS (SELECT *, m = 'streamer-event' AND k = 'consistent' AS ok FROM c)
      SELECT d, m, k, CASE WHEN k = 'insufficient' THEN 'context-insufficient' WHEN d = 'uncertain' THEN CASE WHEN m = 'routine-or-unclear' THEN 'program-material-unclear' WHEN ok THEN 'detail-uncertain' ELSE 'detail-verdict-incoherent' END
        WHEN d = 'recommend' THEN CASE WHEN ok THEN NULL ELSE 'detail-verdict-incoherent' END WHEN k = 'conflict' THEN 'context-conflict' WHEN m = 'music-or-intermission' THEN 'program-material-excluded' WHEN m = 'routine-or-unclear' THEN 'program-material-unclear'
        WHEN ok THEN 'detail-not-recommended' ELSE 'detail-verdict-incoherent' END AS gap, count(*) AS n FROM v GROUP BY ALL"""),
    "range_problems": (range_problems, f"""WITH {CANDIDATES}, r AS (SELECT *, end_ms - peak_ms % 40000 + peak_ms % 7 * 9000 AS e FROM candidates)
      SELECT id, CASE WHEN start_ms < 0 OR start_ms >= e OR e > 3600000 THEN 'range_out_of_source' WHEN peak_ms < start_ms OR peak_ms > e THEN 'would_exclude_peak' WHEN e - start_ms < 30000 THEN 'duration_below_minimum' WHEN e - start_ms > 60000 THEN 'duration_above_maximum' END AS problem FROM r"""),
    "publication_gate": (publication_gate, f"""WITH {VIDEOS}, d AS (SELECT channel_id, CASE WHEN state = 'published' THEN 'done' WHEN attempts = 4 THEN 'failed' WHEN stage = 'context' THEN 'running' ELSE 'outstanding' END AS status, video_id % 50 <> 0 AS durable FROM videos),
      p AS (SELECT channel_id, count(*) FILTER (WHERE status = 'running') AS n_running, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'outstanding') AS n_outstanding, bool_and(durable) AS durable FROM d GROUP BY ALL) SELECT *, n_running + n_failed + n_outstanding = 0 AND durable AS ready FROM p"""),
    "enrollment_assets": (enrollment_assets, "SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 3 = 1"),
    "verification_cohort": (verification_cohort, f"WITH {CANDIDATES} SELECT id FROM candidates WHERE kind <> 'visual' AND (id % 3 = 0 OR id % 4 = 0)"),
    "effective_ranges": (effective_ranges, f"""WITH {CANDIDATES}, e AS (SELECT DISTINCT id, start_ms, end_ms, id % 2 = 0 AS edited, id % 2 = 0 AND id % 5 % 3 = id % 3 AS own FROM candidates)
      SELECT id, start_ms + CASE WHEN own THEN 1000 ELSE 0 END AS start_ms, end_ms - CASE WHEN own THEN 1000 ELSE 0 END AS end_ms, CASE WHEN own THEN 'edit' WHEN edited THEN 'stale-edit' ELSE 'proposal' END AS source FROM e"""),
    "settled_cells": (settled_cells, f"WITH {CHAPTERS} SELECT broadcast_id, CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'resolved' ELSE 'gap' END AS status, count(*) AS cells FROM chapters GROUP BY ALL"),
    "queue_parts": (queue_parts, f"WITH {VIDEOS} SELECT video_id, CASE WHEN video_id % 10 = 0 THEN 'active' WHEN video_id % 5 = 0 THEN 'assigned' WHEN next_at IS NULL OR next_at <= TIMESTAMP '1998-06-01' THEN 'startable' ELSE 'scheduled' END AS part FROM videos WHERE state <> 'published'"),
    "clip_frames": (clip_frames, f"WITH {CANDIDATES} SELECT id, '4500,16650,28349,40499' AS frames, greatest(1, CAST(floor(peak_ms / 5000 + 0.5) AS BIGINT)) AS samples FROM candidates"),
    "event_windows": (event_windows, f"""WITH {CANDIDATES}, w AS (SELECT broadcast_id, id, unnest(['before', 'near', 'after']) AS phase, unnest([peak_ms - 15000, peak_ms - 5000, peak_ms + 5000]) AS s FROM candidates), c AS (SELECT broadcast_id, id, phase, greatest(0, least(s, 3590000)) AS start_ms FROM w)
      SELECT *, start_ms + 10000 AS end_ms FROM c QUALIFY row_number() OVER (PARTITION BY broadcast_id, id, start_ms ORDER BY CASE phase WHEN 'near' THEN 0 WHEN 'before' THEN 1 ELSE 2 END) = 1"""),
    "unfinished_jobs": (unfinished_jobs, "SELECT o_custkey AS owner, o_orderkey AS job_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 100 DESC, o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderstatus NOT IN ('F', 'P')"),
    "cost_envelopes": (cost_envelopes, f"""WITH {CHAPTERS}, s AS (SELECT broadcast_id, count(*) * 120 AS sec, count(*) AS images, CAST(ceil(sum(length(text)) / 2) AS BIGINT) AS half FROM chapters GROUP BY ALL), t AS (SELECT *, sec * 25 + images * 258 + half AS tokens FROM s)
      SELECT broadcast_id, sec AS speech_seconds, tokens, {rounded('cost', '(sec * 0.0001::DOUBLE + tokens * 0.0000003::DOUBLE) * 1.2')}, (sec * 0.0001::DOUBLE + tokens * 0.0000003::DOUBLE) * 1.2 <= 1.0 AS within FROM t"""),
    "speech_coverage": (speech_coverage, f"""WITH {CHAPTERS}, o AS (SELECT broadcast_id, CASE WHEN doc_id % 6 = 5 THEN 'missing' ELSE ['speech', 'no-speech', 'inconclusive'][doc_id % 3 + 1] END AS o FROM chapters)
      SELECT broadcast_id, count(*) AS n_planned, count(*) FILTER (WHERE o = 'speech') AS n_speech, count(*) FILTER (WHERE o = 'no-speech') AS n_silent, count(*) FILTER (WHERE o = 'inconclusive') AS n_inconclusive, count(*) FILTER (WHERE o = 'missing') AS n_missing, count(*) FILTER (WHERE o = 'speech') * 120000 AS speech_ms FROM o GROUP BY ALL"""),
    "music_like": (music_like, "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linenumber <> 2 AND l_linenumber >= 1 AND l_quantity / 50 BETWEEN 0.55 AND 0.78 AND 1 + l_discount * 4 <= 1.2 AND l_tax * 10 <= 0.5 AND l_partkey % 5 > 0 AND l_discount * 6 <= 0.45 AND l_tax * 6 <= 0.35) AS n FROM lineitem GROUP BY ALL"),
}
