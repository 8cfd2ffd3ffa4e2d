"""Queries of the audio operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import audio
from .chat import DISJOINT, greedy_sql
from .tables import AUDIO, audio_durations, audio_windows, read, rounded

R6 = lambda c: N.round_half_up(F.col(c), 6).alias(c)


def audio_scores(spark, sf_dir):
    kept = ["rms_base", "rms_mad", "lift_db", "peak_lift_db", "crest_db", "vocal", "click", "score"]
    return audio.score(audio_windows(spark, sf_dir)).select("broadcast_id", "i", *map(R6, kept), "silence", "impulse", "dialogue", "active", "support")


def audio_clusters(spark, sf_dir):
    found = audio.clusters(audio.score(audio_windows(spark, sf_dir)))
    return found.groupBy("broadcast_id", "cluster").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_windows"), F.count_if("active").alias("n_active")).drop("cluster")


def audio_events(spark, sf_dir):
    windows = audio_windows(spark, sf_dir)
    found = audio.events(audio.score(windows), audio_durations(spark, sf_dir))
    return found.select("broadcast_id", F.col("apex.i").alias("apex"), "first_ms", "last_ms", "n_active", "plateau_ms", *map(R6, ("rms_range", "vocal_share", "background", "score")), "verdict", "kind")


def audio_highlights(spark, sf_dir):
    windows = audio_windows(spark, sf_dir)
    return audio.select_highlights(windows, audio_durations(spark, sf_dir)).select("broadcast_id", "pick", "peak_ms", "start_ms", "end_ms", "kind", "score")


def audio_diagnostics(spark, sf_dir):
    windows = audio_windows(spark, sf_dir)
    found = audio.diagnostics(audio.score(windows), audio_durations(spark, sf_dir))
    return found.select("broadcast_id", "n_windows", R6("median_rms"), R6("median_peak"), "n_silence", "n_impulse", "coverage_complete")


def audio_source_report(spark, sf_dir):
    """All that diagnostics tells; the SQL of audio_diagnostics names fewer columns."""
    found = audio.diagnostics(audio.score(audio_windows(spark, sf_dir)), audio_durations(spark, sf_dir))
    return found.select("broadcast_id", "n_windows", "median_window_ms", R6("median_rms"), R6("median_peak"), "n_silence", "n_impulse", "n_suppressed", "n_eligible", "coverage_complete")


def audio_crest(spark, sf_dir):
    return audio.crest_report(audio.score(audio_windows(spark, sf_dir))).select("broadcast_id", *map(R6, ("p50", "p90", "p95", "high_share")))


def audio_peak_distribution(spark, sf_dir):
    windows = audio_windows(spark, sf_dir)
    durations = audio_durations(spark, sf_dir)
    found = audio.peak_distribution(audio.select_highlights(windows, durations), durations)
    return found.select("broadcast_id", "q1", "q2", "q3", "q4", R6("span"), "largest_gap_ms", "one_half")


def audio_audible(spark, sf_dir):
    return audio.is_audible(audio_windows(spark, sf_dir)).select("broadcast_id", R6("active_share"), "audible")


DB = "greatest(-100.0::DOUBLE, 20 * log10(greatest(0.00001::DOUBLE, {})))"
FEATURES = (("rms", 0.005), ("peak", 0.01), ("zcr", 0.015), ("speech", 0.015))
SCORED = f"""{AUDIO},
centred AS (SELECT *, (start_ms + end_ms) // 2 AS center_ms FROM audio),
local AS (SELECT *, {", ".join(f"list_concat(coalesce(list({f}) OVER p, []), coalesce(list({f}) OVER n, [])) AS l_{f}" for f, _ in FEATURES)} FROM centred
  WINDOW p AS (PARTITION BY broadcast_id ORDER BY center_ms RANGE BETWEEN 120000 PRECEDING AND 8001 PRECEDING), n AS (PARTITION BY broadcast_id ORDER BY center_ms RANGE BETWEEN 8001 FOLLOWING AND 120000 FOLLOWING)),
few AS (SELECT a.broadcast_id, a.i, {", ".join(f"list(b.{f}) AS r_{f}" for f, _ in FEATURES)} FROM local a JOIN centred b ON a.broadcast_id = b.broadcast_id AND a.i <> b.i AND abs(a.center_ms - b.center_ms) > 2000 WHERE len(a.l_rms) < 6 GROUP BY ALL),
based AS (SELECT l.*, {", ".join(f"CASE WHEN len(l_rms) >= 6 THEN l_{f} ELSE coalesce(r_{f}, [{f}]) END AS b_{f}" for f, _ in FEATURES)} FROM local l LEFT JOIN few USING (broadcast_id, i)),
medians AS (SELECT *, {", ".join(f"list_median(b_{f}) AS {f}_base" for f, _ in FEATURES)} FROM based),
mads AS (SELECT *, {", ".join(f"list_median(list_transform(b_{f}, lambda x: abs(x - {f}_base))) AS {f}_mad" for f, _ in FEATURES)} FROM medians),
robust AS (SELECT *, {", ".join(f"least(8.0, greatest(-3.0, ({f} - {f}_base) / greatest({v}, 1.4826 * {f}_mad)))::DOUBLE AS {f}_score" for f, v in FEATURES)},
  {DB.format("rms")} AS rms_db, {DB.format("peak")} AS peak_db, {DB.format("rms_base")} AS base_db, {DB.format("peak_base")} AS peak_base_db FROM mads),
lifts AS (SELECT *, rms_db - base_db AS lift_db, peak_db - peak_base_db AS peak_lift_db, peak_db - rms_db AS crest_db, abs(zcr_score) AS zcr_news, greatest(0.0, speech_score) AS speech_news, rms <= 0.0025 AND peak <= 0.015 AS silence,
  coalesce((lag(end_ms) OVER w = start_ms) AND lag(rms_db) OVER w - base_db >= 2.5, false) OR coalesce((lead(start_ms) OVER w = end_ms) AND lead(rms_db) OVER w - base_db >= 2.5, false) AS supported
  FROM robust WINDOW w AS (PARTITION BY broadcast_id ORDER BY i)),
flags AS (SELECT *, least(8.0, speech_news * 0.7 + zcr_news * 0.3)::DOUBLE AS vocal, least(1.0, greatest(0.0, (crest_db - 10) / 8))::DOUBLE AS click, NOT silence AND lift_db >= 5 AND peak_lift_db >= 3 AND rms_score >= 2 AS elevated, crest_db >= 14 AND speech < 0.55 AS sharp FROM lifts),
flags2 AS (SELECT *, elevated AND sharp AND NOT supported AS impulse, NOT silence AND NOT elevated AND speech >= 0.42 AND speech_news >= 2.25 AND zcr_news >= 1.05 AND crest_db >= 6 AND crest_db < 14 AS dialogue FROM flags),
flags3 AS (SELECT *, (elevated AND NOT sharp) OR dialogue AS active FROM flags2),
scored AS MATERIALIZED (SELECT *, active OR (NOT silence AND NOT impulse AND lift_db >= 2.5 AND rms_score >= 1) AS support, greatest(0.0, rms_score) * 1.1 + least(4.0, greatest(0.0, peak_score)) * 0.35 + vocal * 0.25 + least(1.0, lift_db / 12) - click
  + CASE WHEN dialogue THEN least(2.0, speech_news) * 0.18 ELSE 0 END AS score FROM flags3)"""
CLUSTERED = f"""{SCORED},
broken AS (SELECT *, CASE WHEN NOT support OR NOT coalesce(lag(support) OVER w, false) OR start_ms - lag(end_ms) OVER w > 2000 THEN 1 ELSE 0 END AS b FROM scored WINDOW w AS (PARTITION BY broadcast_id ORDER BY i)),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY broadcast_id ORDER BY i) AS cluster FROM broken),
member AS (SELECT * FROM numbered WHERE support QUALIFY bool_or(active) OVER (PARTITION BY broadcast_id, cluster))"""
EVENTS = f"""{CLUSTERED},
per AS (SELECT broadcast_id, cluster, min(start_ms) AS first_ms, max(end_ms) AS last_ms, count(*) AS n_windows, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE active AND dialogue) AS n_dialogue,
  bool_or(active AND rms_score >= 2 AND lift_db >= 5 AND peak_lift_db >= 3) AS dynamic, bool_or(active AND speech >= 0.4) AS voiced, bool_or(active AND speech >= 0.55) AS distinct_voice FROM member GROUP BY ALL),
apex AS (SELECT broadcast_id, cluster, i AS apex, center_ms, score AS apex_score, base_db + 3 AS lim, vocal AS apex_vocal, dialogue AS apex_dialogue, click AS apex_click, speech AS apex_speech FROM member WHERE active
  QUALIFY row_number() OVER (PARTITION BY broadcast_id, cluster ORDER BY score DESC, center_ms) = 1),
ends AS (SELECT a.broadcast_id, a.cluster, coalesce(max(s.i) FILTER (WHERE s.i < a.apex AND s.rms_db < a.lim), -1) AS low, coalesce(min(s.i) FILTER (WHERE s.i > a.apex AND s.rms_db < a.lim), 1000000) AS high FROM apex a JOIN scored s USING (broadcast_id) GROUP BY ALL),
flat AS (SELECT e.broadcast_id, e.cluster, max(end_ms) - min(start_ms) AS plateau_ms, max(rms_db) - min(rms_db) AS rms_range, max(zcr) - min(zcr) AS zcr_range, max(speech) - min(speech) AS speech_range, count(*) AS n_speech, count(*) FILTER (WHERE speech >= 0.4) / count(*) AS vocal_share
  FROM ends e JOIN scored s ON e.broadcast_id = s.broadcast_id AND s.i > low AND s.i < high GROUP BY ALL),
lengths AS (SELECT broadcast_id, max(end_ms) AS duration_ms FROM audio GROUP BY ALL),
joined AS (SELECT *, least(1.0, greatest(0.0, plateau_ms / 12000 * (1 - least(1.0, greatest(0.0, rms_range / 4))) * (1 - vocal_share))) AS background FROM per JOIN apex USING (broadcast_id, cluster) JOIN flat USING (broadcast_id, cluster) JOIN lengths USING (broadcast_id)),
judged AS (SELECT *, CASE WHEN plateau_ms >= 12000 AND ((rms_range < 2.5 AND vocal_share < 0.4) OR (n_active >= 3 AND rms_range <= 4 AND n_speech >= 3 AND speech_range <= 0.12 AND zcr_range <= 0.08)) THEN 'sustained-background'
  WHEN ((n_active >= 2 AND rms_range >= 2 AND dynamic) OR voiced) AND (NOT (center_ms < 90000 OR duration_ms - center_ms < 90000) OR distinct_voice)
    AND (n_active >= 2 OR ((apex_dialogue OR apex_vocal >= 1.5) AND (apex_click < 0.5 OR apex_speech >= 0.55))) THEN 'event' ELSE 'none' END AS verdict,
  CASE WHEN n_dialogue >= ceil(n_active / 2) THEN 'dialogue-issue-signal' WHEN last_ms - first_ms >= 3000 AND n_active >= 3 AND (vocal_share >= 0.4 OR rms_range >= 2) THEN 'sustained-vocal-reaction' ELSE 'short-loudness-burst' END AS kind,
  apex_score + ln(1 + n_active) * 0.7 + vocal_share * 0.8 - background * 1.5 AS score FROM joined)"""
HIGHLIGHTS = f"""{EVENTS},
found AS (SELECT broadcast_id, kind, center_ms AS peak_ms, duration_ms, score AS raw, least(45000, duration_ms) AS width FROM judged WHERE verdict = 'event'),
placed AS (SELECT *, greatest(0, least(peak_ms - CAST(floor(width * 0.6 + 0.5) AS BIGINT), duration_ms - width)) AS s, 0 AS a, 0 AS b FROM found),
spans AS (SELECT *, s + width AS e FROM placed),
{greedy_sql("chosen", "spans", "raw DESC, peak_ms, kind", 96, DISJOINT)},
kept AS (SELECT * FROM chosen WHERE pick <= greatest(24, least(96, ceil(duration_ms / 3600000 * 6))))"""

def audio_features(spark, sf_dir):
    """Windows from samples: a second of two channels at 64 Hz for each embedding; every 9th second is missing."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    chunks = read(spark, sf_dir, "embeddings").select(F.col("label").alias("broadcast_id"), i.alias("i"), F.array("embedding", F.reverse("embedding")).alias("channels"))
    return audio.windows_from_samples(chunks.where("i % 9 <> 4"), 64)


QUERIES = {
    "audio_features": (audio_features, None),
    "audio_scores": (audio_scores, f"WITH {SCORED} SELECT broadcast_id, i, {', '.join(rounded(c, c) for c in ('rms_base', 'rms_mad', 'lift_db', 'peak_lift_db', 'crest_db', 'vocal', 'click', 'score'))}, silence, impulse, dialogue, active, support FROM scored"),
    "audio_clusters": (audio_clusters, f"WITH {CLUSTERED} SELECT broadcast_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_windows, count(*) FILTER (WHERE active) AS n_active FROM member GROUP BY broadcast_id, cluster"),
    "audio_events": (audio_events, f"WITH {EVENTS} SELECT broadcast_id, apex, first_ms, last_ms, n_active, plateau_ms, {', '.join(rounded(c, c) for c in ('rms_range', 'vocal_share', 'background', 'score'))}, verdict, kind FROM judged"),
    "audio_highlights": (audio_highlights, f"WITH RECURSIVE {HIGHLIGHTS} SELECT broadcast_id, CAST(pick AS INTEGER) AS pick, peak_ms, s AS start_ms, e AS end_ms, kind, {rounded('score', 'raw')} FROM kept"),
    "audio_diagnostics": (audio_diagnostics, f"WITH {SCORED} SELECT broadcast_id, count(*) AS n_windows, {rounded('median_rms', 'median(rms)')}, {rounded('median_peak', 'median(peak)')}, count(*) FILTER (WHERE silence) AS n_silence, count(*) FILTER (WHERE impulse) AS n_impulse, true AS coverage_complete FROM scored GROUP BY ALL"),
    "audio_source_report": (audio_source_report, f"""WITH {EVENTS}, verdicts AS (SELECT broadcast_id, count(*) FILTER (WHERE verdict = 'sustained-background') AS s, count(*) FILTER (WHERE verdict = 'event') AS e FROM judged GROUP BY ALL),
      touching AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY broadcast_id ORDER BY i) = start_ms, true) AS t FROM scored),
      measured AS (SELECT broadcast_id, count(*) AS n_windows, CAST(floor(median(end_ms - start_ms) + 0.5) AS BIGINT) AS median_window_ms, {rounded('median_rms', 'median(rms)')}, {rounded('median_peak', 'median(peak)')}, count(*) FILTER (WHERE silence) AS n_silence, count(*) FILTER (WHERE impulse) AS n_impulse,
        bool_and(t) AND min(start_ms) = 0 AS whole, max(end_ms) AS last_ms FROM touching GROUP BY ALL)
      SELECT broadcast_id, n_windows, median_window_ms, median_rms, median_peak, n_silence, n_impulse, coalesce(s, 0) AS n_suppressed, coalesce(e, 0) AS n_eligible, whole AND last_ms = duration_ms AND n_windows = ceil(duration_ms / median_window_ms) AS coverage_complete
      FROM measured JOIN lengths USING (broadcast_id) LEFT JOIN verdicts USING (broadcast_id)"""),
    "audio_crest": (audio_crest, f"WITH {SCORED} SELECT broadcast_id, {rounded('p50', 'quantile_cont(crest_db, 0.5)')}, {rounded('p90', 'quantile_cont(crest_db, 0.9)')}, {rounded('p95', 'quantile_cont(crest_db, 0.95)')}, {rounded('high_share', 'count(*) FILTER (WHERE crest_db >= 14) / count(*)')} FROM scored GROUP BY ALL"),
    "audio_peak_distribution": (audio_peak_distribution, f"""WITH RECURSIVE {HIGHLIGHTS}, gaps AS (SELECT *, peak_ms - coalesce(lag(peak_ms) OVER (PARTITION BY broadcast_id ORDER BY peak_ms), 0) AS gap, least(3, peak_ms * 4 // duration_ms) AS q FROM kept),
      counted AS (SELECT broadcast_id, {', '.join(f'count(*) FILTER (WHERE q = {k}) AS q{k + 1}' for k in range(4))}, {rounded('span', '(max(peak_ms) - min(peak_ms)) / max(duration_ms)')}, greatest(max(gap), max(duration_ms) - max(peak_ms)) AS largest_gap_ms FROM gaps GROUP BY ALL)
      SELECT *, q1 + q2 = 0 OR q3 + q4 = 0 AS one_half FROM counted"""),
    "audio_audible": (audio_audible, f"WITH {AUDIO} SELECT broadcast_id, {rounded('active_share', 'count(*) FILTER (WHERE rms >= 0.004 AND peak >= 0.02) / count(*)')}, count(*) FILTER (WHERE rms >= 0.004 AND peak >= 0.02) / count(*) >= 0.01 AS audible FROM audio GROUP BY ALL"),
}
