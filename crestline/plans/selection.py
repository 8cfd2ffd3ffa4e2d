"""Queries of selection, pictures and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import identity, selection, speakers, visual, voice_search
from .chat import DISJOINT, greedy_sql
from .tables import CANDIDATES, CHAPTERS, FRAMES, MESSAGES, candidates, chapters, durations, frames, hours, messages, read, rounded

R6 = lambda c: N.round_half_up(F.col(c), 6).alias(c)
ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def _density(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    points = msgs.where("text in ('purchase', 'error')").select("broadcast_id", F.col("ts_ms").alias("t_ms"))
    return selection.event_density(points, durations(msgs))


def event_density(spark, sf_dir):
    return _density(spark, sf_dir).select("broadcast_id", "bin", "n", *map(R6, ("expected", "tail")), "density", *map(R6, ("mean", "variance", "dispersion")))


def block_quotas(spark, sf_dir):
    return selection.block_quotas(_density(spark, sf_dir)).select("broadcast_id", "block", R6("expected"), R6("quota"))


def _episodes(spark, sf_dir):
    return selection.build_episodes(candidates(spark, sf_dir).withColumn("key", (F.col("peak_ms") % 17).cast("string")))


def episodes(spark, sf_dir):
    return _episodes(spark, sf_dir).select("broadcast_id", "episode", "start_ms", "end_ms", "representative", "peak_ms", ids("ids"), F.array_join("kinds", "+").alias("kinds"))


def episode_quality(spark, sf_dir):
    return selection.minmax_quality(_episodes(spark, sf_dir)).select("broadcast_id", "representative", R6("quality"))


def episode_similarity(spark, sf_dir):
    return selection.episode_similarity(_episodes(spark, sf_dir)).where("similarity > 0.000001").select("broadcast_id", "episode", "other", R6("similarity"))


def diverse_selection(spark, sf_dir):
    found = candidates(spark, sf_dir)
    quotas = selection.block_quotas(selection.event_density(found.select("broadcast_id", F.col("peak_ms").alias("t_ms")), hours(found)))
    marked = _episodes(spark, sf_dir).withColumn("eligible", F.col("representative") % 7 > 0).withColumn("recommended", F.col("representative") % 5 == 0)
    return selection.select_diverse(marked, quotas)


def evidence_ranking(spark, sf_dir):
    found = candidates(spark, sf_dir)
    part = lambda k, d: F.when(F.col("id") % 3 != k, F.least(F.lit(1.0), F.col("score") / d))
    evidence = found.select("broadcast_id", "id", "peak_ms", part(0, 1).alias("audio"), part(1, 2).alias("chat"), part(2, 3).alias("visual"), ((F.col("peak_ms") % 3) / 2).alias("strength"))
    from pyspark.sql import Window as W

    evidence = evidence.withColumn("previous", F.row_number().over(W.partitionBy("broadcast_id").orderBy("peak_ms", "id")))
    return selection.rank_by_evidence(evidence).select("id", "audio_points", "chat_points", "visual_points", "agreement", "total", "ordinal", "moved", F.array_join("reasons", "+").alias("reasons"))


def even_slices(spark, sf_dir):
    return selection.even_slices(chapters(spark, sf_dir), ["broadcast_id"], "n", 6).select("doc_id", "slice")


def spread_sample(spark, sf_dir):
    return selection.spread_sample(chapters(spark, sf_dir), ["broadcast_id"], "n", 9).select("doc_id")


def detail_targets(spark, sf_dir):
    return selection.top_per_group(candidates(spark, sf_dir), ["broadcast_id"], [F.desc("score"), F.asc("peak_ms"), F.asc("id")], 12).select("broadcast_id", "id", "pick")


def bounded_peaks(spark, sf_dir):
    return selection.bounded_peaks(candidates(spark, sf_dir)).select("broadcast_id", "peak_ms", "pick")


def task_batches(spark, sf_dir):
    found = candidates(spark, sf_dir)
    return selection.batches(found, found.where("kind = 'visual'").select("broadcast_id", "id"), [F.desc("score"), F.asc("id")]).select("id", "batch")


def _frame_ends(found):
    return found.groupBy("broadcast_id").agg((F.max("ts_ms") + 5000).alias("duration_ms"))


def scene_changes(spark, sf_dir):
    return visual.score_scenes(visual.scene_changes(frames(spark, sf_dir))).select("broadcast_id", "ts_ms", *map(R6, ("mean_change", "changed_share", "strength", "robust")), "eligible")


def scene_highlights(spark, sf_dir):
    found = frames(spark, sf_dir)
    return visual.scene_highlights(found, _frame_ends(found)).select("broadcast_id", "pick", "peak_ms", "start_ms", "end_ms", R6("score"))


def frame_descriptors(spark, sf_dir):
    return visual.describe(frames(spark, sf_dir))


def visual_seeds(spark, sf_dir):
    return visual.visual_seeds(visual.describe(frames(spark, sf_dir))).select("broadcast_id", "ts_ms", "change", "pick")


def _identity(spark, sf_dir):
    """Videos with 12 anchors each, and the same pictures as broadcasts: sampled up to two seconds late, and with a share
    of their blocks inverted that differs by label, from none to half."""
    shown = frames(spark, sf_dir)
    ends = shown.groupBy("broadcast_id").agg(F.count("*").alias("n"), (F.max("ts_ms") + 5000).alias("duration_ms"))
    described = visual.describe(shown).withColumn("i", F.col("ts_ms") / 5000).join(ends, "broadcast_id")
    anchor = F.floor(F.col("i") * 12 / F.col("n"))
    anchors = described.where((F.col("i") == 0) | (anchor > F.floor((F.col("i") - 1) * 12 / F.col("n")))).select(F.col("broadcast_id").alias("video_id"), anchor.cast("int").alias("anchor"), "ts_ms", "dhash", "blockhash", "mean_luma", "duration_ms")
    every = (F.lit(2) + F.col("broadcast_id") * 3).cast("int")
    noisy = F.transform("luma", lambda x, i: F.when((F.col("broadcast_id") % 4 != 3) & ((i + F.col("vec_id")) % every == 0), 255 - x).otherwise(x))
    samples = visual.describe(shown.select("broadcast_id", (F.col("ts_ms") + F.col("vec_id") % 3 * 1000).alias("ts_ms"), noisy.alias("luma")))
    pairs = identity.compatible_pairs(ends.select(F.col("broadcast_id").alias("video_id"), "duration_ms"), ends.select("broadcast_id", "duration_ms"))
    return anchors, samples, pairs, ends


def fingerprint_matches(spark, sf_dir):
    anchors, samples, pairs, _ = _identity(spark, sf_dir)
    return identity.match_offsets(anchors, samples, pairs)


def fingerprint_decisions(spark, sf_dir):
    anchors, samples, pairs, _ = _identity(spark, sf_dir)
    return identity.decide(identity.match_offsets(anchors, samples, pairs), samples)


def fingerprint_identity(spark, sf_dir):
    anchors, samples, pairs, ends = _identity(spark, sf_dir)
    return identity.unique_match(ends, identity.decide(identity.match_offsets(anchors, samples, pairs, [0]), samples))


def sample_times(spark, sf_dir):
    return visual.sample_times(_frame_ends(frames(spark, sf_dir)))


def _voices(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return speakers.score(vectors.select(F.col("vec_id").alias("id"), "embedding"), speakers.prototypes(vectors.select("label", "embedding")))


def speaker_scores(spark, sf_dir):
    return _voices(spark, sf_dir).select("id", "label", R6("score"))


def _best_voices(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return voice_search.best_two(vectors.select(F.col("vec_id").alias("id"), "embedding"), speakers.prototypes(vectors.select("label", "embedding")))


def speaker_best_two(spark, sf_dir):
    return _best_voices(spark, sf_dir).select("id", "label", R6("score"), "place")


def speaker_identity(spark, sf_dir):
    return voice_search.identify(_best_voices(spark, sf_dir), 0.2, 0.05).select("id", "label", R6("score"), "verdict")


def speaker_consistency(spark, sf_dir):
    return voice_search.consistency(read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding")).select("label", "n_pairs", R6("mean_cosine"), R6("least_cosine"))


def speech_cells(spark, sf_dir):
    logits = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("cell"), F.col("vec_id").alias("frame"), F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double")).alias("logits"))
    return speakers.speech_cells(logits).select("cell", "winner", "duration_ms", R6("least_confidence"), R6("mean_confidence"))


DENSITY = f"""{MESSAGES},
axis AS (SELECT broadcast_id, CAST(unnest(range(0, 12)) AS INTEGER) AS bin FROM (SELECT DISTINCT broadcast_id FROM messages)),
hits AS (SELECT broadcast_id, CAST(ts_ms // 300000 AS INTEGER) AS bin, count(*) AS n FROM messages WHERE text IN ('purchase', 'error') GROUP BY ALL),
dense AS (SELECT broadcast_id, bin, coalesce(n, 0) AS n FROM axis LEFT JOIN hits USING (broadcast_id, bin)),
smooth AS (SELECT *, avg(n) OVER p AS mean, var_pop(n) OVER p AS variance, coalesce(lag(n) OVER o, n) AS b, coalesce(lead(n) OVER o, n) AS a FROM dense WINDOW p AS (PARTITION BY broadcast_id), o AS (PARTITION BY broadcast_id ORDER BY bin)),
expect AS (SELECT *, (mean * 2 + 0.25 * b + 0.5 * n + 0.25 * a) / 3 AS expected FROM smooth),
density AS (SELECT *, CASE WHEN expected > 0 AND n > expected THEN greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(0, n), lambda k: exp(k * ln(expected) - expected - lgamma(k + 1)))))) END AS tail FROM expect)"""
KIND = "CASE WHEN CASE WHEN expected > 0 THEN tail IS NOT NULL AND (tail < 0.05 OR n / expected >= 2.5) ELSE n > 0 END THEN 'burst' WHEN CASE WHEN expected > 0 THEN n < expected * 0.5 ELSE n = 0 END THEN 'quiet' ELSE 'normal' END AS density"
QUOTAS = f"""{DENSITY}, per AS (SELECT broadcast_id, CAST(least(3, floor((bin * 300000 + (bin + 1) * 300000) / 2 / 900000)) AS INTEGER) AS block, sum(expected) AS expected FROM density GROUP BY ALL)"""
EPISODES = f"""{CANDIDATES}, ordered AS MATERIALIZED (SELECT *, CAST(peak_ms % 17 AS VARCHAR) AS key, row_number() OVER (PARTITION BY broadcast_id ORDER BY start_ms, peak_ms, id) AS rn FROM candidates),
fold AS (SELECT broadcast_id, 0::BIGINT AS rn, []::STRUCT(s BIGINT, e BIGINT, r BIGINT, p BIGINT, score DOUBLE, ids BIGINT[], kinds VARCHAR[], keys VARCHAR[])[] AS acc FROM (SELECT DISTINCT broadcast_id FROM candidates)
  UNION ALL SELECT f.broadcast_id, r.rn, CASE WHEN k.k IS NULL THEN list_append(f.acc, {{'s': r.start_ms, 'e': r.end_ms, 'r': r.id, 'p': r.peak_ms, 'score': r.score, 'ids': [r.id], 'kinds': [r.kind], 'keys': [r.key]}})
    ELSE list_transform(f.acc, lambda a, i: CASE WHEN i = k.k THEN {{'s': least(a.s, r.start_ms), 'e': greatest(a.e, r.end_ms), 'r': CASE WHEN r.score > a.score OR (r.score = a.score AND (r.peak_ms, r.id) < (a.p, a.r)) THEN r.id ELSE a.r END,
      'p': CASE WHEN r.score > a.score OR (r.score = a.score AND (r.peak_ms, r.id) < (a.p, a.r)) THEN r.peak_ms ELSE a.p END, 'score': greatest(a.score, r.score), 'ids': list_append(a.ids, r.id), 'kinds': list_append(a.kinds, r.kind), 'keys': list_append(a.keys, r.key)}} ELSE a END) END
  FROM fold f JOIN ordered r ON r.broadcast_id = f.broadcast_id AND r.rn = f.rn + 1,
  LATERAL (SELECT list_max(list_filter(list_transform(f.acc, lambda a, i: CASE WHEN greatest(a.e, r.end_ms) - least(a.s, r.start_ms) <= 90000 AND (greatest(0, least(a.e, r.end_ms) - greatest(a.s, r.start_ms)) >= 0.35 * greatest(1, least(a.e - a.s, r.end_ms - r.start_ms))
    OR (least(a.e, r.end_ms) > greatest(a.s, r.start_ms) AND abs(r.peak_ms - a.p) <= 30000) OR (list_contains(a.keys, r.key) AND r.start_ms - a.e <= 90000)) THEN i END), lambda x: x IS NOT NULL)) AS k) k),
last AS (SELECT f.broadcast_id, f.acc FROM fold f JOIN (SELECT broadcast_id, max(rn) AS rn FROM ordered GROUP BY ALL) USING (broadcast_id, rn)),
episodes AS MATERIALIZED (SELECT broadcast_id, CAST(generate_subscripts(acc, 1) - 1 AS INTEGER) AS episode, unnest(acc) AS c FROM last)"""
SCENES = f"""{FRAMES},
lagged AS (SELECT *, lag(luma) OVER w AS p, lag(ts_ms) OVER w AS previous_ms FROM frames WINDOW w AS (PARTITION BY broadcast_id ORDER BY ts_ms)),
diffs AS (SELECT *, list_transform(list_zip(luma, p), lambda z: abs(z[1] - z[2])) AS d FROM lagged WHERE p IS NOT NULL),
changes AS (SELECT broadcast_id, ts_ms, previous_ms, list_sum(d) / (len(d) * 255) AS mean_change, len(list_filter(d, lambda x: x >= 28)) / len(d) AS changed_share, mean_change * 0.65 + changed_share * 0.35 AS strength FROM diffs),
bases AS (SELECT broadcast_id, median(strength) AS base, count(*) AS n FROM changes GROUP BY ALL),
mads AS (SELECT broadcast_id, any_value(base) AS base, any_value(n) AS n, greatest(0.01, 1.4826 * median(abs(strength - base))) AS scale FROM changes JOIN bases USING (broadcast_id) GROUP BY ALL),
scored AS (SELECT *, (strength - base) / scale AS robust, strength > CASE WHEN n >= 4 THEN greatest(0.08, base + greatest(3 * scale, 0.04)) ELSE 0.08 END AND mean_change >= 0.04 AND changed_share >= 0.08 AND (n < 4 OR (strength - base) / scale >= 3) AS eligible FROM changes JOIN mads USING (broadcast_id))"""
def _described(source: str, name: str) -> str:
    """SQL: descriptors of the planes of a table, as table name."""
    return f"""bits_{name} AS (SELECT broadcast_id, vec_id, ts_ms, luma, list_median(luma) AS mid, list_transform(range(0, 64), lambda i: CASE WHEN CASE WHEN i % 8 = 7 THEN luma[i + 1] ELSE floor((luma[i + 1] + luma[i + 2]) / 2 + 0.5) END > CASE WHEN i % 8 = 0 THEN luma[i + 1] ELSE floor((luma[i] + luma[i + 1]) / 2 + 0.5) END THEN pow(2, 63 - i)::HUGEINT ELSE 0 END) AS d FROM {source}),
sums_{name} AS (SELECT broadcast_id, vec_id, ts_ms, list_sum(d)::HUGEINT AS d, list_sum(list_transform(luma, lambda x, i: CASE WHEN x > mid THEN pow(2, 64 - i)::HUGEINT ELSE 0 END))::HUGEINT AS b, CAST(floor(list_avg(luma) + 0.5) AS INTEGER) AS mean_luma,
  CAST(floor((list_sum(list_transform(range(1, 57), lambda i: abs(luma[i + 8] - luma[i]))) / 56 + list_sum(list_transform(range(1, 64), lambda i: CASE WHEN i % 8 = 0 THEN 0 ELSE abs(luma[i + 1] - luma[i]) END)) / 56) / 2 + 0.5) AS INTEGER) AS edge FROM bits_{name}),
{name} AS MATERIALIZED (SELECT broadcast_id, ts_ms, CAST(d - CASE WHEN d >= pow(2, 63)::HUGEINT THEN pow(2, 64)::HUGEINT ELSE 0 END AS BIGINT) AS dhash, CAST(b - CASE WHEN b >= pow(2, 63)::HUGEINT THEN pow(2, 64)::HUGEINT ELSE 0 END AS BIGINT) AS blockhash, mean_luma, edge FROM sums_{name})"""


DESCRIBED = f"{FRAMES}, {_described('frames', 'described')}"
MATCHES = f"""{DESCRIBED}, ends AS (SELECT broadcast_id, count(*) AS n, max(ts_ms) + 5000 AS duration_ms FROM frames GROUP BY ALL),
anchors AS (SELECT broadcast_id AS video_id, CAST(ts_ms // 5000 * 12 // n AS INTEGER) AS anchor, d.ts_ms, dhash, blockhash, mean_luma, duration_ms FROM described d JOIN ends USING (broadcast_id) WHERE d.ts_ms = 0 OR d.ts_ms // 5000 * 12 // n > (d.ts_ms // 5000 - 1) * 12 // n),
noisy AS (SELECT broadcast_id, vec_id, ts_ms + vec_id % 3 * 1000 AS ts_ms, list_transform(luma, lambda x, i: CASE WHEN broadcast_id % 4 <> 3 AND (i - 1 + vec_id) % (2 + broadcast_id * 3) = 0 THEN 255 - x ELSE x END) AS luma FROM frames),
{_described("noisy", "samples")},
fits AS (SELECT v.broadcast_id AS video_id, b.broadcast_id FROM ends v JOIN ends b ON abs(v.duration_ms - b.duration_ms) <= least(10000, greatest(2000, floor(v.duration_ms * 0.001::DOUBLE + 0.5)))),
grid AS (SELECT *, CAST(unnest(range(-30000, 35000, 5000)) AS INTEGER) AS offset_ms FROM fits JOIN anchors USING (video_id)),
seen AS (SELECT g.video_id, g.broadcast_id, g.offset_ms, g.anchor, CAST(least(2, floor(g.ts_ms / g.duration_ms * 3)) AS INTEGER) AS third, bit_count(xor(g.dhash, s.dhash)) AS h, bit_count(xor(g.blockhash, s.blockhash)) AS b, h <= 18 AND b <= 20 AND h + b <= 32 AND abs(g.mean_luma - s.mean_luma) <= 56 AS accepted
  FROM grid g JOIN samples s ON s.broadcast_id = g.broadcast_id AND abs(s.ts_ms - (g.ts_ms + g.offset_ms)) <= 2750),
best AS (SELECT *, h + b AS distance FROM seen QUALIFY row_number() OVER (PARTITION BY video_id, broadcast_id, offset_ms, anchor ORDER BY accepted DESC, h + b) = 1),
found AS (SELECT video_id, broadcast_id, offset_ms, count(*) AS n_evaluated, count(*) FILTER (WHERE accepted) AS n_matched, count(DISTINCT third) FILTER (WHERE accepted) AS n_thirds, median(distance) FILTER (WHERE accepted) AS median_distance, list_sort(list(distance) FILTER (WHERE accepted)) AS ds FROM best GROUP BY ALL),
matches AS (SELECT e.video_id, e.broadcast_id, e.offset_ms, e.n_anchors, coalesce(n_evaluated, 0) AS n_evaluated, coalesce(n_matched, 0) AS n_matched, coalesce(n_thirds, 0) AS n_thirds, median_distance, ds[CAST(ceil(n_matched * 0.9::DOUBLE) AS BIGINT)] AS p90_distance
  FROM (SELECT video_id, broadcast_id, offset_ms, count(*) AS n_anchors FROM grid GROUP BY ALL) e LEFT JOIN found USING (video_id, broadcast_id, offset_ms)),
sizes AS (SELECT broadcast_id, count(*) AS n_samples FROM samples GROUP BY ALL)"""
#: Decisions over the offsets that a condition leaves.
DECISIONS = lambda kept: f"""{MATCHES}, decisions AS (SELECT m.*, n_samples < 8 AS few, greatest(8, ceil(n_anchors * 0.67::DOUBLE)) AS needed, CASE WHEN few OR n_evaluated < needed THEN 'insufficient-local-samples' WHEN n_matched < needed THEN 'anchor-consensus-failed' WHEN n_thirds < 3 THEN 'insufficient-temporal-coverage'
    WHEN coalesce(median_distance <= 21 AND p90_distance <= 32, false) THEN 'multi-anchor-consensus' ELSE 'anchor-consensus-failed' END AS reason FROM matches m JOIN sizes USING (broadcast_id) WHERE {kept}
  QUALIFY row_number() OVER (PARTITION BY video_id, broadcast_id ORDER BY n_matched DESC, n_thirds DESC, median_distance ASC NULLS LAST, abs(offset_ms), offset_ms) = 1)"""  # noqa: E731
VOICES = """units AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
long AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM units),
means AS (SELECT label, i, avg(x) AS x FROM long GROUP BY ALL), protos AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY ALL),
voices AS (SELECT vec_id AS id, p.label, greatest(0.0, least(1.0, list_cosine_similarity(u, v))) AS score FROM units q, protos p)"""

QUERIES = {
    "event_density": (event_density, f"WITH {DENSITY} SELECT broadcast_id, bin, n, {rounded('expected', 'expected')}, {rounded('tail', 'tail')}, {KIND}, {rounded('mean', 'mean')}, {rounded('variance', 'variance')}, {rounded('dispersion', 'variance / nullif(mean, 0)')} FROM density"),
    "block_quotas": (block_quotas, f"WITH {QUOTAS} SELECT broadcast_id, block, {rounded('expected', 'expected')}, {rounded('quota', 'sqrt(expected + 0.25) / sum(sqrt(expected + 0.25)) OVER (PARTITION BY broadcast_id) * 12')} FROM per"),
    "episodes": (episodes, f"WITH RECURSIVE {EPISODES} SELECT broadcast_id, episode, c.s AS start_ms, c.e AS end_ms, c.r AS representative, c.p AS peak_ms, array_to_string(list_sort(c.ids), ',') AS ids, array_to_string(list_sort(list_distinct(c.kinds)), '+') AS kinds FROM episodes"),
    "episode_quality": (episode_quality, f"WITH RECURSIVE {EPISODES}, r AS (SELECT broadcast_id, c.r AS representative, c.score AS score, min(c.score) OVER w AS lo, max(c.score) OVER w AS hi FROM episodes WINDOW w AS (PARTITION BY broadcast_id)) SELECT broadcast_id, representative, {rounded('quality', 'least(1.0, greatest(0.0, CASE WHEN hi - lo > 2.220446049250313e-16 THEN (score - lo) / (hi - lo) ELSE score END))')} FROM r"),
    "episode_similarity": (episode_similarity, f"""WITH RECURSIVE {EPISODES}, p AS (SELECT a.broadcast_id, a.episode, b.episode AS other, greatest(greatest(0, least(a.c.e, b.c.e) - greatest(a.c.s, b.c.s)) / least(a.c.e - a.c.s, b.c.e - b.c.s),
      CASE WHEN list_has_any(a.c.keys, b.c.keys) THEN 0.8 WHEN list_has_any(a.c.kinds, b.c.kinds) THEN 0.2 ELSE 0.1 END * exp(-pow(abs(a.c.p - b.c.p) / 90000, 2))) AS similarity FROM episodes a JOIN episodes b ON a.broadcast_id = b.broadcast_id AND a.episode < b.episode)
      SELECT broadcast_id, episode, other, {rounded('similarity', 'similarity')} FROM p WHERE similarity > 0.000001"""),
    "diverse_selection": (diverse_selection, None),
    "evidence_ranking": (evidence_ranking, f"""WITH {CANDIDATES}, ev AS (SELECT *, CASE WHEN id % 3 <> 0 THEN least(1.0, score) END AS audio, CASE WHEN id % 3 <> 1 THEN least(1.0, score / 2) END AS chat, CASE WHEN id % 3 <> 2 THEN least(1.0, score / 3) END AS visual, (peak_ms % 3) / 2 AS strength, row_number() OVER (PARTITION BY broadcast_id ORDER BY peak_ms, id) AS previous FROM candidates),
      pts AS (SELECT *, greatest(floor(6000 * coalesce(audio, 0) + 0.5), floor(6000 * CASE WHEN strength = 0 THEN coalesce(audio, 0) WHEN coalesce(audio, 0) > 0 THEN audio + 0.1 * strength * (1 - audio) ELSE 0.35 * strength END + 0.5))::BIGINT AS audio_points,
        floor(3000 * coalesce(chat, 0) + 0.5)::BIGINT AS chat_points, floor(500 * coalesce(visual, 0) + 0.5)::BIGINT AS visual_points, (CASE WHEN audio IS NOT NULL AND chat IS NOT NULL THEN 500 ELSE 0 END)::BIGINT AS agreement FROM ev),
      ord AS (SELECT *, least(10000, audio_points + chat_points + visual_points + agreement) AS total FROM pts)
      SELECT id, audio_points, chat_points, visual_points, agreement, total, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY total DESC, previous, peak_ms, id) AS INTEGER) AS ordinal, row_number() OVER (PARTITION BY broadcast_id ORDER BY total DESC, previous, peak_ms, id) <> previous AS moved,
        concat_ws('+', CASE WHEN audio IS NOT NULL THEN 'audio' END, CASE WHEN strength > 0 THEN 'sound-event' END, CASE WHEN chat IS NOT NULL THEN 'chat' END, CASE WHEN visual IS NOT NULL THEN 'picture' END, CASE WHEN agreement > 0 THEN 'agreement' END) AS reasons FROM ord"""),
    "even_slices": (even_slices, f"WITH {CHAPTERS}, s AS (SELECT *, count(*) OVER (PARTITION BY broadcast_id) AS size FROM chapters), b AS (SELECT doc_id, n, size, unnest(range(0, least(6, size))) AS k FROM s) SELECT doc_id, CAST(max(k) AS INTEGER) AS slice FROM b WHERE n >= floor(k * size / least(6, size)) GROUP BY doc_id"),
    "spread_sample": (spread_sample, f"WITH {CHAPTERS}, s AS (SELECT *, count(*) OVER (PARTITION BY broadcast_id) AS size FROM chapters) SELECT doc_id FROM s WHERE size <= 9 OR n IN (SELECT floor(i * (size - 1) / 8 + 0.5) FROM range(0, 9) t(i))"),
    "detail_targets": (detail_targets, f"WITH {CANDIDATES} SELECT broadcast_id, id, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY score DESC, peak_ms, id) AS INTEGER) AS pick FROM candidates QUALIFY pick <= 12"),
    "bounded_peaks": (bounded_peaks, f"WITH {CANDIDATES} SELECT broadcast_id, peak_ms, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY peak_ms) AS INTEGER) AS pick FROM (SELECT DISTINCT broadcast_id, peak_ms FROM candidates) QUALIFY pick <= 12"),
    "task_batches": (task_batches, f"WITH {CANDIDATES} SELECT id, CAST((row_number() OVER (PARTITION BY broadcast_id ORDER BY score DESC, id) - 1) // 12 AS INTEGER) AS batch FROM candidates WHERE kind <> 'visual'"),
    "scene_changes": (scene_changes, f"WITH {SCENES} SELECT broadcast_id, ts_ms, {', '.join(rounded(c, c) for c in ('mean_change', 'changed_share', 'strength', 'robust'))}, eligible FROM scored"),
    "scene_highlights": (scene_highlights, f"""WITH RECURSIVE {SCENES}, ends AS (SELECT broadcast_id, max(ts_ms) + 5000 AS d FROM frames GROUP BY ALL),
      peaks AS (SELECT * FROM scored WINDOW w AS (PARTITION BY broadcast_id ORDER BY ts_ms) QUALIFY eligible AND strength > coalesce(lag(strength) OVER w, -1) AND strength >= coalesce(lead(strength) OVER w, -1)),
      placed AS (SELECT broadcast_id, CAST(floor((previous_ms + ts_ms) / 2 + 0.5) AS BIGINT) AS peak_ms, least(45000, d) AS width, greatest(0, least(CAST(floor((previous_ms + ts_ms) / 2 + 0.5) AS BIGINT) - CAST(floor(least(45000, d) * 4 / 9 + 0.5) AS BIGINT), d - least(45000, d))) AS s, s + least(45000, d) AS e, 0 AS a, 0 AS b,
        floor((least(20.0, greatest(0.0, robust)) + strength) * 1e6 + 0.5) / 1e6 AS score FROM peaks JOIN ends USING (broadcast_id)),
      {greedy_sql("chosen", "placed", "score DESC, peak_ms", 12, DISJOINT)} SELECT broadcast_id, CAST(pick AS INTEGER) AS pick, peak_ms, s AS start_ms, e AS end_ms, score FROM chosen"""),
    "frame_descriptors": (frame_descriptors, f"WITH {DESCRIBED} SELECT * FROM described"),
    "visual_seeds": (visual_seeds, f"""WITH RECURSIVE {DESCRIBED}, lagged AS (SELECT *, lag(dhash) OVER w AS d0, lag(blockhash) OVER w AS b0, lag(mean_luma) OVER w AS l0, lag(edge) OVER w AS e0 FROM described WINDOW w AS (PARTITION BY broadcast_id ORDER BY ts_ms)),
      changes AS (SELECT broadcast_id, ts_ms, floor(((bit_count(xor(dhash, d0)) + bit_count(xor(blockhash, b0))) / 128 * 0.8::DOUBLE + abs(mean_luma - l0) / 255 * 0.12::DOUBLE + abs(edge - e0) / 255 * 0.08::DOUBLE) * 1e6 + 0.5) / 1e6 AS change FROM lagged WHERE d0 IS NOT NULL),
      limits AS (SELECT broadcast_id, greatest(0.14::DOUBLE, list_sort(list(change))[CAST(least(count(*) - 1, floor(count(*) * 0.9::DOUBLE)) AS BIGINT) + 1]) AS least FROM changes GROUP BY ALL), strong AS (SELECT c.*, ts_ms AS s, 0 AS e, 0 AS a, 0 AS b FROM changes c JOIN limits USING (broadcast_id) WHERE change >= least),
      {greedy_sql("chosen", "strong", "change DESC, ts_ms", 4, "abs(t.s - r.s) < 60000")} SELECT broadcast_id, ts_ms, change, CAST(pick AS INTEGER) AS pick FROM chosen"""),
    "fingerprint_matches": (fingerprint_matches, f"WITH {MATCHES} SELECT * FROM matches"),
    "fingerprint_decisions": (fingerprint_decisions, f"""WITH {DECISIONS('true')} SELECT video_id, broadcast_id, reason = 'multi-anchor-consensus' AS matched, reason, {', '.join(f'CASE WHEN few THEN 0 ELSE {c} END AS {c}' for c in ('n_evaluated', 'n_matched', 'n_thirds'))}, {', '.join(f'CASE WHEN NOT few THEN {c} END AS {c}' for c in ('offset_ms', 'median_distance', 'p90_distance'))} FROM decisions"""),
    "fingerprint_identity": (fingerprint_identity, f"""WITH {DECISIONS('offset_ms = 0')}, n AS (SELECT e.broadcast_id, count(d.video_id) AS n_videos, max(d.video_id) AS v FROM ends e LEFT JOIN decisions d ON d.broadcast_id = e.broadcast_id AND d.reason = 'multi-anchor-consensus' GROUP BY ALL)
      SELECT broadcast_id, n_videos, CASE WHEN n_videos = 1 THEN 'verified' WHEN n_videos > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN n_videos = 1 THEN v END AS video_id FROM n"""),
    "sample_times": (sample_times, f"""WITH {FRAMES}, e AS (SELECT broadcast_id, max(ts_ms) + 5000 AS d, least(250, d // 4) AS pad FROM frames GROUP BY ALL), s AS (SELECT broadcast_id, pad AS a, d - 1 - 2 * pad AS span, least(720, greatest(2, CAST(ceil((d - 1 - 2 * pad) / 5000) AS BIGINT) + 1)) AS n FROM e),
      i AS (SELECT *, unnest(range(0, n)) AS i FROM s) SELECT DISTINCT broadcast_id, CAST(floor(a + span * i / (n - 1) + 0.5) AS BIGINT) AS ts_ms FROM i"""),
    "speaker_scores": (speaker_scores, f"WITH {VOICES} SELECT id, label, {rounded('score', 'score')} FROM voices"),
    "speaker_best_two": (speaker_best_two, f"WITH {VOICES} SELECT id, label, {rounded('score', 'score')}, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS INTEGER) AS place FROM voices QUALIFY place <= 2"),
    "speaker_identity": (speaker_identity, f"""WITH {VOICES}, t AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM voices WINDOW w AS (PARTITION BY id ORDER BY score DESC, label))
      SELECT id, label, {rounded('score', 'score')}, CASE WHEN score < 0.2 THEN 'unknown' WHEN score - coalesce(second, 0) < 0.05 THEN 'ambiguous' ELSE 'identified' END AS verdict FROM t WHERE rn = 1"""),
    "speaker_consistency": (speaker_consistency, f"SELECT a.label, count(*) AS n_pairs, {rounded('mean_cosine', 'avg(greatest(0.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))')}, {rounded('least_cosine', 'min(greatest(0.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))')} FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY ALL"),
    "speech_cells": (speech_cells, f"""WITH l AS (SELECT vec_id // 10 AS cell, list_transform(embedding[1:7], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT cell, list_max(e) / list_sum(e) AS c, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS winner FROM l)
      SELECT cell, winner, count(*) * 1000 AS duration_ms, {rounded('least_confidence', 'min(c)')}, {rounded('mean_confidence', 'avg(c)')} FROM p GROUP BY ALL"""),
}
