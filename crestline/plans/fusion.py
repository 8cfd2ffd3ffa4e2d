"""Queries of the fusion operators and of the interval joins and algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import numbers as N
from ..operators import fusion, greedy
from ..operators import intervals as iv
from .chat import greedy_sql
from .tables import CANDIDATES, CAPTIONS, CHAPTERS, candidates, captions, chapters, hours, rounded

R6 = lambda c: N.round_half_up(F.col(c), 6).alias(c)
HALF = "least(t.e, r.e) - greatest(t.s, r.s) > 0 AND least(t.e, r.e) - greatest(t.s, r.s) >= 0.5 * least(t.e - t.s, r.e - r.s)"


def _ranked(spark, sf_dir):
    found = candidates(spark, sf_dir)
    return fusion.normalize_scores(fusion.sanitize(found, hours(found)))


def _pairs(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return fusion.pair_signals(ranked.where("kind = 'audio'"), ranked.where("kind = 'chat'"))


def sanitized(spark, sf_dir):
    found = candidates(spark, sf_dir)
    return fusion.sanitize(found, hours(found)).select("id", "peak_ms", "start_ms", "end_ms")


def normalized_scores(spark, sf_dir):
    return _ranked(spark, sf_dir).select("id", *map(R6, ("rank_percentile", "robust_percentile", "norm")))


def signal_pairs(spark, sf_dir):
    return fusion.weighted_peak(_pairs(spark, sf_dir)).select("broadcast_id", "l_id", "r_id", R6("overlap_ratio"), "distance_ms", R6("fused"), "peak_ms")


def matched_pairs(spark, sf_dir):
    return fusion.match(_pairs(spark, sf_dir)).select("broadcast_id", "l_id", "r_id")


def reaction_drafts(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return fusion.reaction_drafts(ranked.where("kind = 'audio'"), ranked.where("kind = 'chat'")).select("broadcast_id", "audio_id", "chat_id", "peak_ms", R6("score"), "anchor_start", "anchor_end", F.array_join("kinds", "+").alias("kinds"))


def fused_reactions(spark, sf_dir):
    found = candidates(spark, sf_dir)
    return fusion.fuse_reactions(found, hours(found)).select("broadcast_id", "pick", "audio_id", "chat_id", "visual_id", R6("score"), "start_ms", "end_ms", F.array_join("kinds", "+").alias("kinds"))


def suppressed(spark, sf_dir):
    found = candidates(spark, sf_dir)
    return greedy.suppress(found, ["broadcast_id"], [F.desc("score"), F.asc("peak_ms"), F.asc("id")]).select("broadcast_id", "id", "pick")


def score_points(spark, sf_dir):
    return fusion.score_points(candidates(spark, sf_dir)).select("id", R6("point"))


def fused_sources(spark, sf_dir):
    return fusion.fuse_sources(candidates(spark, sf_dir)).select("broadcast_id", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("kinds", "+").alias("kinds"), "start_ms", "end_ms", R6("score"))


def balanced_pick(spark, sf_dir):
    return fusion.balanced_pick(candidates(spark, sf_dir)).select("broadcast_id", "id", "pick")


def merged_windows(spark, sf_dir):
    return iv.merge(candidates(spark, sf_dir), ["broadcast_id"], "kind").select("broadcast_id", "start_ms", "end_ms", "n_merged", F.array_join("kinds", "+").alias("kinds"))


def covered_length(spark, sf_dir):
    return iv.covered_ms(candidates(spark, sf_dir), ["broadcast_id"])


def uncovered_ranges(spark, sf_dir):
    found = candidates(spark, sf_dir)
    planned = iv.cells(hours(found), 600_000)
    return iv.subtract(planned, found.where("kind <> 'semantic'"), ["broadcast_id"], "cell")


def coverage_report(spark, sf_dir):
    found = fusion.sanitize(candidates(spark, sf_dir), hours(candidates(spark, sf_dir)))
    return iv.coverage(found, hours(candidates(spark, sf_dir)), ["broadcast_id"]).select("broadcast_id", "covered_ms", R6("share"), "n_gaps", "status")


def chapter_of_peak(spark, sf_dir):
    found = candidates(spark, sf_dir)
    cell = iv.cells(hours(found), 600_000).select("broadcast_id", "cell", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return iv.containing(found.select("broadcast_id", "id", "peak_ms"), cell, ["broadcast_id"], "peak_ms").select("id", "cell")


def novel_proposals(spark, sf_dir):
    """Semantic proposals that no other candidate covers by 0.6."""
    found = candidates(spark, sf_dir)
    base = found.where("kind <> 'semantic'").select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = I.overlap_ratio(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")) >= 0.6
    return iv.overlap_join(found.where("kind = 'semantic'"), base, ["broadcast_id"], "left_anti", met).select("broadcast_id", "id")


def best_chapter(spark, sf_dir):
    found = candidates(spark, sf_dir)
    base = found.where("kind = 'visual'").select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("id").alias("r_id"))
    return iv.best_overlap(found.where("kind = 'chat'"), base, ["broadcast_id"], "id").select("id", "r_id", "overlap_ms")


def nearest_before(spark, sf_dir):
    found = candidates(spark, sf_dir)
    points = found.where("kind = 'chat'").select("broadcast_id", "id", F.col("peak_ms").alias("at_ms"))
    return iv.nearest(points, found.where("kind = 'visual'").select("broadcast_id", "start_ms", "end_ms"), "broadcast_id").select("id", F.col("chapter.end_ms").alias("before_ms"))


def nearest_after(spark, sf_dir):
    found = candidates(spark, sf_dir)
    points = found.where("kind = 'chat'").select("broadcast_id", "id", F.col("peak_ms").alias("at_ms"))
    return iv.nearest(points, found.where("kind = 'visual'").select("broadcast_id", "start_ms", "end_ms"), "broadcast_id", forward=True).select("id", F.col("chapter.start_ms").alias("after_ms"))


def _ranges(spark, sf_dir):
    cues = captions(spark, sf_dir)
    ends = cues.groupBy("broadcast_id").agg(F.max("end_ms").alias("duration_ms"))
    return iv.cells(ends, 25_000).select("broadcast_id", "cell", "start_ms", "end_ms"), cues.select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("cue").alias("r_id"), "text")


def caption_text(spark, sf_dir):
    ranges, cues = _ranges(spark, sf_dir)
    return iv.text_in_range(ranges, cues, ["broadcast_id"], "cell").select("broadcast_id", "cell", "text", "n_cues")


def chapter_text(spark, sf_dir):
    ranges, cues = _ranges(spark, sf_dir)
    return iv.text_in_range(ranges, cues, ["broadcast_id"], "cell", inclusive=False, most=3000).select("broadcast_id", "cell", "text", "n_cues")


def interval_relations(spark, sf_dir):
    """Relation of each chapter to the one two places on."""
    from pyspark.sql import Window as W

    cells = candidates(spark, sf_dir)
    w = W.partitionBy("broadcast_id").orderBy("start_ms", "id")
    cells = cells.withColumn("b0", F.lead("start_ms", 2).over(w)).withColumn("b1", F.lead("end_ms", 2).over(w))
    return cells.select("id", I.relation(F.col("start_ms"), F.col("end_ms"), F.col("b0"), F.col("b1")).alias("relation"))


def fixed_windows(spark, sf_dir):
    found = fusion.sanitize(candidates(spark, sf_dir), hours(candidates(spark, sf_dir)))
    shares = (("half", 0.5), ("four_ninths", 4 / 9), ("six_tenths", 0.6), ("five_eighths", 0.625))
    return found.select("id", *(I.window_start(F.col("peak_ms"), F.col("duration_ms"), 45_000, s).alias(n) for n, s in shares))


def centred_ranges(spark, sf_dir):
    found = fusion.sanitize(candidates(spark, sf_dir), hours(candidates(spark, sf_dir)))
    a, b = I.centred_range(F.col("start_ms"), F.col("end_ms") - 20_000, F.col("duration_ms"))
    return found.where("end_ms - 20000 > start_ms").select("id", a.alias("start_ms"), b.alias("end_ms"))


def overlap_violations(spark, sf_dir):
    return iv.overlap_violations(candidates(spark, sf_dir).where("kind = 'visual'"), ["broadcast_id"], "id").select("id")


def truth_recall(spark, sf_dir):
    """Share of the semantic moments that some other candidate's peak meets within 45 seconds."""
    found = candidates(spark, sf_dir)
    truth = found.where("kind = 'semantic'").select("broadcast_id", "id", "peak_ms", (F.col("peak_ms") - 45_000).alias("start_ms"), (F.col("peak_ms") + 45_001).alias("end_ms"))
    peaks = found.where("kind <> 'semantic'").select("broadcast_id", F.col("peak_ms").alias("r_start"), (F.col("peak_ms") + 1).alias("r_end"))
    hit = iv.overlap_join(truth, peaks, ["broadcast_id"], "left_semi").select("broadcast_id", "id", F.lit(1).alias("met"))
    return truth.join(hit, ["broadcast_id", "id"], "left").groupBy("broadcast_id").agg(F.count("*").alias("n"), F.count("met").alias("found"), N.round_half_up(F.count("met") / F.count("*"), 6).alias("recall"))


SANE = f"""{CANDIDATES},
sane AS (SELECT broadcast_id, id, kind, score, least(3600000, greatest(0, peak_ms)) AS peak_ms, least(3600000, greatest(0, start_ms)) AS start_ms, least(3600000, greatest(0, end_ms)) AS end_ms FROM candidates WHERE least(3600000, greatest(0, end_ms)) > least(3600000, greatest(0, start_ms)))"""
RANKED = f"""{SANE},
centers AS (SELECT broadcast_id, kind, median(score) AS center FROM sane GROUP BY ALL),
mads AS (SELECT broadcast_id, kind, any_value(center) AS center, median(abs(score - center)) AS mad FROM sane JOIN centers USING (broadcast_id, kind) GROUP BY ALL),
percents AS (SELECT s.*, CASE WHEN count(*) OVER p = 1 THEN 1.0 ELSE 1 - (rank() OVER (PARTITION BY broadcast_id, kind ORDER BY score DESC) - 1) / (count(*) OVER p - 1) END AS rank_percentile,
  CASE WHEN mad <= 2.220446049250313e-16 THEN 0.5 ELSE 0.5 + tanh(least(6.0, greatest(-6.0, (score - center) / (1.4826 * mad))) / 3) / 2 END AS robust_percentile
  FROM sane s JOIN mads USING (broadcast_id, kind) WINDOW p AS (PARTITION BY broadcast_id, kind)),
ranked AS MATERIALIZED (SELECT *, rank_percentile * 0.65 + robust_percentile * 0.35 AS norm FROM percents)"""
OVERLAP = "(CASE WHEN least({0}) <= 0 THEN 0 ELSE greatest(0, least({1}) - greatest({2})) / least({0}) END)"
PAIRS = f"""{RANKED},
pairs AS MATERIALIZED (SELECT l.broadcast_id, l.id AS l_id, r.id AS r_id, {OVERLAP.format("l.end_ms - l.start_ms, r.end_ms - r.start_ms", "l.end_ms, r.end_ms", "l.start_ms, r.start_ms")} AS overlap_ratio, abs(l.peak_ms - r.peak_ms) AS distance_ms,
  least(1.0, (l.norm + r.norm) / 2 + 0.16) AS fused, CAST(floor((l.peak_ms * greatest(0.01, l.norm) + r.peak_ms * greatest(0.01, r.norm)) / (greatest(0.01, l.norm) + greatest(0.01, r.norm)) + 0.5) AS BIGINT) AS peak_ms, 0 AS s, 0 AS e, l.id AS a, r.id AS b
  FROM ranked l JOIN ranked r ON l.broadcast_id = r.broadcast_id AND l.kind = 'audio' AND r.kind = 'chat' AND ((greatest(l.start_ms, r.start_ms) < least(l.end_ms, r.end_ms)) OR abs(l.peak_ms - r.peak_ms) <= 10000))"""
ONE_TO_ONE = "t.a = r.a OR t.b = r.b"
MATCHED = f"""{PAIRS},
{greedy_sql("matched", "pairs", "overlap_ratio DESC, distance_ms, fused DESC, l_id, r_id", 1 << 20, ONE_TO_ONE)}"""
DRAFTS = f"""{MATCHED},
drafts AS MATERIALIZED (SELECT coalesce(x.broadcast_id, c.broadcast_id) AS broadcast_id, x.id AS audio_id, c.id AS chat_id, coalesce(x.peak_ms, c.peak_ms) AS peak_ms, coalesce(x.fused, x.norm, c.norm) AS score,
  least(x.start_ms, c.start_ms) AS anchor_start, greatest(x.end_ms, c.end_ms) AS anchor_end, CASE WHEN x.id IS NULL THEN 'chat' WHEN c.id IS NULL THEN 'audio' ELSE 'audio+chat' END AS kinds
  FROM (SELECT r.*, m.r_id, m.fused FROM ranked r LEFT JOIN matched m ON r.id = m.l_id WHERE r.kind = 'audio') x FULL OUTER JOIN (SELECT * FROM ranked WHERE kind = 'chat') c ON x.r_id = c.id)"""
FUSED = f"""{DRAFTS},
numbered AS (SELECT *, row_number() OVER (ORDER BY audio_id NULLS FIRST, chat_id NULLS FIRST) AS draft FROM drafts),
context AS (SELECT d.broadcast_id, d.draft, v.id AS visual_id, v.norm AS v_norm, {OVERLAP.format("d.anchor_end - d.anchor_start, v.end_ms - v.start_ms", "d.anchor_end, v.end_ms", "d.anchor_start, v.start_ms")} AS overlap_ratio, abs(d.peak_ms - v.peak_ms) AS distance_ms, 0 AS s, 0 AS e, d.draft AS a, v.id AS b
  FROM numbered d JOIN ranked v ON d.broadcast_id = v.broadcast_id AND v.kind = 'visual' AND (greatest(d.anchor_start, v.start_ms) < least(d.anchor_end, v.end_ms) OR abs(d.peak_ms - v.peak_ms) <= 10000)),
{greedy_sql("attached", "context", "overlap_ratio DESC, distance_ms, v_norm DESC, draft, visual_id", 1 << 20, ONE_TO_ONE)},
every AS (SELECT n.broadcast_id, audio_id, chat_id, visual_id, peak_ms, CASE WHEN visual_id IS NULL THEN score ELSE least(1.0, score + 0.04 * v_norm) END AS score, kinds || CASE WHEN visual_id IS NULL THEN '' ELSE '+visual' END AS kinds, false AS exploration FROM numbered n LEFT JOIN attached USING (draft)
  UNION ALL SELECT broadcast_id, NULL, NULL, id, peak_ms, norm * 0.32, 'visual', true FROM ranked r WHERE kind = 'visual' AND NOT EXISTS (SELECT 1 FROM ranked o WHERE o.broadcast_id = r.broadcast_id AND o.kind IN ('audio', 'chat'))),
placed AS (SELECT *, greatest(0, least(CAST(floor(peak_ms - CASE WHEN exploration THEN 22500 ELSE 28125 END + 0.5) AS BIGINT), 3555000)) AS s, s + 45000 AS e, 0 AS a, 0 AS b FROM every),
{greedy_sql("chosen", "placed", "(audio_id IS NOT NULL AND chat_id IS NOT NULL) DESC, score DESC, len(string_split(kinds, '+')) DESC, peak_ms, s, audio_id NULLS FIRST, chat_id NULLS FIRST, visual_id NULLS FIRST", 96, HALF)}"""
ISLANDS = f"""{CANDIDATES},
reach AS (SELECT *, max(end_ms) OVER (PARTITION BY broadcast_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {{0}}),
isles AS (SELECT *, sum(CASE WHEN start_ms > r THEN 1 ELSE 0 END) OVER (PARTITION BY broadcast_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT broadcast_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged, list_sort(list(DISTINCT kind)) AS kinds FROM isles GROUP BY broadcast_id, island)"""
CELLS = "cells AS (SELECT broadcast_id, CAST(unnest(range(0, 6)) AS INTEGER) AS cell, cell * 600000 AS start_ms, (cell + 1) * 600000 AS end_ms FROM (SELECT DISTINCT broadcast_id FROM candidates))"
RANGES = f"""{CAPTIONS}, ends AS (SELECT broadcast_id, max(end_ms) AS d FROM captions GROUP BY ALL),
ranges AS (SELECT broadcast_id, CAST(unnest(range(0, CAST(ceil(d / 25000) AS BIGINT))) AS INTEGER) AS cell, cell * 25000 AS start_ms, least(d, (cell + 1) * 25000) AS end_ms FROM ends)"""
TEXT = RANGES + " SELECT r.broadcast_id, cell, left(string_agg(text, ' ' ORDER BY c.start_ms, c.cue), {1}) AS text, count(*) AS n_cues FROM ranges r JOIN captions c ON r.broadcast_id = c.broadcast_id AND c.start_ms < r.end_ms AND c.end_ms {0} r.start_ms GROUP BY r.broadcast_id, cell"
SEMANTIC = """WITH RECURSIVE {0}, ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY (kind = 'semantic') DESC, score DESC, start_ms, id) AS rn FROM candidates),
fold AS (SELECT broadcast_id, 0::BIGINT AS rn, []::STRUCT(ids BIGINT[], kinds VARCHAR[], s BIGINT, e BIGINT, p BIGINT, score DOUBLE)[] AS acc FROM (SELECT DISTINCT broadcast_id FROM candidates)
  UNION ALL SELECT f.broadcast_id, r.rn, CASE WHEN k.k IS NULL THEN list_append(f.acc, {{'ids': [r.id], 'kinds': [r.kind], 's': r.start_ms, 'e': r.end_ms, 'p': r.peak_ms, 'score': r.score}})
    ELSE list_transform(f.acc, lambda a, i: CASE WHEN i = k.k THEN {{'ids': list_append(a.ids, r.id), 'kinds': list_append(a.kinds, r.kind), 's': a.s, 'e': a.e, 'p': a.p, 'score': least(1.0, 1 - (1 - a.score) * (1 - r.score))}} ELSE a END) END
  FROM fold f JOIN ordered r ON r.broadcast_id = f.broadcast_id AND r.rn = f.rn + 1,
  LATERAL (SELECT list_min(list_filter(list_transform(f.acc, lambda a, i: CASE WHEN (greatest(0, least(a.e, r.end_ms) - greatest(a.s, r.start_ms)) >= 0.5 * least(a.e - a.s, r.end_ms - r.start_ms) OR abs(a.p - r.peak_ms) <= 8000) AND NOT (list_contains(a.kinds, 'semantic') AND r.kind = 'semantic') THEN i END), lambda x: x IS NOT NULL)) AS k) k),
last AS (SELECT f.broadcast_id, f.acc FROM fold f JOIN (SELECT broadcast_id, max(rn) AS rn FROM ordered GROUP BY ALL) USING (broadcast_id, rn)),
flat AS (SELECT broadcast_id, unnest(acc) AS c, CAST(generate_subscripts(acc, 1) - 1 AS INTEGER) AS n FROM last)
SELECT broadcast_id, n, array_to_string(list_sort(c.ids), ',') AS ids, array_to_string(list_sort(list_distinct(c.kinds)), '+') AS kinds, c.s AS start_ms, c.e AS end_ms, floor(c.score * 1e6 + 0.5) / 1e6 AS score FROM flat""".format(CANDIDATES)

QUERIES = {
    "sanitized_candidates": (sanitized, f"WITH {SANE} SELECT id, peak_ms, start_ms, end_ms FROM sane"),
    "normalized_scores": (normalized_scores, f"WITH {RANKED} SELECT id, {', '.join(rounded(c, c) for c in ('rank_percentile', 'robust_percentile', 'norm'))} FROM ranked"),
    "signal_pairs": (signal_pairs, f"WITH {PAIRS} SELECT broadcast_id, l_id, r_id, {rounded('overlap_ratio', 'overlap_ratio')}, distance_ms, {rounded('fused', 'fused')}, peak_ms FROM pairs"),
    "matched_pairs": (matched_pairs, f"WITH RECURSIVE {MATCHED} SELECT broadcast_id, l_id, r_id FROM matched"),
    "reaction_drafts": (reaction_drafts, f"WITH RECURSIVE {DRAFTS} SELECT broadcast_id, audio_id, chat_id, peak_ms, {rounded('score', 'score')}, anchor_start, anchor_end, kinds FROM drafts"),
    "fused_reactions": (fused_reactions, f"WITH RECURSIVE {FUSED} SELECT broadcast_id, CAST(pick AS INTEGER) AS pick, audio_id, chat_id, visual_id, {rounded('score', 'score')}, s AS start_ms, e AS end_ms, kinds FROM chosen WHERE NOT exploration OR pick <= 4"),
    "suppressed_candidates": (suppressed, f"WITH RECURSIVE {CANDIDATES}, spans AS (SELECT *, start_ms AS s, end_ms AS e, 0 AS a, 0 AS b FROM candidates), {greedy_sql('chosen', 'spans', 'score DESC, peak_ms, id', 96, HALF)} SELECT broadcast_id, id, CAST(pick AS INTEGER) AS pick FROM chosen"),
    "score_points": (score_points, f"WITH {CANDIDATES} SELECT id, {rounded('point', 'greatest(0.08, score / max(score) OVER (PARTITION BY broadcast_id, kind))')} FROM candidates"),
    "fused_sources": (fused_sources, SEMANTIC),
    "balanced_pick": (balanced_pick, f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY broadcast_id, kind ORDER BY score DESC, start_ms, id) - 1 AS k FROM candidates),
      t AS (SELECT *, CASE WHEN kind = 'semantic' THEN k // 4 ELSE k END AS turn, CASE kind WHEN 'semantic' THEN k % 4 WHEN 'audio' THEN 4 ELSE 5 END AS spot FROM r WHERE kind <> 'chat')
      SELECT broadcast_id, id, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY turn, spot) AS INTEGER) AS pick FROM t QUALIFY pick <= 12"""),
    "merged_windows": (merged_windows, f"WITH {ISLANDS.format('candidates')} SELECT broadcast_id, start_ms, end_ms, n_merged, array_to_string(kinds, '+') AS kinds FROM merged"),
    "covered_length": (covered_length, f"WITH {ISLANDS.format('candidates')} SELECT broadcast_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms FROM merged GROUP BY ALL"),
    "uncovered_ranges": (uncovered_ranges, f"""WITH {ISLANDS.format("(SELECT * FROM candidates WHERE kind <> 'semantic')")}, {CELLS},
      hit AS (SELECT c.broadcast_id, cell, c.end_ms AS ce, greatest(c.start_ms, m.start_ms) AS a, least(c.end_ms, m.end_ms) AS b FROM cells c JOIN merged m ON c.broadcast_id = m.broadcast_id AND greatest(c.start_ms, m.start_ms) < least(c.end_ms, m.end_ms)
        UNION ALL SELECT broadcast_id, cell, end_ms, start_ms, start_ms FROM cells),
      nexts AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY broadcast_id, cell ORDER BY a, b), ce) AS nx FROM hit)
      SELECT broadcast_id, cell, b::BIGINT AS start_ms, nx::BIGINT AS end_ms FROM nexts WHERE nx > b"""),
    "coverage_report": (coverage_report, f"""WITH {SANE}, reach AS (SELECT *, max(end_ms) OVER (PARTITION BY broadcast_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sane),
      per AS (SELECT broadcast_id, CAST(sum(greatest(0, end_ms - greatest(start_ms, coalesce(r, 0)))) AS BIGINT) AS covered_ms, CAST(sum(CASE WHEN start_ms > coalesce(r, 0) THEN 1 ELSE 0 END) AS BIGINT) AS holes, max(end_ms) AS last FROM reach GROUP BY ALL)
      SELECT broadcast_id, covered_ms, {rounded('share', 'covered_ms / 3600000')}, holes + CASE WHEN last < 3600000 THEN 1 ELSE 0 END AS n_gaps, CASE WHEN covered_ms = 0 THEN 'none' WHEN holes + CASE WHEN last < 3600000 THEN 1 ELSE 0 END = 0 THEN 'complete' ELSE 'partial' END AS status FROM per"""),
    "chapter_of_peak": (chapter_of_peak, f"WITH {CANDIDATES} SELECT id, CAST(peak_ms // 600000 AS INTEGER) AS cell FROM candidates"),
    "novel_proposals": (novel_proposals, f"WITH {CANDIDATES} SELECT broadcast_id, id FROM candidates c WHERE kind = 'semantic' AND NOT EXISTS (SELECT 1 FROM candidates o WHERE o.broadcast_id = c.broadcast_id AND o.kind <> 'semantic' AND least(c.end_ms, o.end_ms) - greatest(c.start_ms, o.start_ms) >= 0.6 * 45000)"),
    "best_overlap": (best_chapter, f"""WITH {CANDIDATES} SELECT c.id, o.id AS r_id, least(c.end_ms, o.end_ms) - greatest(c.start_ms, o.start_ms) AS overlap_ms FROM candidates c JOIN candidates o ON c.broadcast_id = o.broadcast_id AND c.kind = 'chat' AND o.kind = 'visual' AND greatest(c.start_ms, o.start_ms) < least(c.end_ms, o.end_ms)
      QUALIFY row_number() OVER (PARTITION BY c.broadcast_id, c.id ORDER BY overlap_ms DESC, o.start_ms, o.id) = 1"""),
    "nearest_before": (nearest_before, f"WITH {CANDIDATES} SELECT id, (SELECT max(o.end_ms) FROM candidates o WHERE o.broadcast_id = c.broadcast_id AND o.kind = 'visual' AND o.end_ms <= c.peak_ms) AS before_ms FROM candidates c WHERE kind = 'chat'"),
    "nearest_after": (nearest_after, f"WITH {CANDIDATES} SELECT id, (SELECT min(o.start_ms) FROM candidates o WHERE o.broadcast_id = c.broadcast_id AND o.kind = 'visual' AND o.start_ms >= c.peak_ms) AS after_ms FROM candidates c WHERE kind = 'chat'"),
    "caption_text": (caption_text, "WITH " + TEXT.format(">=", 4000)),
    "chapter_text": (chapter_text, "WITH " + TEXT.format(">", 3000)),
    "interval_relations": (interval_relations, f"WITH {CANDIDATES}, n AS (SELECT *, lead(start_ms, 2) OVER w AS b0, lead(end_ms, 2) OVER w AS b1 FROM candidates WINDOW w AS (PARTITION BY broadcast_id ORDER BY start_ms, id)) SELECT id, CASE WHEN b0 IS NULL THEN 'unknown' WHEN end_ms <= b0 THEN 'before' WHEN b1 <= start_ms THEN 'after' ELSE 'overlap' END AS relation FROM n"),
    "fixed_windows": (fixed_windows, f"WITH {SANE} SELECT id, {', '.join(f'greatest(0, least(CAST(floor(peak_ms - {s} + 0.5) AS BIGINT), 3555000)) AS {n}' for n, s in (('half', 22500), ('four_ninths', 20000), ('six_tenths', 27000), ('five_eighths', 28125)))} FROM sane"),
    "centred_ranges": (centred_ranges, f"""WITH {SANE}, l AS (SELECT *, least(60000, greatest(30000, end_ms - 20000 - start_ms)) AS n, (start_ms + end_ms - 20000) / 2 AS c FROM sane WHERE end_ms - 20000 > start_ms),
      b AS (SELECT *, greatest(0, least(CAST(floor(c - n / 2 + 0.5) AS BIGINT), 3600000 - n)) AS b FROM l) SELECT id, b AS start_ms, least(3600000, b + n) AS end_ms FROM b"""),
    "overlap_violations": (overlap_violations, f"WITH {CANDIDATES} SELECT id FROM candidates WHERE kind = 'visual' WINDOW w AS (PARTITION BY broadcast_id ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY start_ms < max(end_ms) OVER w"),
    "truth_recall": (truth_recall, f"""WITH {CANDIDATES}, t AS (SELECT broadcast_id, EXISTS (SELECT 1 FROM candidates o WHERE o.broadcast_id = c.broadcast_id AND o.kind <> 'semantic' AND abs(o.peak_ms - c.peak_ms) <= 45000) AS met FROM candidates c WHERE kind = 'semantic')
      SELECT broadcast_id, count(*) AS n, count(*) FILTER (WHERE met) AS found, {rounded('recall', 'count(*) FILTER (WHERE met) / count(*)')} FROM t GROUP BY ALL"""),
}
