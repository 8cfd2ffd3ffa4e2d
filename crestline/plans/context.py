"""Queries of candidates' context, of leads and of the predicates on transcripts, gaps and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import predicates as P
from ..functions import text as T
from ..operators import context as cx
from ..operators import fusion, leads
from ..operators import intervals as iv
from .chat import greedy_sql
from .fusion import CELLS, RANGES
from .tables import CANDIDATES, CAPTIONS, CHAPTERS, FRAMES, candidates, captions, chapters, frames, hours, read, rounded
from .texts import WORDS

R6 = lambda c: N.round_half_up(F.col(c), 6).alias(c)
joined = lambda c, sep=",": F.array_join(F.transform(c, lambda x: x.cast("string")), sep).alias(c)


def _pick(column, values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def _case(column, values):
    return f"{list(values)}[{column} % {len(values)} + 1]"


def _marked(spark, sf_dir):
    turn = F.col("turn") % 4
    text = F.when(turn == 0, F.concat(F.lit("[음악] "), "text")).when(turn == 1, F.concat(F.lit("[Music] 가나다 [박수] "), "text")).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), "role")


def music_captions(spark, sf_dir):
    return _marked(spark, sf_dir).select("conv_id", "turn", P.is_music_only(F.col("text")).alias("music"))


def expandable_chunks(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", P.should_expand(F.col("text"), F.when(F.col("turn") % 3 == 0, "surprised")).alias("expand"))


def program_material(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "music-or-intermission").otherwise("talk").alias("category"), F.when(F.col("quality") == 0, F.array(F.lit("music-or-song"))).otherwise(F.array(F.lit("other"))).alias("reasons"))
    return rows.where(P.is_program_material(F.col("category"), F.col("reasons"))).select("doc_id")


def silent_segments(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") == 3, P.NO_SPEECH).otherwise("words").alias("text"), F.when(F.col("l_partkey") % 7 > 0, 0.9 + F.col("l_discount")).alias("silence"), (-20 * F.col("l_tax")).alias("words"))
    return rows.groupBy("l_suppkey").agg(F.count_if(P.is_no_speech(F.col("text"), F.col("silence"), F.col("words"))).alias("n"))


def chunk_quality(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("broadcast_id"), (F.col("l_orderkey") % 10).alias("id"), (F.col("l_linenumber") * 1000).alias("start_ms"), (F.col("l_linenumber") * 1000 + (F.col("l_quantity") - 10) * 100).alias("end_ms"), F.lit(6000).alias("duration_ms"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(" ").alias("text"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_discount") * 11).alias("confidence"), (F.col("l_tax") * 10).alias("no_speech"), (F.col("l_linenumber") == 2).alias("silent"),
    )
    return cx.chunk_counts(rows)


GAPS = ("pending", "decode-failed", "outcome-unknown", "in-flight", "rate-limited", "no-audio")


def gap_retries(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(_pick(key, GAPS).alias("reason"), (key % 5 % 2).alias("attempts"), F.when(key % 7 < 3, P.FREE).otherwise(P.PAID).alias("transport"))
    args = F.col("reason"), F.col("attempts"), F.col("transport")
    return rows.select("*", P.retryable(*args).alias("automatic"), P.retryable_when_paid(*args).alias("paid")).groupBy("reason", "attempts", "transport", "automatic", "paid").agg(F.count("*").alias("n"))


def identity_bases(spark, sf_dir):
    key = F.col("o_orderkey")
    given = [F.when(key % m == 0, key + d) for m, d in ((7, 1), (5, 2), (3, 3), (2, 4))]
    basis, video = P.identity_basis(*given, lambda v: F.when(v % 11 > 0, v % 13 > 0))
    return read(spark, sf_dir, "orders").select(key.alias("id"), basis.alias("basis"), video.alias("video_id"))


def merge_guards(spark, sf_dir):
    key = F.col("o_orderkey")
    reason = P.compare_only_reason(key % 19 > 0, key % 17 == 0, _pick(key, ("unreviewed", "unreviewed", "approved", "rejected")), key % 13 == 0, key % 11 == 0, key % 7 > 0, key % 5 > 0)
    return read(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def durations_compatible(spark, sf_dir):
    price = F.floor(F.col("o_totalprice") * 100).cast("long")
    return read(spark, sf_dir, "orders").select("o_orderkey", P.duration_tolerance(price).alias("tolerance"), (F.abs(F.col("o_orderkey") % 9000) <= P.duration_tolerance(price)).alias("compatible"))


def frame_brightness(spark, sf_dir):
    found = frames(spark, sf_dir)
    rgb = [F.get("luma", F.lit(k)) for k in range(3)]
    return found.select("vec_id", N.round_half_up(P.luma(*rgb)).cast("long").alias("luma"))


def replay_numbers(spark, sf_dir):
    key = F.col("page_id")
    number = (key + 10_000_000).cast("string")
    name = F.when(key % 4 == 0, F.concat(F.lit("https://chzzk.naver.com/video/"), number, F.lit("?t=1"))).when(key % 4 == 1, F.concat(F.lit("CHZZK replay "), number, F.lit(".mp4"))).when(key % 4 == 2, F.concat(F.lit("rec_"), number)).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", P.replay_number(name).alias("number"))


def stable_ids(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", "kind", P.stable_id(F.col("kind"), F.col("peak_ms")).alias("stable_id"))


def sentence_counts(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def _talk(spark, sf_dir):
    """Captions by users, chapters by the others, and the length of each conversation."""
    cues = captions(spark, sf_dir)
    ends = cues.groupBy("broadcast_id").agg(F.max("end_ms").alias("duration_ms"))
    cue = cues.select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("cue").alias("r_id"), "text", "role")
    return cues, ends, cue.where("role = 'user'").drop("role"), cue.where("role <> 'user'").drop("role")


def best_texts(spark, sf_dir):
    _, ends, own, other = _talk(spark, sf_dir)
    ranges = iv.cells(ends, 10_000).select("broadcast_id", "cell", "start_ms", "end_ms")
    found = cx.best_text(ranges, own, other, "cell")
    return found.select("broadcast_id", "cell", "source", F.md5(F.col("text").cast("binary")).alias("text"))


def _clips(spark, sf_dir):
    cues, ends, own, other = _talk(spark, sf_dir)
    clips = cues.select("broadcast_id", (F.col("broadcast_id") * 1000 + F.col("cue")).alias("id"), "cue", (F.col("start_ms") + 2000).alias("start_ms"), (F.col("start_ms") + 14_000).alias("end_ms"), "text").join(ends, "broadcast_id")
    return clips, own, other


def context_packets(spark, sf_dir):
    clips, own, other = _clips(spark, sf_dir)
    notes = clips.where("id % 4 <> 3").select("id", _pick(F.col("id"), ("select", "review", "reject")).alias("decision"), _pick(F.col("cue"), ("talk", "game")).alias("category"))
    found = cx.context_packets(clips.drop("text", "cue"), own, other, notes)
    return found.select("id", "source", "decision", "category", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("text", "before", "after")))


def localized_leads(spark, sf_dir):
    clips, _, other = _clips(spark, sf_dir)
    found = cx.localize_leads(clips.select("broadcast_id", F.col("id").alias("lead"), "start_ms", (F.col("end_ms") + 31_000).alias("end_ms"), "duration_ms", F.col("text").alias("cue")).where("duration_ms >= 30000"), other)
    return found.select("lead", R6("score"), "peak_ms", "start_ms", "end_ms")


def caption_cells(spark, sf_dir):
    _, ends, own, _ = _talk(spark, sf_dir)
    return cx.caption_cells(own, ends, 30_000).select("broadcast_id", "cell", "n_cues", F.md5(F.col("text").cast("binary")).alias("text"))


def refined_segments(spark, sf_dir):
    _, ends, own, _ = _talk(spark, sf_dir)
    texts = cx.caption_cells(own, ends, 30_000)
    plan = iv.cells(ends, 30_000).select("broadcast_id", "start_ms", "end_ms")
    return cx.refinement_chapters(plan, texts).select("broadcast_id", "start_ms", "end_ms", F.md5(F.col("text").cast("binary")).alias("text"))


def bound_cues(spark, sf_dir):
    cues = captions(spark, sf_dir)
    ends = cues.groupBy("broadcast_id").agg((F.max("start_ms") - 5000).alias("duration_ms"))
    return cx.bound_cues(cues, ends).select("broadcast_id", "cue", "end_ms")


def subtitle_gate(spark, sf_dir):
    cues = captions(spark, sf_dir)
    clips = cues.select("broadcast_id", F.col("cue").alias("id"), (F.col("start_ms") + 2500).alias("start_ms"), (F.col("start_ms") + 40_000).alias("end_ms"))
    return cx.subtitle_available(cues, clips).select("broadcast_id", "id", R6("share"), "available")


def inspection_order(spark, sf_dir):
    found = candidates(spark, sf_dir)
    plan = iv.cells(hours(found), 600_000).select("broadcast_id", "cell", "start_ms", "end_ms")
    salience = found.where("kind = 'visual'").groupBy("broadcast_id", F.floor(F.col("peak_ms") / 600_000).cast("int").alias("cell")).agg(F.max("score").alias("salience"))
    return cx.cell_priority(plan, found.where("kind = 'chat'"), salience).select("broadcast_id", "cell", R6("ratio"), "basis", joined("ids"), "place")


def verified_candidates(spark, sf_dir):
    found = candidates(spark, sf_dir)
    return cx.verified_only(found, found.where("id % 3 = 0").select("id")).select("broadcast_id", "id", "place")


def projected_ranges(spark, sf_dir):
    found = fusion.sanitize(candidates(spark, sf_dir), hours(candidates(spark, sf_dir)))
    cell = iv.cells(hours(found).withColumn("duration_ms", F.lit(2_700_000).cast("long")), 300_000).where("cell <> 4").select("broadcast_id", F.col("cell").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    ranges = found.select("broadcast_id", "id", "start_ms", (F.col("end_ms") + F.col("id") % 5 * 100_000).alias("end_ms"), F.lit(3_600_000).alias("from_ms"), F.lit(2_700_000).cast("long").alias("to_ms"))
    return cx.project_timeline(ranges, cell).select("id", "first", "last", "first_ms", "last_ms")


KINDS = (*cx.SEEN, *cx.HEARD, *cx.MENTIONED)


def _evidence(spark, sf_dir):
    return candidates(spark, sf_dir).where("kind <> 'semantic'").select("broadcast_id", (F.col("peak_ms") % 7).alias("participant"), _pick(F.col("peak_ms"), KINDS).alias("kind"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))


def range_participants(spark, sf_dir):
    ranges = iv.cells(hours(candidates(spark, sf_dir)), 600_000).select("broadcast_id", F.col("cell").alias("id"), "start_ms", "end_ms")
    return cx.participants_in_range(ranges, _evidence(spark, sf_dir)).select("broadcast_id", "id", joined("seen"), joined("heard"), joined("mentioned"))


def grounding(spark, sf_dir):
    people = hours(candidates(spark, sf_dir)).select("broadcast_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("participant"))
    return cx.grounding_summary(people, _evidence(spark, sf_dir))


def _visual(spark, sf_dir):
    c = chapters(spark, sf_dir)
    plan = c.select("broadcast_id", F.col("n").alias("cell"), "start_ms", "end_ms", F.when(F.col("doc_id") % 2 == 0, "transcript-abstention").otherwise("other").alias("purpose"))
    ended = c.select("broadcast_id", F.col("n").alias("cell"), _pick(F.col("doc_id"), ("completed", "failed", "excluded-music-only")).alias("outcome"), F.md5(F.col("text").cast("binary")).alias("summary"))
    return cx.visual_chapters(plan, ended)


def visual_chapters(spark, sf_dir):
    return _visual(spark, sf_dir).select("broadcast_id", "chapter", "start_ms", "text")


def all_chapters(spark, sf_dir):
    own = chapters(spark, sf_dir).select("broadcast_id", F.col("n").alias("chapter"), "start_ms", "end_ms", F.md5(F.col("text").cast("binary")).alias("text"))
    return cx.union_chapters(own, _visual(spark, sf_dir)).groupBy("broadcast_id", "violation").agg(F.count("*").alias("n"), F.max("place").alias("last"))


def chapter_upserts(spark, sf_dir):
    c = chapters(spark, sf_dir).withColumn("text", F.md5(F.col("text").cast("binary")))
    return cx.upsert_chapters(c.where("doc_id % 3 < 2"), c.where("doc_id % 3 > 0").withColumn("text", F.concat("text", F.lit("!")))).select("broadcast_id", "chapter", "start_ms", "text", "overlaps")


def source_rosters(spark, sf_dir):
    sources = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("channel_id"), F.concat_ws("_", "c_mktsegment", F.col("c_custkey") % 40).alias("name"))
    rosters = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("roster"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("channel_id"), F.col("n_nationkey").cast("string").alias("owner"))
    return cx.resolve_roster(sources, rosters)


def recoverable_results(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 10).alias("digest"))
    wrong = (F.col("run_id") % 9 == 0).cast("long")
    return cx.recoverable_results(o, o.where("run_id % 4 <> 0").select("run_id", "digest"), o.where("run_id % 5 <> 0").select("run_id", "kind", (F.col("digest") + wrong).alias("digest")), 3)


def sound_events(spark, sf_dir):
    scores = read(spark, sf_dir, "embeddings").select(F.col("label").alias("broadcast_id"), F.floor(F.col("vec_id") / 3).alias("id"), _pick(F.col("vec_id"), cx.PHASES).alias("phase"), (F.col("vec_id") * 10_000).alias("start_ms"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("scores"))
    return cx.audio_events(scores).select("broadcast_id", "id", "kind", R6("peak"), "n_windows", "start_ms", "strength", "place")


def edit_list(spark, sf_dir):
    c = candidates(spark, sf_dir).select("broadcast_id", "id", (F.col("id") % 3).alias("revision"), "start_ms", "end_ms")
    edits = c.where("id % 2 = 0").select("id", (F.col("id") % 5 % 3).alias("revision"), (F.col("start_ms") + 60_000).alias("start_ms"), (F.col("end_ms") + 50_000).alias("end_ms"))
    return cx.edit_list(c, edits).select("broadcast_id", "id", "start_ms", "end_ms", "source", "place")


def signal_union(spark, sf_dir):
    c = candidates(spark, sf_dir)
    both = cx.union_signals({"sound": c.where("kind = 'audio'").select("broadcast_id", "id", "score"), "talk": c.where("kind = 'chat'").select("broadcast_id", "id", "peak_ms")})
    return both.groupBy("broadcast_id", "origin").agg(F.count("*").alias("n"), F.count("score").alias("n_scores"), F.count("peak_ms").alias("n_peaks"))


def shared_evidence(spark, sf_dir):
    c = candidates(spark, sf_dir)
    a, b = F.array(F.col("peak_ms") % 3, F.col("peak_ms") % 5), F.when(F.col("id") % 4 > 0, F.array(F.col("id") % 7))
    return c.groupBy("broadcast_id").agg(F.count_if(cx.shares_any(a, b)).alias("n"))


def set_fingerprints(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("score", N.round_half_up(F.col("score") * 1_000_000).cast("long"))
    return cx.snapshot_fingerprint(c, ["broadcast_id"], ["id"], ["kind", "score"])


def semantic_leads(spark, sf_dir):
    c = candidates(spark, sf_dir).where("kind = 'semantic'").withColumnRenamed("id", "lead")
    return cx.lead_candidates(c.select("broadcast_id", "lead", F.col("score").alias("confidence"), F.lit("talk").alias("category")), c.distinct()).select("id", "peak_ms", "score", "category")


def stage_commits(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg((F.count_if(F.col("o_orderstatus") == "P") == 0).alias("context_complete"), (F.count_if(F.col("o_orderstatus") == "O") < 3).alias("selection_ready"), (F.count_if(F.col("o_orderpriority") == "5-LOW") > 1).alias("has_gap"))
    return cx.stage_commit(o)


def merged_leads(spark, sf_dir):
    c = candidates(spark, sf_dir).select("broadcast_id", F.col("kind").alias("group"), F.col("id").alias("lead"), "start_ms", "end_ms", F.col("score").alias("confidence"), (F.col("peak_ms") % 200).cast("string").alias("cue"))
    return leads.merge_leads(c).select("broadcast_id", "lead", "pick")


def topic_slices(spark, sf_dir):
    found = candidates(spark, sf_dir)
    parts = iv.cells(hours(found), 300_000).select("broadcast_id", F.col("cell").alias("n"), "start_ms", "end_ms")
    topics = found.where("kind = 'visual' and broadcast_id % 3 > 0").select("broadcast_id", F.col("id").alias("topic"), "start_ms", (F.col("end_ms") + F.col("id") % 7 * 60_000).alias("end_ms"), F.when(F.col("id") % 5 == 0, "context-shift").otherwise("talk").alias("kind"), (F.col("id") % 2 == 0).alias("primary"))
    return leads.topic_slices(parts, topics)


def _leads(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("broadcast_id", F.col("id").alias("lead"), F.floor(F.col("peak_ms") / 900_000).alias("topic"), F.greatest(F.lit(0), "start_ms").alias("start_ms"), "end_ms", F.least(F.lit(1.0), "score").alias("confidence"), _pick(F.col("id"), ("select", "review", "reject", "reject", "reject")).alias("decision"), ((F.col("peak_ms") % 11) / 11).alias("verdict_confidence"))


def refinement_leads(spark, sf_dir):
    return leads.refinement_leads(_leads(spark, sf_dir))


def refinement_cells(spark, sf_dir):
    return leads.refinement_plan(_leads(spark, sf_dir), 120_000)


def scattered_order(spark, sf_dir):
    return leads.scattered_order(iv.cells(hours(candidates(spark, sf_dir)), 90_000).withColumnRenamed("cell", "n"))


def pending_order(spark, sf_dir):
    c = chapters(spark, sf_dir)
    pending = c.where("n % 3 <> 1").select("broadcast_id", "n", (-F.col("doc_id")).alias("place"))
    return leads.prioritize_neighbours(pending, c.select("broadcast_id").distinct().withColumn("current", F.lit(11)), 3).select("broadcast_id", "n", "pick")


def listening_plan(spark, sf_dir):
    found = candidates(spark, sf_dir)
    ends = hours(found).withColumn("duration_ms", F.when(F.col("broadcast_id") % 4 == 0, 900_000).otherwise(3_600_000).cast("long"))
    plan = leads.sampling_plan(found, ends, 1_500_000)
    return plan.select("broadcast_id", N.round_half_up(F.col("start_ms"), 3).alias("start_ms"), N.round_half_up(F.col("end_ms"), 3).alias("end_ms"), F.array_join("kinds", "+").alias("kinds"))


def fingerprint_samples(spark, sf_dir):
    found = frames(spark, sf_dir)
    ends = found.groupBy("broadcast_id").agg((F.max("ts_ms") + 5000).alias("duration_ms"))
    return leads.fingerprint_plan(found, ends)


def storyboard_frames(spark, sf_dir):
    found = frames(spark, sf_dir)
    return leads.anchor_frames(found.groupBy("broadcast_id").agg((F.max("ts_ms") + 5000).alias("duration_ms")), 0.5, 25)


MUSIC = "(?i)" + P.MUSIC_CUES
TALK = f"""{CAPTIONS}, ends AS (SELECT broadcast_id, max(end_ms) AS d FROM captions GROUP BY ALL), own AS (SELECT * FROM captions WHERE role = 'user'), other AS (SELECT * FROM captions WHERE role <> 'user')"""
PLAN30 = "plan AS (SELECT broadcast_id, CAST(unnest(range(0, CAST(ceil(d / {0}) AS BIGINT))) AS INTEGER) AS cell, cell * {0} AS start_ms, least(d, (cell + 1) * {0}) AS end_ms FROM ends)"
CLIPS = f"{TALK}, clips AS (SELECT c.broadcast_id, c.broadcast_id * 1000 + cue AS id, cue, start_ms + 2000 AS s, start_ms + 14000 AS e, d, text FROM captions c JOIN ends USING (broadcast_id))"


def _texts(name: str, rows: str) -> str:
    """SQL: best text of each row (broadcast_id, id, s, e): captions' texts, which may end as it starts, else chapters'."""
    return f"""{name}_c AS (SELECT r.broadcast_id, r.id, trim(left(string_agg(c.text, ' ' ORDER BY c.start_ms, c.cue), 12000)) AS t FROM {rows} r JOIN own c ON c.broadcast_id = r.broadcast_id AND c.start_ms < r.e AND c.end_ms >= r.s GROUP BY ALL),
{name}_t AS (SELECT r.broadcast_id, r.id, trim(left(string_agg(c.text, ' ' ORDER BY c.start_ms, c.cue), 12000)) AS t FROM {rows} r JOIN other c ON c.broadcast_id = r.broadcast_id AND c.start_ms < r.e AND c.end_ms > r.s GROUP BY ALL),
{name} AS (SELECT r.broadcast_id, r.id, CASE WHEN c.t <> '' THEN c.t WHEN x.t <> '' THEN x.t END AS t, CASE WHEN c.t <> '' THEN 'caption' WHEN x.t <> '' THEN 'transcript' END AS source FROM {rows} r LEFT JOIN {name}_c c ON c.broadcast_id = r.broadcast_id AND c.id = r.id LEFT JOIN {name}_t x ON x.broadcast_id = r.broadcast_id AND x.id = r.id)"""


VISUAL = f"{CHAPTERS}, visual AS (SELECT broadcast_id, n AS chapter, start_ms, end_ms, md5(text) AS text FROM chapters WHERE doc_id % 2 = 0 AND doc_id % 3 <> 1)"
EVIDENCE = f"{CANDIDATES}, evidence AS (SELECT broadcast_id, peak_ms % 7 AS participant, {_case('peak_ms', KINDS)} AS kind, start_ms AS s, end_ms AS e FROM candidates WHERE kind <> 'semantic')"
NAMES = "coalesce(array_to_string(list_sort(list(DISTINCT participant) FILTER (WHERE kind IN {0})), ','), '')"
SOUND = " UNION ALL ".join(f"SELECT *, {n} AS n, '{kind}' AS sound, least(1.0, {' + '.join(f'coalesce(abs(embedding[{c + 1}]::DOUBLE), 0)' for c in classes)}) AS score FROM e" for n, (kind, classes) in enumerate(cx.SOUND_KINDS.items()))
FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
PLAN_SQL = f"""{CANDIDATES}, ends AS (SELECT DISTINCT broadcast_id, CASE WHEN broadcast_id % 4 = 0 THEN 900000 ELSE 3600000 END AS d FROM candidates),
near AS (SELECT broadcast_id, peak_ms FROM (SELECT DISTINCT broadcast_id, peak_ms FROM candidates) QUALIFY row_number() OVER (PARTITION BY broadcast_id ORDER BY peak_ms) <= 12),
events AS (SELECT broadcast_id, greatest(0, peak_ms - 60000)::DOUBLE AS s, least(d, peak_ms + 60000)::DOUBLE AS e, 'event' AS k FROM near JOIN ends USING (broadcast_id) WHERE d > 1500000 AND peak_ms < d),
used AS (SELECT broadcast_id, sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS used FROM (SELECT *, max(e) OVER (PARTITION BY broadcast_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM events) GROUP BY ALL),
axis AS (SELECT broadcast_id, unnest(range(0, 6)) * 600000 AS a, greatest(0.0, least(d::DOUBLE, 1500000.0 - coalesce(used, 0))) / 6 AS sample FROM ends LEFT JOIN used USING (broadcast_id) WHERE d > 1500000),
parts AS (SELECT *, CASE WHEN sample >= 600000 THEN 1 WHEN sample >= 90000 THEN 3 WHEN sample >= 40000 THEN 2 ELSE 1 END AS n FROM (SELECT broadcast_id, a, least(600000.0, sample) AS sample FROM axis) WHERE sample > 0),
ones AS (SELECT *, sample / n AS one, unnest(range(1, n + 1)) AS i FROM parts),
uniform AS (SELECT broadcast_id, CASE WHEN sample >= 600000 THEN a::DOUBLE ELSE greatest(a::DOUBLE, least(a + 600000 - one, a + i / (n + 1) * 600000 - one / 2)) END AS s, s + one AS e, 'uniform' AS k FROM ones),
every AS (SELECT * FROM events UNION ALL SELECT * FROM uniform),
reach AS (SELECT *, max(e) OVER (PARTITION BY broadcast_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM every),
isles AS (SELECT *, sum(CASE WHEN s > r THEN 1 ELSE 0 END) OVER (PARTITION BY broadcast_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT broadcast_id, min(s) AS s, max(e) AS e, array_to_string(list_sort(list(DISTINCT k)), '+') AS kinds FROM isles GROUP BY broadcast_id, island),
cut AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY broadcast_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM merged)"""

QUERIES = {
    "music_captions": (music_captions, f"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '[음악] ' || text WHEN turn % 4 = 1 THEN '[Music] 가나다 [박수] ' || text ELSE text END AS t FROM conversations),
      r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '{MUSIC}', ' ', 'g'), '(?i){P.SOUND_CUES}', ' ', 'g'), '{P.CUE_MARKS.replace("'", "''")}', ' ', 'g') AS rest FROM m) SELECT conv_id, turn, regexp_matches(t, '{MUSIC}') AND len(regexp_extract_all(rest, '[가-힣]')) < 2 AS music FROM r"""),
    "expandable_chunks": (expandable_chunks, f"SELECT conv_id, turn, length({FLAT}) >= 18 AND regexp_matches({FLAT}, '[?!？！]')::INT + regexp_matches({FLAT}, '(?i)(?:{P.EVENT_WORDS})')::INT + regexp_matches({FLAT}, '(?i)(?:{P.LINK_WORDS})')::INT + (turn % 3 = 0)::INT >= 2 AS expand FROM conversations"),
    "program_material": (program_material, "SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0"),
    "silent_segments": (silent_segments, "SELECT l_suppkey, count(*) FILTER (WHERE l_linenumber = 3 OR (l_partkey % 7 > 0 AND 0.9::DOUBLE + l_discount >= 0.98::DOUBLE AND -20 * l_tax <= -1)) AS n FROM lineitem GROUP BY ALL"),
    "chunk_quality": (chunk_quality, """WITH c AS (SELECT l_suppkey AS broadcast_id, l_orderkey % 10 AS id, l_linenumber * 1000 AS s, l_linenumber * 1000 + (l_quantity - 10) * 100 AS e, l_returnflag <> 'N' AS spoken, CASE WHEN l_partkey % 5 > 0 THEN l_discount * 11 END AS c, l_tax * 10 AS q, l_linenumber = 2 AS silent FROM lineitem),
      u AS (SELECT broadcast_id, id, CASE WHEN NOT (s < e AND least(6000, greatest(0, s)) < least(6000, greatest(0, e))) OR coalesce(c > 1, false) OR q > 1 THEN CASE WHEN spoken THEN 'low' ELSE 'empty' END WHEN silent OR q >= 0.65::DOUBLE THEN 'silent' WHEN NOT spoken THEN 'empty' WHEN coalesce(c < 0.45::DOUBLE, false) THEN 'low' ELSE 'usable' END AS u FROM c)
      SELECT broadcast_id, id, count(*) FILTER (WHERE u = 'usable') AS n_usable, count(*) FILTER (WHERE u = 'silent') AS n_silent, count(*) FILTER (WHERE u = 'low') AS n_low_quality, count(*) FILTER (WHERE u = 'empty') AS n_empty FROM u GROUP BY ALL"""),
    "gap_retries": (gap_retries, f"""WITH g AS (SELECT {_case('o_orderkey', GAPS)} AS reason, o_orderkey % 5 % 2 AS attempts, CASE WHEN o_orderkey % 7 < 3 THEN 'free-r2' ELSE 'paid-direct' END AS transport FROM orders), p AS (SELECT *, reason = 'outcome-unknown' OR (reason = 'in-flight' AND attempts > 0) AS billed FROM g)
      SELECT reason, attempts, transport, reason IN ('pending', 'decode-failed', 'transcription-failed', 'rate-limited') OR (transport = 'free-r2' AND billed) AS automatic, transport = 'paid-direct' AND billed AS paid, count(*) AS n FROM p GROUP BY ALL"""),
    "identity_bases": (identity_bases, """WITH g AS (SELECT o_orderkey AS id, CASE WHEN id % 7 = 0 THEN [id + 1, 0] WHEN id % 5 = 0 THEN [id + 2, 1] WHEN id % 3 = 0 THEN [id + 3, 2] WHEN id % 2 = 0 THEN [id + 4, 3] END AS g FROM orders),
      f AS (SELECT id, g[1] AS v, g[2] AS k, CASE WHEN g[1] % 11 = 0 THEN g[2] < 2 ELSE g[1] % 13 > 0 END AS ok FROM g)
      SELECT id, CASE WHEN ok THEN ['manual-pasted', 'registered-local-binding', 'visual-fingerprint-consensus', 'editor-confirmed-catalog'][k + 1] END AS basis, CASE WHEN ok THEN v END AS video_id FROM f"""),
    "merge_guards": (merge_guards, f"""SELECT CASE WHEN o_orderkey % 19 = 0 THEN 'segment_id_mismatch' WHEN o_orderkey % 17 = 0 THEN 'segment_trashed' WHEN o_orderkey % 4 = 3 THEN 'segment_rejected' WHEN o_orderkey % 4 = 2 THEN 'review_state_not_unreviewed' WHEN o_orderkey % 13 = 0 THEN 'user_is_editing'
      WHEN o_orderkey % 11 = 0 THEN 'proposal_is_pinned' WHEN o_orderkey % 7 = 0 THEN 'analysis_run_not_allowed' WHEN o_orderkey % 5 = 0 THEN 'user_revision_mismatch' END AS reason, count(*) AS n FROM orders GROUP BY ALL"""),
    "durations_compatible": (durations_compatible, "WITH t AS (SELECT o_orderkey, CAST(least(10000, greatest(2000, floor(floor(o_totalprice * 100) * 0.001::DOUBLE + 0.5))) AS BIGINT) AS tolerance FROM orders) SELECT *, o_orderkey % 9000 <= tolerance AS compatible FROM t"),
    "frame_brightness": (frame_brightness, f"WITH {FRAMES} SELECT vec_id, CAST(floor(0.2126::DOUBLE * luma[1] + 0.7152::DOUBLE * luma[2] + 0.0722::DOUBLE * luma[3] + 0.5) AS BIGINT) AS luma FROM frames"),
    "replay_numbers": (replay_numbers, "SELECT page_id, CASE WHEN page_id % 4 < 2 THEN CAST(page_id + 10000000 AS VARCHAR) END AS number FROM pages"),
    "stable_ids": (stable_ids, f"WITH {CANDIDATES} SELECT id, kind, left(sha256(length(kind) || ':' || kind || '|' || length(CAST(peak_ms AS VARCHAR)) || ':' || peak_ms), 16) AS stable_id FROM candidates"),
    "sentence_counts": (sentence_counts, "WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s"),
    "best_texts": (best_texts, f"WITH {TALK}, {PLAN30.format(10000)}, rows AS (SELECT broadcast_id, cell AS id, start_ms AS s, end_ms AS e FROM plan), {_texts('found', 'rows')} SELECT broadcast_id, id AS cell, source, md5(t) AS text FROM found"),
    "context_packets": (context_packets, f"""WITH {CLIPS}, b AS (SELECT broadcast_id, id, greatest(0, s - 120000) AS s, s AS e FROM clips WHERE s > 0), a AS (SELECT broadcast_id, id, e AS s, least(d, e + 120000) AS e FROM clips WHERE e < d), {_texts('mine', 'clips')}, {_texts('back', 'b')}, {_texts('fore', 'a')},
      near AS (SELECT k.id, (SELECT arg_max(trim(text), o.end_ms) FROM other o WHERE o.broadcast_id = k.broadcast_id AND o.end_ms <= k.s) AS b, (SELECT arg_min(trim(text), o.start_ms) FROM other o WHERE o.broadcast_id = k.broadcast_id AND o.start_ms >= k.e) AS a FROM clips k)
      SELECT k.id, mine.source, CASE WHEN k.id % 4 = 3 THEN 'review' ELSE ['select', 'review', 'reject'][k.id % 3 + 1] END AS decision, CASE WHEN k.id % 4 = 3 THEN 'uncertain' ELSE ['talk', 'game'][cue % 2 + 1] END AS category, md5(mine.t) AS text,
        md5(CASE WHEN k.s > 1000 THEN coalesce(back.t, near.b) END) AS before, md5(CASE WHEN k.e < k.d - 1000 THEN coalesce(fore.t, near.a) END) AS after
      FROM clips k JOIN mine USING (broadcast_id, id) LEFT JOIN back USING (broadcast_id, id) LEFT JOIN fore USING (broadcast_id, id) JOIN near ON near.id = k.id"""),
    "localized_leads": (localized_leads, f"""WITH {CLIPS}, l AS (SELECT broadcast_id, id AS lead, s, e + 31000 AS e, d, {WORDS.format('text')} AS w FROM clips WHERE d >= 30000),
      m AS (SELECT l.broadcast_id, lead, len(list_intersect(w, {WORDS.format('text')})) / len(w) AS score, start_ms, CAST(floor(start_ms + (end_ms - start_ms) / 2 + 0.5) AS BIGINT) AS mid FROM l JOIN other o ON o.broadcast_id = l.broadcast_id AND o.start_ms < l.e AND o.end_ms > l.s WHERE trim(text) <> '' AND len(w) > 0),
      b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY broadcast_id, lead ORDER BY score DESC, start_ms) = 1),
      p AS (SELECT lead, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) >= 0.2 THEN mid ELSE CAST(floor(s + (e - s) / 2 + 0.5) AS BIGINT) END AS peak_ms, d, least(45000, d) AS w FROM l LEFT JOIN b USING (broadcast_id, lead)),
      t AS (SELECT *, greatest(0, least(d - w, peak_ms - w // 2)) AS start_ms FROM p) SELECT lead, {rounded('score', 'score')}, peak_ms, start_ms, start_ms + w AS end_ms FROM t"""),
    "caption_cells": (caption_cells, f"WITH {TALK}, {PLAN30.format(30000)} SELECT p.broadcast_id, cell, count(*) AS n_cues, md5(left(string_agg(text, ' ' ORDER BY c.start_ms, c.cue), 12000)) AS text FROM plan p JOIN own c ON c.broadcast_id = p.broadcast_id AND c.start_ms < p.end_ms AND c.end_ms > p.start_ms GROUP BY ALL"),
    "refined_segments": (refined_segments, f"WITH {TALK}, {PLAN30.format(30000)} SELECT p.broadcast_id, p.start_ms, p.end_ms, md5(left(string_agg(text, ' ' ORDER BY c.start_ms, c.cue), 12000)) AS text FROM plan p JOIN own c ON c.broadcast_id = p.broadcast_id AND c.start_ms < p.end_ms AND c.end_ms > p.start_ms GROUP BY ALL HAVING trim(left(string_agg(text, ' ' ORDER BY c.start_ms, c.cue), 12000)) <> ''"),
    "bound_cues": (bound_cues, f"WITH {CAPTIONS}, d AS (SELECT broadcast_id, max(start_ms) - 5000 AS d FROM captions GROUP BY ALL) SELECT broadcast_id, cue, least(end_ms, d) AS end_ms FROM captions JOIN d USING (broadcast_id) WHERE start_ms < d"),
    "subtitle_gate": (subtitle_gate, f"""WITH {CAPTIONS}, k AS (SELECT broadcast_id, cue AS id, start_ms + 2500 AS s, start_ms + 40000 AS e FROM captions),
      h AS (SELECT k.broadcast_id, k.id, greatest(s, c.start_ms) AS a, least(e, c.end_ms) AS b FROM k JOIN captions c ON c.broadcast_id = k.broadcast_id AND greatest(s, c.start_ms) < least(e, c.end_ms)),
      r AS (SELECT *, max(b) OVER (PARTITION BY broadcast_id, id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM h), c AS (SELECT broadcast_id, id, sum(greatest(0, b - greatest(a, coalesce(r, a)))) AS covered FROM r GROUP BY ALL)
      SELECT broadcast_id, id, {rounded('share', 'coalesce(covered, 0) / 37500')}, coalesce(covered, 0) / 37500 >= 0.6 AS available FROM k LEFT JOIN c USING (broadcast_id, id)"""),
    "inspection_order": (inspection_order, f"""WITH {CANDIDATES}, {CELLS}, o AS (SELECT c.broadcast_id, cell, least(c.end_ms, k.end_ms) - greatest(c.start_ms, k.start_ms) AS o, k.id FROM cells c JOIN candidates k ON k.broadcast_id = c.broadcast_id AND kind = 'chat' AND greatest(c.start_ms, k.start_ms) < least(c.end_ms, k.end_ms)),
      p AS (SELECT broadcast_id, cell, max(o) AS o, string_agg(id, ',' ORDER BY o DESC, id) AS ids FROM o GROUP BY ALL), v AS (SELECT broadcast_id, CAST(peak_ms // 600000 AS INTEGER) AS cell, max(score) AS salience FROM candidates WHERE kind = 'visual' GROUP BY ALL),
      t AS (SELECT broadcast_id, cell, start_ms, coalesce(o, 0) / 600000 AS ratio, coalesce(salience, 0) AS salience, coalesce(ids, '') AS ids FROM cells LEFT JOIN p USING (broadcast_id, cell) LEFT JOIN v USING (broadcast_id, cell))
      SELECT broadcast_id, cell, {rounded('ratio', 'ratio')}, CASE WHEN ratio > 0 THEN 'candidate-overlap' WHEN salience > 0 THEN 'local-visual-salience' ELSE 'source-order' END AS basis, ids, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY ratio DESC, salience DESC, start_ms, cell) AS INTEGER) AS place FROM t"""),
    "verified_candidates": (verified_candidates, f"WITH {CANDIDATES} SELECT broadcast_id, id, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY start_ms, peak_ms, id) AS INTEGER) AS place FROM candidates WHERE id % 3 = 0"),
    "projected_ranges": (projected_ranges, f"""WITH {CANDIDATES}, s AS (SELECT broadcast_id, id, least(3600000, greatest(0, start_ms)) AS a, least(3600000, greatest(0, end_ms)) AS b FROM candidates), r AS (SELECT broadcast_id, id, a, b + id % 5 * 100000 AS b FROM s WHERE b > a),
      t AS (SELECT id, CAST(least(2700000, floor(a / 3600000 * 2700000 + 0.5)) AS BIGINT) AS s, least(2700000, greatest(s + 1, CAST(floor(b / 3600000 * 2700000 + 0.5) AS BIGINT))) AS e FROM r), c AS (SELECT CAST(range AS INTEGER) AS cell, range * 300000 AS a, (range + 1) * 300000 AS b FROM range(0, 9) WHERE range <> 4),
      m AS (SELECT id, any_value(s) AS s, any_value(e) AS e, min(cell) AS f, max(cell) AS l, count(*) AS n FROM t JOIN c ON c.a < t.e AND c.b > t.s WHERE s < e GROUP BY id), w AS (SELECT *, l - f + 1 = n AND f * 300000 <= s AND (l + 1) * 300000 >= e AS ok FROM m)
      SELECT r.id, CASE WHEN ok THEN f END AS first, CASE WHEN ok THEN l END AS last, CASE WHEN ok THEN f * 300000 END AS first_ms, CASE WHEN ok THEN (l + 1) * 300000 END AS last_ms FROM r LEFT JOIN w USING (id)"""),
    "range_participants": (range_participants, f"WITH {EVIDENCE}, {CELLS} SELECT c.broadcast_id, cell AS id, {NAMES.format(cx.SEEN)} AS seen, {NAMES.format(cx.HEARD)} AS heard, {NAMES.format((*cx.MENTIONED, ''))} AS mentioned FROM cells c JOIN evidence v ON v.broadcast_id = c.broadcast_id AND v.s < c.end_ms AND v.e > c.start_ms GROUP BY ALL"),
    "grounding": (grounding, f"""WITH {EVIDENCE}, p AS (SELECT broadcast_id, unnest(range(0, 9)) AS participant FROM (SELECT DISTINCT broadcast_id FROM candidates)), c AS (SELECT broadcast_id, participant, count(*) FILTER (WHERE kind = 'transcript-name-mention') AS m, count(*) FILTER (WHERE kind <> 'transcript-name-mention') AS o FROM evidence GROUP BY ALL),
      j AS (SELECT broadcast_id, participant, coalesce(m, 0) AS n_mentions, coalesce(o, 0) AS n_observed FROM p LEFT JOIN c USING (broadcast_id, participant)) SELECT *, CASE WHEN max(n_observed) OVER w > 0 THEN 'observed-identities' WHEN max(n_mentions) OVER w > 0 THEN 'transcript-mentions' ELSE 'catalog-only' END AS status FROM j WINDOW w AS (PARTITION BY broadcast_id)"""),
    "visual_chapters": (visual_chapters, f"WITH {VISUAL} SELECT broadcast_id, chapter, start_ms, text FROM visual"),
    "all_chapters": (all_chapters, f"""WITH {VISUAL}, b AS (SELECT broadcast_id, n AS chapter, start_ms, end_ms, 0 AS side FROM chapters UNION ALL SELECT broadcast_id, chapter, start_ms, end_ms, 1 FROM visual),
      v AS (SELECT *, row_number() OVER (PARTITION BY broadcast_id, chapter ORDER BY start_ms, end_ms, side) > 1 AS r, start_ms < coalesce(max(end_ms) OVER (PARTITION BY broadcast_id ORDER BY start_ms, end_ms, chapter, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, row_number() OVER (PARTITION BY broadcast_id ORDER BY start_ms, end_ms, chapter, side) AS p FROM b)
      SELECT broadcast_id, CASE WHEN r THEN 'repeated-id' WHEN o THEN 'overlap' END AS violation, count(*) AS n, CAST(max(p) AS INTEGER) AS last FROM v GROUP BY 1, 2"""),
    "chapter_upserts": (chapter_upserts, f"WITH {CHAPTERS} SELECT broadcast_id, printf('transcript-%03d', row_number() OVER (PARTITION BY broadcast_id ORDER BY start_ms)) AS chapter, start_ms, md5(text) || CASE WHEN doc_id % 3 > 0 THEN '!' ELSE '' END AS text, false AS overlaps FROM chapters"),
    "source_rosters": (source_rosters, """WITH s AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 0 THEN c_nationkey END AS a, c_custkey % 40 AS k FROM customer), j AS (SELECT source, a, n_nationkey AS b FROM s LEFT JOIN nation ON n_nationkey = k)
      SELECT source, coalesce(a, b) AS roster, CASE WHEN a IS NOT NULL THEN 'channel' WHEN b IS NOT NULL THEN 'name' END AS basis FROM j"""),
    "recoverable_results": (recoverable_results, """WITH t AS (SELECT o_custkey AS owner, o_orderkey AS run_id, o_orderdate AS made, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 9 <> 0 AS sound FROM orders WHERE o_orderstatus = 'F'),
      p AS (SELECT *, row_number() OVER (PARTITION BY owner, sound ORDER BY made DESC, run_id) AS place, count(*) FILTER (WHERE NOT sound) OVER (PARTITION BY owner) AS n_skipped FROM t) SELECT owner, run_id, CAST(place AS INTEGER) AS place, n_skipped FROM p WHERE sound AND place <= 3"""),
    "sound_events": (sound_events, f"""WITH e AS (SELECT label AS broadcast_id, vec_id // 3 AS id, vec_id % 3 AS phase, vec_id * 10000 AS start_ms, embedding FROM embeddings), s AS ({SOUND}),
      p AS (SELECT broadcast_id, id, n, sound AS kind, max(score) AS peak, count(*) FILTER (WHERE score >= 0.2) AS n_windows, first(start_ms ORDER BY score DESC, phase, start_ms) AS start_ms FROM s GROUP BY ALL HAVING max(score) >= 0.2), q AS (SELECT *, CASE WHEN peak >= 0.5 OR n_windows >= 2 THEN 'strong' ELSE 'possible' END AS strength FROM p)
      SELECT broadcast_id, id, kind, {rounded('peak', 'peak')}, n_windows, start_ms, strength, CAST(row_number() OVER (PARTITION BY broadcast_id, id ORDER BY strength = 'possible', q.peak DESC, n_windows DESC, n) AS INTEGER) AS place FROM q QUALIFY place <= 2"""),
    "edit_list": (edit_list, f"""WITH {CANDIDATES}, e AS (SELECT broadcast_id, id, id % 2 = 0 AS edited, id % 2 = 0 AND id % 5 % 3 = id % 3 AS own, start_ms + CASE WHEN own THEN 60000 ELSE 0 END AS s, end_ms + CASE WHEN own THEN 50000 ELSE 0 END AS e FROM candidates)
      SELECT broadcast_id, id, s AS start_ms, e AS end_ms, CASE WHEN own THEN 'edit' WHEN edited THEN 'stale-edit' ELSE 'proposal' END AS source, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY s, e, id) AS INTEGER) AS place FROM e"""),
    "signal_union": (signal_union, f"WITH {CANDIDATES} SELECT broadcast_id, CASE kind WHEN 'audio' THEN 'sound' ELSE 'talk' END AS origin, count(*) AS n, count(*) FILTER (WHERE kind = 'audio') AS n_scores, count(*) FILTER (WHERE kind = 'chat') AS n_peaks FROM candidates WHERE kind IN ('audio', 'chat') GROUP BY ALL"),
    "shared_evidence": (shared_evidence, f"WITH {CANDIDATES} SELECT broadcast_id, count(*) FILTER (WHERE id % 4 > 0 AND (peak_ms % 3 = id % 7 OR peak_ms % 5 = id % 7)) AS n FROM candidates GROUP BY ALL"),
    "set_fingerprints": (set_fingerprints, f"WITH {CANDIDATES} SELECT broadcast_id, sha256(string_agg(id || '|' || kind || '|' || CAST(floor(score * 1000000 + 0.5) AS BIGINT), chr(10) ORDER BY id)) AS fingerprint FROM candidates GROUP BY ALL"),
    "semantic_leads": (semantic_leads, f"WITH {CANDIDATES} SELECT 'semantic-' || id AS id, peak_ms, {rounded('score', 'score')}, 'talk' AS category FROM candidates WHERE kind = 'semantic' AND candidates.score BETWEEN 0 AND 1"),
    "stage_commits": (stage_commits, """WITH g AS (SELECT o_custkey AS owner, count(*) FILTER (WHERE o_orderstatus = 'P') = 0 AS context_complete, count(*) FILTER (WHERE o_orderstatus = 'O') < 3 AS selection_ready, count(*) FILTER (WHERE o_orderpriority = '5-LOW') > 1 AS has_gap FROM orders GROUP BY ALL), d AS (SELECT *, context_complete AND selection_ready AND NOT has_gap AS deep_pass FROM g)
      SELECT *, context_complete AS broadcast_context, deep_pass AS publication, deep_pass AS completion FROM d"""),
    "merged_leads": (merged_leads, f"""WITH RECURSIVE {CANDIDATES}, l AS (SELECT broadcast_id, id, kind, start_ms AS s, end_ms AS e, peak_ms % 200 AS a, 0 AS b, row_number() OVER (PARTITION BY broadcast_id, kind ORDER BY score DESC, start_ms, id) AS r FROM candidates),
      {greedy_sql("chosen", "l", "r, kind", 32, "t.a = r.a OR (least(t.e - t.s, r.e - r.s) > 0 AND least(t.e - t.s, r.e - r.s) >= 0.5 * greatest(t.e - t.s, r.e - r.s) AND greatest(0, least(t.e, r.e) - greatest(t.s, r.s)) >= 0.8 * least(t.e - t.s, r.e - r.s))")} SELECT broadcast_id, id AS lead, CAST(pick AS INTEGER) AS pick FROM chosen"""),
    "topic_slices": (topic_slices, f"""WITH {CANDIDATES}, parts AS (SELECT broadcast_id, CAST(unnest(range(0, 12)) AS INTEGER) AS n, n * 300000 AS a, (n + 1) * 300000 AS b FROM (SELECT DISTINCT broadcast_id FROM candidates)),
      t AS (SELECT broadcast_id, id, start_ms AS s, end_ms + id % 7 * 60000 AS e FROM candidates WHERE kind = 'visual' AND broadcast_id % 3 > 0 AND id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY broadcast_id ORDER BY (id % 2 = 0) DESC, e - s DESC, s, id) <= 4),
      k AS (SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY s, id) AS slice FROM t)
      SELECT p.broadcast_id, n, CAST(slice AS INTEGER) AS slice, 'topic' AS basis FROM parts p JOIN k ON k.broadcast_id = p.broadcast_id AND greatest(a, s) < least(b, e) UNION ALL SELECT broadcast_id, n, CAST(((n + 1) * 4 - 1) // 12 + 1 AS INTEGER), 'coverage' FROM parts WHERE broadcast_id NOT IN (SELECT broadcast_id FROM k)"""),
    "refinement_leads": (refinement_leads, None),
    "refinement_cells": (refinement_cells, None),
    "scattered_order": (scattered_order, None),
    "pending_order": (pending_order, f"""WITH {CHAPTERS}, p AS (SELECT broadcast_id, n, -doc_id AS place FROM chapters WHERE n % 3 <> 1), k AS (SELECT broadcast_id, n, row_number() OVER (PARTITION BY broadcast_id ORDER BY abs(n - 11), n) AS k FROM p WHERE n <> 11 QUALIFY k <= 3),
      g AS (SELECT broadcast_id, n, row_number() OVER (PARTITION BY broadcast_id ORDER BY place) AS g FROM p ANTI JOIN k USING (broadcast_id, n)), u AS (SELECT broadcast_id, n, CASE WHEN k = 1 THEN 1 ELSE k + 1 END AS key FROM k UNION ALL SELECT broadcast_id, n, CASE WHEN g = 1 AND (SELECT count(*) FROM k WHERE k.broadcast_id = g.broadcast_id) > 1 THEN 2 ELSE 1000000 + g END FROM g)
      SELECT broadcast_id, n, CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY key) AS INTEGER) AS pick FROM u"""),
    "listening_plan": (listening_plan, f"""WITH {PLAN_SQL} SELECT broadcast_id, {rounded('start_ms', 's', 3)}, {rounded('end_ms', 'least(e, s + 1500000 - before)', 3)}, kinds FROM cut WHERE before < 1500000 UNION ALL SELECT broadcast_id, 0, d, 'uniform' FROM ends WHERE d <= 1500000"""),
    "fingerprint_samples": (fingerprint_samples, f"WITH {FRAMES}, d AS (SELECT broadcast_id, max(ts_ms) + 5000 AS d FROM frames GROUP BY ALL) SELECT DISTINCT broadcast_id, ts_ms + o AS ts_ms FROM (SELECT broadcast_id, ts_ms, unnest(range(-30000, 35000, 5000)) AS o FROM frames) JOIN d USING (broadcast_id) WHERE ts_ms + o >= 0 AND ts_ms + o < d"),
    "storyboard_frames": (storyboard_frames, f"""WITH {FRAMES}, d AS (SELECT broadcast_id, max(ts_ms) + 5000 AS d, greatest(1, CAST(ceil((max(ts_ms) + 5000) / 1000 * 0.5) AS BIGINT)) AS total FROM frames GROUP BY ALL), a AS (SELECT *, unnest(range(1, 13)) AS anchor FROM d),
      t AS (SELECT *, CAST(floor((total - 1) * (anchor / 13) + 0.5) AS BIGINT) AS target FROM a), f AS (SELECT *, target + unnest(range(-2, 3)) AS frame FROM t)
      SELECT broadcast_id, CAST(anchor AS INTEGER) AS anchor, frame, frame // 25 AS sheet, frame % 25 AS tile, least(d - 1, CAST(floor(frame / 0.5 * 1000 + 0.5) AS BIGINT)) AS ts_ms FROM f WHERE frame >= 0 AND frame < total AND frame // 25 = target // 25"""),
}
