"""Context of candidates: texts in and around a range, packets, participants, projections, sound events, edit lists.

Ranges are half-open (start_ms, end_ms) within a broadcast_id; texts are cues or chapters (r_start, r_end, r_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from .gates import effective_ranges
from .intervals import cells, covered_ms, nearest, overlap_join, text_in_range

#: Reach of the texts around a candidate, and how near to the end of the source is its edge.
AROUND_MS, EDGE_MS = 120_000, 1_000


def best_text(ranges: DataFrame, captions: DataFrame, chapters: DataFrame, ident: str) -> DataFrame:
    """The caption text of each range, else that of the chapters, and where it comes from; null if there is neither."""
    own = text_in_range(ranges, captions, ["broadcast_id"], ident, most=12_000).select("broadcast_id", ident, F.col("text").alias("_c"))
    other = text_in_range(ranges, chapters, ["broadcast_id"], ident, inclusive=False, most=12_000).select("broadcast_id", ident, F.col("text").alias("_t"))
    both = ranges.join(own, ["broadcast_id", ident], "left").join(other, ["broadcast_id", ident], "left")
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    source = F.when(filled("_c").isNotNull(), "caption").when(filled("_t").isNotNull(), "transcript")
    return both.withColumn("text", F.coalesce(filled("_c"), filled("_t"))).withColumn("source", source).drop("_c", "_t")


def around(candidates: DataFrame, captions: DataFrame, chapters: DataFrame, side: str) -> DataFrame:
    """Text of two minutes before or after each candidate(broadcast_id, id, start_ms, end_ms, duration_ms), else that of
    the nearest chapter; none at the edge of the source."""
    before = side == "before"
    start, end = (F.greatest(F.lit(0), F.col("start_ms") - AROUND_MS), F.col("start_ms")) if before else (F.col("end_ms"), F.least(F.col("duration_ms"), F.col("end_ms") + AROUND_MS))
    edge = F.col("start_ms") <= EDGE_MS if before else F.col("end_ms") >= F.col("duration_ms") - EDGE_MS
    rows = candidates.select("broadcast_id", "id", edge.alias("_edge"), F.col("start_ms" if before else "end_ms").alias("at_ms"), start.alias("start_ms"), end.alias("end_ms"))
    found = best_text(rows.where("start_ms < end_ms").drop("at_ms", "_edge"), captions, chapters, "id").select("broadcast_id", "id", F.col("text").alias("_near"))
    near = nearest(rows.select("broadcast_id", "id", "at_ms"), chapters.select("broadcast_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms"), "text"), "broadcast_id", forward=not before)
    out = rows.join(found, ["broadcast_id", "id"], "left").join(near.select("broadcast_id", "id", F.trim("chapter.text").alias("_far")), ["broadcast_id", "id"], "left")
    return out.select("broadcast_id", "id", F.when(~F.col("_edge"), F.coalesce("_near", "_far")).alias(side))


def context_packets(candidates: DataFrame, captions: DataFrame, chapters: DataFrame, annotations: DataFrame) -> DataFrame:
    """What is known of each candidate(broadcast_id, id, start_ms, end_ms, duration_ms): its text and the texts around,
    and the decision and category of its annotation(id, decision, category); without one it is up for review."""
    own = best_text(candidates.select("broadcast_id", "id", "start_ms", "end_ms"), captions, chapters, "id").select("broadcast_id", "id", "text", "source")
    out = candidates.join(own, ["broadcast_id", "id"])
    for side in ("before", "after"):
        out = out.join(around(candidates, captions, chapters, side), ["broadcast_id", "id"])
    out = out.join(annotations.select("id", "decision", "category"), "id", "left")
    return out.select("broadcast_id", "id", "text", "source", "before", "after", F.coalesce("decision", F.lit("review")).alias("decision"), F.coalesce("category", F.lit("uncertain")).alias("category"))


def verified_only(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """The verified candidates with their place in time."""
    kept = candidates.join(verified.select("id").distinct(), "id", "left_semi")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("broadcast_id").orderBy("start_ms", "peak_ms", "id")))


def cell_priority(plan: DataFrame, candidates: DataFrame, salience: DataFrame) -> DataFrame:
    """Order of inspection of planned cells(broadcast_id, cell, start_ms, end_ms): first those that a candidate covers,
    by the share that the best one covers, then by salience(broadcast_id, cell, salience), then by time."""
    right = candidates.select("broadcast_id", F.col("id").alias("r_id"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = overlap_join(plan, right, ["broadcast_id"]).withColumn("_over", F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start"))
    per = met.groupBy("broadcast_id", "cell").agg(F.max("_over").alias("_over"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_over")).alias("o"), "r_id"))), lambda x: x["r_id"]).alias("ids"))
    out = plan.join(per, ["broadcast_id", "cell"], "left").join(salience, ["broadcast_id", "cell"], "left")
    out = out.withColumn("ratio", F.coalesce(F.col("_over") / (F.col("end_ms") - F.col("start_ms")), F.lit(0.0))).withColumn("salience", F.coalesce("salience", F.lit(0.0))).withColumn("ids", F.coalesce("ids", F.array().cast(per.schema["ids"].dataType)))
    basis = F.when(F.col("ratio") > 0, "candidate-overlap").when(F.col("salience") > 0, "local-visual-salience").otherwise("source-order")
    order = W.partitionBy("broadcast_id").orderBy(F.desc("ratio"), F.desc("salience"), "start_ms", "cell")
    return out.withColumn("basis", basis).withColumn("place", F.row_number().over(order)).drop("_over")


def refinement_chapters(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Planned segments(broadcast_id, start_ms, end_ms) with the text of exactly their range."""
    return segments.join(transcripts.select("broadcast_id", "start_ms", "end_ms", "text"), ["broadcast_id", "start_ms", "end_ms"]).where(F.trim("text") != "")


def localize_leads(leads: DataFrame, transcripts: DataFrame, width_ms: int = 45_000, least: float = 0.2) -> DataFrame:
    """Peak and range of each lead(broadcast_id, lead, start_ms, end_ms, duration_ms, cue): the middle of the overlapping
    transcript(r_start, r_end, text) that has most of the cue's words, if it has a fifth of them, else its own middle."""
    met = overlap_join(leads, transcripts.where(F.trim("text") != ""), ["broadcast_id"])
    met = met.withColumn("score", T.match_ratio(T.terms(F.col("cue")), T.terms(F.col("text"))))
    order = W.partitionBy("broadcast_id", "lead").orderBy(F.desc("score"), "r_start")
    best = met.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("broadcast_id", "lead", "score", N.round_half_up(F.col("r_start") + (F.col("r_end") - F.col("r_start")) / 2).cast("long").alias("_peak"))
    out = leads.join(best, ["broadcast_id", "lead"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = N.round_half_up(F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) / 2).cast("long")
    width = F.least(F.lit(width_ms), F.col("duration_ms"))
    out = out.withColumn("peak_ms", F.when(F.col("score") >= least, F.col("_peak")).otherwise(own)).withColumn("_w", width)
    start = N.clamp(F.col("peak_ms") - F.floor(F.col("_w") / 2), 0, F.col("duration_ms") - F.col("_w")).cast("long")
    return out.select("broadcast_id", "lead", "score", "peak_ms", start.alias("start_ms"), (start + F.col("_w")).cast("long").alias("end_ms"))


def project_timeline(ranges: DataFrame, chapters: DataFrame) -> DataFrame:
    """Ranges(broadcast_id, id, start_ms, end_ms, from_ms, to_ms) of a source of length from_ms, on the chapters(r_start,
    r_end, r_id) of one of length to_ms: first and last chapter met, null if they leave a part or a hole."""
    scale = lambda c: N.clamp(N.round_half_up(F.col(c) / F.col("from_ms") * F.col("to_ms")), 0, F.col("to_ms")).cast("long")
    scaled = ranges.select("broadcast_id", "id", scale("start_ms").alias("start_ms"), F.least(F.col("to_ms"), F.greatest(scale("start_ms") + 1, scale("end_ms"))).alias("end_ms"))
    met = overlap_join(scaled.where("start_ms < end_ms"), chapters, ["broadcast_id"])
    order = W.partitionBy("broadcast_id", "id").orderBy("r_start", "r_end")
    met = met.withColumn("_hole", F.col("r_start") > F.lag("r_end").over(order))
    per = met.groupBy("broadcast_id", "id").agg(
        F.min(F.struct("r_start", "r_id")).alias("a"), F.max(F.struct("r_end", "r_id")).alias("b"), F.max(F.coalesce("_hole", F.lit(False))).alias("_hole"), F.first("start_ms").alias("s"), F.first("end_ms").alias("e"),
    )
    whole = ~F.col("_hole") & (F.col("a.r_start") <= F.col("s")) & (F.col("b.r_end") >= F.col("e"))
    pick = lambda c: F.when(whole, F.col(c))
    out = per.select("broadcast_id", "id", pick("a.r_id").alias("first"), pick("b.r_id").alias("last"), pick("a.r_start").alias("first_ms"), pick("b.r_end").alias("last_ms"))
    return ranges.select("broadcast_id", "id").join(out, ["broadcast_id", "id"], "left")


#: Kinds of evidence and how they know a participant.
SEEN, HEARD, MENTIONED = ("on-screen-name", "visual-reference-match"), ("spoken-self-identification", "voice-reference-match"), ("transcript-name-mention",)


def participants_in_range(ranges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Who is seen, heard or mentioned in each range: evidence(broadcast_id, participant, kind, r_start, r_end)."""
    met = overlap_join(ranges, evidence, ["broadcast_id"])
    names = lambda kinds: F.sort_array(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("participant"))))
    return met.groupBy("broadcast_id", "id").agg(names(SEEN).alias("seen"), names(HEARD).alias("heard"), names(MENTIONED).alias("mentioned"))


def grounding_summary(participants: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mentions of each participant(broadcast_id, participant) and how far the broadcast's people are known."""
    per = evidence.groupBy("broadcast_id", "participant").agg(F.count_if(F.col("kind").isin(*MENTIONED)).alias("n_mentions"), F.count_if(F.col("kind").isin(*SEEN, *HEARD)).alias("n_observed"))
    out = participants.join(per, ["broadcast_id", "participant"], "left").fillna(0, ["n_mentions", "n_observed"])
    whole = W.partitionBy("broadcast_id")
    status = F.when(F.max("n_observed").over(whole) > 0, "observed-identities").when(F.max("n_mentions").over(whole) > 0, "transcript-mentions").otherwise("catalog-only")
    return out.withColumn("status", status)


def visual_chapters(plan: DataFrame, settlements: DataFrame) -> DataFrame:
    """Chapters from pictures for planned cells(broadcast_id, cell, start_ms, end_ms, purpose) without dialogue whose
    inspection(broadcast_id, cell, outcome, summary) has come to an end."""
    ended = settlements.where(F.col("outcome").isin("completed", "excluded-music-only"))
    return plan.where("purpose = 'transcript-abstention'").join(ended, ["broadcast_id", "cell"]).select("broadcast_id", F.col("cell").alias("chapter"), "start_ms", "end_ms", F.col("summary").alias("text"), F.lit(1.0).alias("ratio"))


def union_chapters(transcript: DataFrame, visual: DataFrame) -> DataFrame:
    """Chapters of both, in order, with a mark on those whose id repeats or that begin before an earlier one ends."""
    columns = ["broadcast_id", "chapter", "start_ms", "end_ms", "text"]
    order = W.partitionBy("broadcast_id").orderBy("start_ms", "end_ms", "chapter", "_side")
    both = transcript.select(*columns, F.lit(0).alias("_side")).unionByName(visual.select(*columns, F.lit(1).alias("_side")))
    repeated = F.row_number().over(W.partitionBy("broadcast_id", "chapter").orderBy("start_ms", "end_ms", "_side")) > 1
    late = F.col("start_ms") < F.coalesce(F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return both.withColumn("violation", F.when(repeated, "repeated-id").when(late, "overlap")).withColumn("place", F.row_number().over(order)).drop("_side")


def upsert_chapters(existing: DataFrame, recovered: DataFrame) -> DataFrame:
    """Cells(broadcast_id, start_ms, end_ms, text) where a newer one replaces that of the same range, numbered anew; a
    cell that begins before an earlier one ends is marked."""
    columns = ["broadcast_id", "start_ms", "end_ms", "text"]
    both = existing.select(*columns, F.lit(0).alias("_age")).unionByName(recovered.select(*columns, F.lit(1).alias("_age"))).where((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & (F.trim("text") != ""))
    newest = both.withColumn("_n", F.row_number().over(W.partitionBy("broadcast_id", "start_ms", "end_ms").orderBy(F.desc("_age"), "text"))).where("_n = 1")
    order = W.partitionBy("broadcast_id").orderBy("start_ms", "end_ms")
    late = F.col("start_ms") < F.coalesce(F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    name = F.format_string("transcript-%03d", F.row_number().over(order))
    return newest.select(*columns, name.alias("chapter"), late.alias("overlaps"))


def resolve_roster(sources: DataFrame, rosters: DataFrame) -> DataFrame:
    """Roster of each source(source, channel_id, name): by its channel, else by an owner whose name or alias stands as a
    word in the source's name. rosters(roster, channel_id, owner); the longest name wins."""
    by_channel = rosters.select("channel_id", F.col("roster").alias("_a")).where("channel_id is not null").groupBy("channel_id").agg(F.min("_a").alias("_a"))
    words = sources.select("source", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), r"[\s_\-\[\](){}]+"), lambda w: w != ""))).alias("word"))
    by_name = words.join(rosters.select(F.lower("owner").alias("word"), F.col("roster").alias("_b")), "word")
    by_name = by_name.groupBy("source").agg(F.min(F.struct((-F.char_length("word")).alias("n"), "word", "_b"))["_b"].alias("_b"))
    both = sources.join(by_channel, "channel_id", "left").join(by_name, "source", "left")
    return both.select("source", F.coalesce("_a", "_b").alias("roster"), F.when(F.col("_a").isNotNull(), "channel").when(F.col("_b").isNotNull(), "name").alias("basis"))


def recoverable_results(terminals: DataFrame, manifests: DataFrame, finals: DataFrame, most: int = 5) -> DataFrame:
    """The newest results of each owner whose manifest and final record agree with the terminal record(owner, run_id,
    status, at, kind, digest): manifests(run_id, digest), finals(run_id, kind, digest)."""
    done = terminals.where("status = 'completed'")
    m, f = manifests.select("run_id", F.col("digest").alias("_m")), finals.select("run_id", F.col("kind").alias("_k"), F.col("digest").alias("_f"))
    both = done.join(m, "run_id", "left").join(f, "run_id", "left")
    sound = F.col("_m").isNotNull() & F.col("_f").isNotNull() & F.col("_k").eqNullSafe(F.col("kind")) & F.col("_m").eqNullSafe(F.col("digest")) & F.col("_f").eqNullSafe(F.col("digest"))
    marked = both.withColumn("sound", sound)
    order = W.partitionBy("owner", "sound").orderBy(F.desc("at"), "run_id")
    marked = marked.withColumn("place", F.row_number().over(order)).withColumn("n_skipped", F.count_if(~F.col("sound")).over(W.partitionBy("owner")))
    return marked.where(F.col("sound") & (F.col("place") <= most)).select("owner", "run_id", "place", "n_skipped")


#: Kinds of sound events and the class numbers that count for them.
SOUND_KINDS = {"laughter": (16, 18, 19, 20, 21), "shout": (8, 9, 10, 11), "scream": (14,), "applause-or-cheering": (63, 66, 67)}
PHASES = ("near", "before", "after")


def audio_events(scores: DataFrame, possible: float = 0.2, strong: float = 0.5, most: int = 2) -> DataFrame:
    """The best kinds of sound of each candidate from its windows(broadcast_id, id, phase, start_ms, scores): the scores
    of a kind's classes added up to one, strong if high once or possible in two windows."""
    kinds = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(name).alias("kind"), F.least(F.lit(1.0), sum((F.coalesce(F.get("scores", F.lit(c)).cast("double"), F.lit(0.0)) for c in classes[1:]), F.coalesce(F.get("scores", F.lit(classes[0])).cast("double"), F.lit(0.0)))).alias("score")) for k, (name, classes) in enumerate(SOUND_KINDS.items())))
    rows = scores.select("broadcast_id", "id", "phase", "start_ms", F.explode(kinds).alias("k")).select("broadcast_id", "id", "start_ms", "k.*", F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")).alias("_p"))
    per = rows.groupBy("broadcast_id", "id", "n", "kind").agg(F.max("score").alias("peak"), F.count_if(F.col("score") >= possible).alias("n_windows"), F.min(F.struct((-F.col("score")).alias("s"), "_p", "start_ms"))["start_ms"].alias("start_ms"))
    per = per.where(F.col("peak") >= possible).withColumn("strength", F.when((F.col("peak") >= strong) | (F.col("n_windows") >= 2), "strong").otherwise("possible"))
    order = W.partitionBy("broadcast_id", "id").orderBy((F.col("strength") == "possible").cast("int"), F.desc("peak"), F.desc("n_windows"), "n")
    return per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("n")


def filter_chunks(chunks: DataFrame, least: float = 0.45, silence: float = 0.65) -> DataFrame:
    """Chunks(broadcast_id, id, start_ms, end_ms, duration_ms, text, confidence, no_speech, silent) with their use: usable,
    silent, low-quality or empty. Times are cut to the candidate's length; probabilities must be such."""
    text = F.trim(F.coalesce("text", F.lit("")))
    probability = lambda c: F.col(c).isNull() | (~F.isnan(c) & F.col(c).between(0, 1))
    start, end = N.clamp(F.col("start_ms"), 0, F.col("duration_ms")), N.clamp(F.col("end_ms"), 0, F.col("duration_ms"))
    bad = ~F.coalesce((F.col("start_ms") < F.col("end_ms")) & (start < end), F.lit(False)) | ~(probability("confidence") & probability("no_speech"))
    quiet = F.coalesce(F.col("silent"), F.lit(False)) | F.coalesce(F.col("no_speech") >= silence, F.lit(False))
    low = F.coalesce(F.col("confidence") < least, F.lit(False))
    use = F.when(bad, F.when(text != "", "low-quality").otherwise("empty")).when(quiet, "silent").when(text == "", "empty").when(low, "low-quality").otherwise("usable")
    return chunks.withColumn("use", use)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks of each candidate by their use."""
    return filter_chunks(chunks).groupBy("broadcast_id", "id").agg(*(F.count_if(F.col("use") == u).alias("n_" + u.replace("-", "_")) for u in ("usable", "silent", "low-quality", "empty")))


def subtitle_available(cues: DataFrame, clips: DataFrame, least: float = 0.6) -> DataFrame:
    """Share of each clip(broadcast_id, id, start_ms, end_ms) that its cues cover together, and whether that is enough."""
    right = cues.select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")).where("r_end > r_start")
    met = overlap_join(clips, right, ["broadcast_id"]).select("broadcast_id", "id", F.greatest("start_ms", "r_start").alias("start_ms"), F.least("end_ms", "r_end").alias("end_ms"))
    share = F.coalesce(F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms")), F.lit(0.0))
    return clips.join(covered_ms(met, ["broadcast_id", "id"]), ["broadcast_id", "id"], "left").select("broadcast_id", "id", share.alias("share"), (share >= least).alias("available"))


def edit_list(proposals: DataFrame, edits: DataFrame) -> DataFrame:
    """Approved candidates(broadcast_id, id, revision, start_ms, end_ms) by the time of the range that holds for them."""
    ranges = effective_ranges(proposals, edits).join(proposals.select("broadcast_id", "id"), "id")
    return ranges.withColumn("place", F.row_number().over(W.partitionBy("broadcast_id").orderBy("start_ms", "end_ms", "id")))


def union_signals(signals: dict[str, DataFrame]) -> DataFrame:
    """Candidates of several signals as one table with their origin; columns that a signal lacks are null."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in signals.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def shares_any(left: Column, right: Column) -> Column:
    """Whether two sets have a member in common; null counts as empty."""
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def bound_cues(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Cues that begin within the source; the last of them end with it."""
    held = cues.join(durations.select("broadcast_id", "duration_ms"), "broadcast_id").where("start_ms < duration_ms")
    return held.withColumn("end_ms", F.least("end_ms", "duration_ms")).drop("duration_ms")


def caption_cells(cues: DataFrame, durations: DataFrame, step_ms: int) -> DataFrame:
    """Text of the cues(r_start, r_end, r_id, text) of each fixed cell; cells without any are left out."""
    plan = cells(durations, step_ms).select("broadcast_id", "cell", "start_ms", "end_ms")
    return plan.join(text_in_range(plan, cues, ["broadcast_id"], "cell", inclusive=False, most=12_000), ["broadcast_id", "cell"])


def snapshot_fingerprint(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One digest over the ordered rows of each key; doubles count to six digits."""
    item = F.struct(*order, *(F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.col(c).cast("string")).alias(f"_{c}") for c in columns))
    line = lambda x: F.concat_ws("|", *(x[o].cast("string") for o in order), *(x[f"_{c}"] for c in columns))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), line), "\n"), 256).alias("fingerprint"))


def lead_candidates(leads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Semantic candidates from leads(broadcast_id, lead, confidence, category) and their ranges; the score is the
    confidence to six digits."""
    sound = leads.where("confidence between 0 and 1")
    both = sound.join(ranges.select("broadcast_id", "lead", "start_ms", "peak_ms", "end_ms"), ["broadcast_id", "lead"])
    return both.select("broadcast_id", F.concat(F.lit("semantic-"), F.col("lead").cast("string")).alias("id"), "start_ms", "peak_ms", "end_ms", N.round_half_up(F.col("confidence"), 6).alias("score"), "category", F.lit("semantic").alias("kind"))


def stage_commit(gates: DataFrame) -> DataFrame:
    """Which stages of each source may be committed: gates(context_complete, selection_ready, has_gap). A stage needs the
    one before; the publication and the end go with the deep pass."""
    deep = F.col("context_complete") & F.col("selection_ready") & ~F.col("has_gap")
    return gates.withColumn("broadcast_context", F.col("context_complete")).withColumn("deep_pass", deep).withColumn("publication", deep).withColumn("completion", deep)
