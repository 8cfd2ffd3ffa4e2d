"""Transcripts: caption chapters, compaction, references, cues by phase, mentions and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored
from .intervals import cells, nearest, overlap_join, text_in_range


def caption_chapters(cues: DataFrame, durations: DataFrame, width_ms: int = 120_000, most: int = 3000) -> DataFrame:
    """Chapters of two minutes with a representative part of their cues' text; chapters without cues are empty."""
    axis = cells(durations, width_ms).select("broadcast_id", "cell", "start_ms", "end_ms")
    held = text_in_range(axis, cues, ["broadcast_id"], "cell", most=1 << 30)
    return axis.join(held, ["broadcast_id", "cell"], "left").select("broadcast_id", "cell", "start_ms", "end_ms", T.representative(F.coalesce("text", F.lit("")), most).alias("summary"))


def compact_chapters(chapters: DataFrame, n: int) -> DataFrame:
    """Ordered chapters(broadcast_id, n, start_ms, end_ms, ratio, complete, text) in n even groups: weighted coverage,
    whether all is complete and without a hole, and a representative part of the text."""
    whole = W.partitionBy("broadcast_id")
    order = whole.orderBy("n")
    size = F.count("*").over(whole)
    group = F.floor(((F.row_number().over(order)) * F.least(F.lit(n), size) - 1) / size).cast("int")
    marked = chapters.withColumn("group", group).withColumn("_gap", F.col("start_ms") > F.coalesce(F.lag("end_ms").over(order), F.col("start_ms")))
    first = F.row_number().over(W.partitionBy("broadcast_id", "group").orderBy("n")) == 1
    marked = marked.withColumn("_gap", F.col("_gap") & ~first)
    out = marked.groupBy("broadcast_id", "group").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_chapters"), F.sum((F.col("end_ms") - F.col("start_ms")) * F.col("ratio")).alias("_covered"),
        (F.min("complete") & ~F.max("_gap")).alias("complete"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "start_ms", "text"))), lambda c: F.concat(F.lit("["), F.floor(c["start_ms"] / 1000).cast("string"), F.lit("s] "), c["text"])), " ").alias("_text"),
    )
    ratio = F.least(F.lit(1.0), F.col("_covered") / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")))
    return out.select("broadcast_id", "group", "start_ms", "end_ms", "n_chapters", ratio.alias("ratio"), "complete", T.representative(F.col("_text"), 3000).alias("summary"))


def resolve_refs(leads: DataFrame, chapters: DataFrame) -> DataFrame:
    """Leads(lead, broadcast_id, first, last) with the range of the chapters they name; a missing or disordered
    reference is a problem."""
    a = chapters.select("broadcast_id", F.col("n").alias("first"), F.col("start_ms").alias("lead_start"))
    b = chapters.select("broadcast_id", F.col("n").alias("last"), F.col("end_ms").alias("lead_end"))
    both = leads.join(a, ["broadcast_id", "first"], "left").join(b, ["broadcast_id", "last"], "left")
    problem = F.when(F.col("lead_start").isNull() | F.col("lead_end").isNull(), "missing-chapter").when(F.col("lead_end") <= F.col("lead_start"), "disorder")
    return both.withColumn("problem", problem)


def phase_cues(cues: DataFrame, peaks: DataFrame, near_ms: int = 5000) -> DataFrame:
    """The cue(broadcast_id, cue, start_ms) nearest to each peak(broadcast_id, id, peak_ms) before, near and after it."""
    instants = cues.groupBy("broadcast_id", "start_ms").agg(F.min("cue").alias("cue")).withColumn("end_ms", F.col("start_ms") + 1)
    right = instants.select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "cue")
    around = peaks.withColumn("start_ms", F.col("peak_ms") - near_ms).withColumn("end_ms", F.col("peak_ms") + near_ms + 1)
    order = W.partitionBy("broadcast_id", "id").orderBy(F.abs(F.col("r_start") - F.col("peak_ms")), "r_start")
    near = overlap_join(around, right, ["broadcast_id"]).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    found = [near.select("broadcast_id", "id", "peak_ms", F.lit("near").alias("phase"), "cue", F.col("r_start").alias("start_ms"))]
    for phase, at in (("before", F.col("peak_ms") - near_ms), ("after", F.col("peak_ms") + near_ms + 1)):
        side = nearest(peaks.withColumn("at_ms", at), instants, "broadcast_id", forward=phase == "after").where("chapter is not null")
        found.append(side.select("broadcast_id", "id", "peak_ms", F.lit(phase).alias("phase"), "chapter.cue", "chapter.start_ms"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def sentence_candidates(queries: DataFrame, texts: DataFrame, least: int = 2) -> DataFrame:
    """(broadcast_id, id, text_id, s, score) of pairs among which is each query's best sentence: see ``cite_sentences``.

    A query's words are taken from the rarest on; a sentence that shares none of the first ones scores no more than the
    letters of the rest. Two words give pairs and a score that is reached; of the others only those are looked up from
    which on the rest could still reach it. A word that most sentences have is hardly ever needed, and only pairs that
    share a needed word are made and scored in full.
    """
    of = ["broadcast_id", "id"]
    sentence = texts.select("broadcast_id", "text_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]*"), 0)).alias("s", "sentence"))
    sentence = stored(sentence.select("broadcast_id", "text_id", "s", T.terms(F.col("sentence")).alias("terms")).where(F.size("terms") > 0), "citation-sentences")
    asked = stored(queries.select(*of, T.terms(F.col("text")).alias("asked")), "citation-queries")
    filed = sentence.select("broadcast_id", "text_id", "s", F.explode("terms").alias("w"))
    seen = filed.groupBy("broadcast_id", "w").agg(F.count("*").alias("n"))
    order = W.partitionBy(*of).orderBy("n", "w")
    words = asked.select(*of, F.explode("asked").alias("w")).distinct().join(seen, ["broadcast_id", "w"])
    words = words.withColumn("rank", F.row_number().over(order)).withColumn("rest", F.sum(F.least(F.char_length("w"), F.lit(8))).over(order.rowsBetween(0, W.unboundedFollowing)))
    words = stored(words.select(*of, "w", "rank", "rest"), "citation-words")

    def scored(chosen: DataFrame) -> DataFrame:
        pairs = chosen.select(*of, "w").join(filed, ["broadcast_id", "w"]).select(*of, "text_id", "s").distinct()
        return pairs.join(sentence, ["broadcast_id", "text_id", "s"]).join(asked, of).select(*of, "text_id", "s", T.token_overlap(F.col("asked"), F.col("terms")).cast("long").alias("score"))

    first = stored(scored(words.where("rank <= 2")), "citation-first")
    reached = first.groupBy(*of).agg(F.max("score").alias("reached"))
    needed = words.where("rank > 2").join(reached, of, "left").where(F.col("rest") >= F.greatest(F.coalesce("reached", F.lit(0)), F.lit(least)))
    return first.unionByName(scored(needed)).distinct().where(F.col("score") >= least)


def cite_sentences(queries: DataFrame, texts: DataFrame, least: int = 2) -> DataFrame:
    """The sentence of a broadcast's texts(broadcast_id, text_id, text) that shares most with each query(broadcast_id,
    id, text); shared words count their letters, eight at most; ties go to the first text and sentence."""
    order = W.partitionBy("broadcast_id", "id").orderBy(F.desc("score"), "text_id", "s")
    return sentence_candidates(queries, texts, least).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
