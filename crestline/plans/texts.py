"""Queries of imports, transcripts, text functions and exports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import names, transcript
from ..sources import chat_files, documents, formats
from ..storage import fresh_path
from .tables import CANDIDATES, CAPTIONS, CHAPTERS, candidates, captions, chapters, read, rounded


def _lines(spark, sf_dir):
    """Events as lines of an export, under changing names; every 50th line is broken, every 40th has no time."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("row_number"), "event_type", "user_id", "value")
    t = (F.col("row_number") * 100 + 250).cast("string")
    clock = F.concat(F.lpad((F.col("row_number") % 3).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("row_number") % 60).cast("string"), 2, "0"), F.lit(":07.5"))
    body = F.when(F.col("row_number") % 40 == 7, F.to_json(F.struct(F.col("event_type").alias("text")))).when(F.col("row_number") % 3 == 0, F.to_json(F.struct(t.alias("relative_ms"), F.col("event_type").alias("Message"), F.col("user_id").cast("string").alias("author"))))
    body = body.when(F.col("row_number") % 3 == 1, F.to_json(F.struct(clock.alias("time"), F.col("event_type").alias("content"))))
    body = body.otherwise(F.to_json(F.struct((1_700_000_000 + F.col("row_number")).cast("string").alias("ts"), F.col("event_type").alias("body"), F.col("user_id").cast("string").alias("nickname"))))
    return e.select("row_number", F.when(F.col("row_number") % 50 == 3, F.lit("not json")).otherwise(body).alias("value"))


def chat_import(spark, sf_dir):
    return chat_files.import_chat(chat_files.records_from_lines(_lines(spark, sf_dir)))[0].select("row_number", "ts_ms", "text", "author_id")


def chat_import_rejects(spark, sf_dir):
    return chat_files.import_chat(chat_files.records_from_lines(_lines(spark, sf_dir)))[1].groupBy("code").agg(F.count("*").alias("n"))


def chat_json(spark, sf_dir):
    """Containers of a thousand events each, under the four names that such files use."""
    e = read(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("part"), F.struct(F.col("event_id").cast("string").alias("Author_ID"), (F.col("event_id") * 10).cast("string").alias("time ms"), F.concat("event_type", F.lit(' "x"')).alias("Body")).alias("m"))
    parts = e.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "m"))), lambda x: x["m"]).alias("m"))
    names = ("messages", "chatMessages", "chats", "items")
    body = F.when(F.col("part") % 5 == 4, F.to_json("m"))
    for k, name in enumerate(names):
        body = body.when(F.col("part") % 5 == k, F.to_json(F.struct(F.col("m").alias(name))))
    records = chat_files.records_from_json(parts.select(body.alias("value")))
    return chat_files.resolve(records).select(F.col("author_id").cast("long").alias("event_id"), "row_number", "ms", "text", "basis")


def chat_csv(spark, sf_dir):
    """Events written as CSV with quotes and line breaks in the cells, and read back."""
    path = fresh_path(spark, "chat-csv")
    text = F.concat(F.lit('say "'), F.col("event_type"), F.lit('",\nnext'))
    read(spark, sf_dir, "events").select((F.col("event_id") % 7200 * 1000).alias("elapsed_ms"), text.alias("Message"), F.col("event_id").alias("Nickname")).write.csv(path, header=True, escape='"')
    return chat_files.resolve(chat_files.read_chat_csv(spark, path)).select(F.col("author_id").cast("long").alias("event_id"), "ms", "text", "code")


def chat_formats(spark, sf_dir):
    turn = F.col("turn") % 5
    head = F.when(turn == 0, F.concat(F.lit("["), "text")).when(turn == 1, F.concat(F.lit('  {"a":"'), F.col("role"), F.lit('"}'))).when(turn == 2, F.lit('{"a":1}\n{"b":2}')).when(turn == 3, F.lit(" \n")).otherwise(F.concat(F.lit("time,"), F.col("role")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", chat_files.detect_format(head).alias("format"))


def feed_entries(spark, sf_dir):
    """Feeds of each customer's orders; every 9th has a document type and is refused."""
    o = read(spark, sf_dir, "orders")
    entry = F.format_string("<entry><yt:videoId>%d</yt:videoId><yt:channelId>%d</yt:channelId><title>No %d</title><published>%sT00:00:00+00:00</published><updated>%sT01:00:00+00:00</updated></entry>", "o_orderkey", "o_custkey", F.col("o_orderkey") % 97, F.col("o_orderdate").cast("date").cast("string"), F.col("o_orderdate").cast("date").cast("string"))
    feeds = o.select("o_custkey", entry.alias("e")).groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("e")), "\n").alias("e"))
    feeds = feeds.select(F.concat(F.when(F.col("o_custkey") % 9 == 0, "<!doctype x>").otherwise(""), F.lit("<feed>"), "e", F.lit("</feed>")).alias("value"))
    return documents.feed_videos(feeds).select(F.col("video_id").cast("long").alias("video_id"), F.col("channel_id").cast("long").alias("channel_id"), "title", F.unix_seconds("published_at").alias("published"), F.unix_seconds("updated_at").alias("updated"))


def manifest_videos(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    video = F.struct(F.col("o_custkey").cast("string").alias("channelId"), F.col("o_orderkey").cast("string").alias("videoId"), F.concat(F.lit("No "), F.col("o_orderkey").cast("string")).alias("title"), F.floor("o_totalprice").cast("long").alias("durationMs"), F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T00:00:00Z")).alias("publishedAt"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 7).cast("int").alias("revision"))
    manifests = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(video).alias("videos"))).alias("value"))
    return documents.catalog_videos(manifests).select(F.col("video_id").cast("long").alias("video_id"), "title", "duration_ms", F.unix_seconds("published_at").alias("published"), "state", "revision")


def manifest_anchors(spark, sf_dir):
    """Fingerprint files made of the order keys' digests."""
    o = read(spark, sf_dir, "orders")
    hash_of = lambda s: F.substring(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(s)).cast("binary")), 1, 16)
    anchor = F.struct((F.col("o_orderkey") * 10).alias("timestampMs"), hash_of("d").alias("dHash64"), hash_of("b").alias("blockHash64"), (F.col("o_orderkey") % 256).cast("int").alias("meanLuma"), (F.col("o_orderkey") % 99).cast("int").alias("edgeEnergy"))
    files = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(anchor)).alias("anchors"))
    files = files.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("videoId"), "anchors")).alias("value"))
    return documents.fingerprint_anchors(files).select(F.col("video_id").cast("long").alias("video_id"), "anchor", "ts_ms", F.lower(F.lpad(F.hex("dhash"), 16, "0")).alias("dhash"), F.lower(F.lpad(F.hex("blockhash"), 16, "0")).alias("blockhash"), "mean_luma", "edge")


def _tracks(spark, sf_dir):
    """Tracks made of the conversations: each cue twice, the second of them a repeat."""
    cue = F.struct((F.col("turn") * 15_000).alias("tStartMs"), F.lit(4000).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8")), F.struct(F.lit("\n").alias("utf8"))).alias("segs"))
    tracks = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("broadcast_id"), "turn", cue.alias("cue")).groupBy("broadcast_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cue"))), lambda x: F.array(x["cue"], x["cue"]))).alias("events"))
    return tracks.select("broadcast_id", F.to_json(F.struct("events")).alias("value"))


def captions_json3(spark, sf_dir):
    return documents.captions_from_json3(_tracks(spark, sf_dir)).select("broadcast_id", "cue", "start_ms", F.md5(F.col("text").cast("binary")).alias("text"))


def caption_files(spark, sf_dir):
    """The same tracks as files, one for each conversation, read by the name of their format."""
    path = fresh_path(spark, "caption-files")
    _tracks(spark, sf_dir).repartition("broadcast_id").write.partitionBy("broadcast_id").text(path)
    formats.register(spark)
    rows = spark.read.format("caption_json3").option("pattern", "broadcast_id=*/part-*").load(re.sub("^file:/*", "/", path))
    return rows.select(F.regexp_extract("file", r"broadcast_id=(\d+)", 1).cast("long").alias("broadcast_id"), "cue", "start_ms", F.md5(F.col("text").cast("binary")).alias("text"))


def caption_chapters(spark, sf_dir):
    cues = captions(spark, sf_dir)
    ends = cues.groupBy("broadcast_id").agg(F.max("end_ms").alias("duration_ms"))
    cues = cues.select("broadcast_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("cue").alias("r_id"), "text")
    return transcript.caption_chapters(cues, ends).select("broadcast_id", "cell", "start_ms", "end_ms", F.md5(F.col("summary").cast("binary")).alias("summary"))


def compact_chapters(spark, sf_dir):
    parts = chapters(spark, sf_dir).withColumn("ratio", F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(1.0)).withColumn("complete", F.col("doc_id") % 5 != 0)
    return transcript.compact_chapters(parts, 24).select("broadcast_id", "group", "start_ms", "end_ms", "n_chapters", N.round_half_up(F.col("ratio"), 6).alias("ratio"), "complete", F.md5(F.col("summary").cast("binary")).alias("summary"))


def chapter_refs(spark, sf_dir):
    leads = chapters(spark, sf_dir).select("broadcast_id", F.col("doc_id").alias("lead"), (F.col("n") + F.col("doc_id") % 3).cast("int").alias("first"), (F.col("n") + F.col("doc_id") % 5).cast("int").alias("last"))
    return transcript.resolve_refs(leads, chapters(spark, sf_dir)).select("lead", "lead_start", "lead_end", "problem")


def phase_cues(spark, sf_dir):
    cues = captions(spark, sf_dir)
    peaks = cues.select("broadcast_id", F.col("cue").alias("id"), (F.col("start_ms") + 4000).alias("peak_ms"))
    return transcript.phase_cues(cues.select("broadcast_id", "cue", "start_ms"), peaks).select("broadcast_id", "id", "phase", "cue")


#: Participant and name; and what is said of them at the end of a document, by the remainder of its id.
NAMES = ((0, "김철수"), (0, "철수"), (0, "Kim Chul Soo"), (1, "마리"), (1, "Mari"), (1, "Mari of the"), (2, "der"), (2, "and the"), (2, "☆별"), (3, "단"), (3, "que"), (4, "Chul"), (4, "철수"))
SAID = ("김철수에게서 들었다", "철수야 안녕", "철수아 안녕", "Kim Chul Soo.", "Kim  Chul Soo", "마리와 단아", "마리가요 Mari of them", "xMari, Mari2", "Mari of the", "마리으로부터!", "☆별님", "a☆별", "")


def _named(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    # every second one is decomposed: syllables that are apart are composed again
    apart = F.regexp_replace(F.regexp_replace(said, "가", "\u1100\u1161"), "수", "\u1109\u116e")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", F.when(F.floor(F.col("doc_id") / 13) % 2 == 0, apart).otherwise(said)).alias("text"), F.col("source").alias("broadcast_id"))


def _roster(spark):
    return spark.createDataFrame([(p, n, k) for k, (p, n) in enumerate(NAMES)], "participant int, name string, place int")


def name_mentions(spark, sf_dir):
    return names.name_mentions(_named(spark, sf_dir), _roster(spark))


def participant_mentions(spark, sf_dir):
    texts, roster = _named(spark, sf_dir), _roster(spark)
    people = texts.select("broadcast_id").distinct().join(roster.select("participant").distinct())
    return names.mention_counts(names.name_mentions(texts, roster), texts, people)


def sentence_citations(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    queries = turns.where("role = 'user'").select(F.col("conv_id").alias("broadcast_id"), F.col("turn").alias("id"), "text")
    texts = turns.where("role <> 'user'").select(F.col("conv_id").alias("broadcast_id"), F.col("turn").alias("text_id"), "text")
    return transcript.cite_sentences(queries, texts)


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_functions(spark, sf_dir):
    """Some of them on texts whose capitals are full-width, which composition must undo."""
    d, t = read(spark, sf_dir, "documents"), F.col("text")
    wide = F.translate(t, CAPITALS, "".join(chr(ord(c) + 0xFEE0) for c in CAPITALS))
    made = {"norm": T.norm_repeat(wide), "clean": T.clean_text(wide, 500), "head_tail": T.head_tail(t, 300), "sample": T.representative(t, 400), "safe": T.csv_safe(t), "title": T.norm_title(wide), "file": T.norm_title(F.concat(t, F.lit(" [ Ab_-9Ab_-9x ] .MKV "))), "fingerprint": T.content_fingerprint(F.col("source"), t)}
    return d.select("doc_id", *(F.md5(c.cast("binary")).alias(n) for n, c in made.items()))


def field_bytes(spark, sf_dir):
    """Room of a document's title, source and text in a budget of 900 bytes."""
    sizes = F.array(F.octet_length(F.substring_index("text", "\n", 1)), F.octet_length("source"), F.octet_length("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(T.allocate_bytes(sizes, [2, 1, 3], F.lit(900), 100), lambda x: x.cast("string")), ",").alias("bytes"), F.md5(T.head_tail_bytes(F.col("text"), F.lit(600)).cast("binary")).alias("cut"))


def term_overlap(spark, sf_dir):
    """Shared words of each document with the next of its source."""
    from pyspark.sql import Window as W

    docs = read(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("next_id")).where("next_id is not null")
    wide = F.translate("text", CAPITALS, "".join(chr(ord(c) + 0xFEE0) for c in CAPITALS))
    words = docs.select("doc_id", T.terms(wide).alias("a"))
    d = pairs.join(words, "doc_id").join(words.select(F.col("doc_id").alias("next_id"), F.col("a").alias("b")), "next_id")
    return d.select("doc_id", N.round_half_up(T.match_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), T.token_overlap(F.col("a"), F.col("b")).cast("long").alias("weight"))


def timecodes(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("id", T.timecode(F.col("peak_ms")).alias("clock"), T.srt_time(F.col("peak_ms")).alias("srt"))


def video_ids(spark, sf_dir):
    """Ids in addresses made of the pages' own."""
    key = F.substring(F.translate(F.base64(F.sha2("url", 256).cast("binary")), "+/=", "___"), 1, 11)
    pages = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://v.example/watch?v="), key, F.lit("&t=5"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://youtu.be/"), key)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("Clip ["), key, F.lit("].mp4"))).otherwise(F.col("url")).alias("u"), key.alias("key"))
    return pages.select("page_id", (T.video_id(F.col("u")) == F.col("key")).alias("found"))


def artifacts(spark, sf_dir):
    return documents.artifact_rows(read(spark, sf_dir, "pages"), "html", "page_id")


def caption_refs(spark, sf_dir):
    """Track addresses in pages to which a player's data is added."""
    player = F.concat(F.lit('<script>{"captionTracks":[{"baseUrl":"https://t.example/c?p='), F.col("page_id"), F.lit('\\u0026l=1","name":"x","languageCode":"'), F.when(F.col("page_id") % 3 == 0, "en").otherwise("ko"), F.lit('"}]}</script>'))
    return documents.caption_track_ref(read(spark, sf_dir, "pages").withColumn("html", F.concat("html", player)))


def _edits(spark, sf_dir):
    c = candidates(spark, sf_dir).where("kind = 'chat' and start_ms >= 0")
    return c.select("broadcast_id", "id", F.concat(F.when(F.col("id") % 7 == 0, "=sum").otherwise("Clip "), F.col("id").cast("string")).alias("title"), "start_ms", "end_ms", F.col("kind").alias("reason"), F.lit('say "hi"').alias("note"))


def highlights_csv(spark, sf_dir):
    return documents.csv_cells(_edits(spark, sf_dir)).select("id", "line")


def highlights_json(spark, sf_dir):
    return documents.highlights_json(_edits(spark, sf_dir)).select("id", "json")


def highlights_markdown(spark, sf_dir):
    return documents.highlights_markdown(_edits(spark, sf_dir)).select("broadcast_id", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


def clip_subtitles(spark, sf_dir):
    cues = captions(spark, sf_dir)
    clips = cues.select("broadcast_id", F.col("cue").alias("clip"), (F.col("start_ms") + 2500).alias("start_ms"), (F.col("start_ms") + 40_000).alias("end_ms"))
    return documents.clip_srt(cues.select("broadcast_id", "cue", "start_ms", "end_ms", "text"), clips).select("broadcast_id", "clip", F.md5(F.col("srt").cast("binary")).alias("srt"))


TC = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0')"
SRT = "({0}) || ',' || lpad(CAST({1} % 1000 AS VARCHAR), 3, '0')"
# SQL asks the texts for each name by a pattern of its own; what is said of people is written out whole.
def _pattern(name: str) -> str:
    called = names.CALLED[names.closed_syllable(name[-1])]
    return rf"(^|[^\p{{L}}\p{{N}}]){name}({'|'.join(names.ENDINGS)}|{called})?($|[^\p{{L}}\p{{N}}])"


MENTIONS = f"""said AS (SELECT doc_id AS id, concat_ws(' ', text, [{", ".join(f"'{x}'" for x in SAID)}][doc_id % {len(SAID)} + 1]) AS text FROM documents),
met AS ({" UNION ALL ".join(f"SELECT id, {p} AS participant, '{n}' AS name, {k} AS place FROM said WHERE regexp_matches(text, '{_pattern(n)}')" for k, (p, n) in enumerate(NAMES))}),
mentions AS (SELECT id, participant, name FROM met QUALIFY row_number() OVER (PARTITION BY id, participant ORDER BY length(name) DESC, place) = 1)"""
WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2))"
REP = "CASE WHEN length({0}) <= {1} THEN {0} ELSE " + " || ' … ' || ".join("substring({0}, CAST(floor((length({0}) - {2}) * " + str(i) + " / 3 + 0.5) AS BIGINT) + 1, {2})" for i in range(4)) + " END"
EDITS = f"{CANDIDATES}, edits AS (SELECT *, CASE WHEN id % 7 = 0 THEN '=sum' ELSE 'Clip ' END || id AS title FROM candidates WHERE kind = 'chat' AND start_ms >= 0)"
LINES = """l AS (SELECT event_id AS n, event_type, user_id, event_id % 50 = 3 AS bad, event_id % 40 = 7 AS untimed FROM events),
parsed AS (SELECT *, CASE WHEN n % 3 = 2 THEN 'absolute' ELSE 'relative' END AS basis, CASE n % 3 WHEN 0 THEN n * 100 + 250 WHEN 1 THEN ((n % 3) * 3600 + (n % 60) * 60) * 1000 + 7500 ELSE (1700000000 + n) * 1000 END AS ms,
  CASE n % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN CAST(user_id AS VARCHAR) END AS author_id FROM l WHERE NOT bad AND NOT untimed),
firsts AS (SELECT arg_min(basis, n) AS b, arg_min(ms, n) AS m FROM parsed)"""

QUERIES = {
    "chat_json": (chat_json, """SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS INTEGER) AS row_number, CASE WHEN event_id * 10 >= 1000000000000 THEN event_id * 10 ELSE event_id * 10 END AS ms, event_type || ' "x"' AS text, 'relative' AS basis FROM events"""),
    "chat_csv": (chat_csv, """SELECT event_id, event_id % 7200 * 1000 AS ms, 'say "' || event_type || '",' || chr(10) || 'next' AS text, NULL::VARCHAR AS code FROM events"""),
    "chat_formats": (chat_formats, "SELECT conv_id, turn, ['json', 'json', 'jsonl', 'empty', 'csv'][turn % 5 + 1] AS format FROM conversations"),
    "feed_entries": (feed_entries, "SELECT o_orderkey AS video_id, o_custkey AS channel_id, 'No ' || (o_orderkey % 97) AS title, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS published, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 3600 AS updated FROM orders WHERE o_custkey % 9 <> 0"),
    "manifest_videos": (manifest_videos, "SELECT o_orderkey AS video_id, 'No ' || o_orderkey AS title, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS published, o_orderstatus AS state, CAST(o_orderkey % 7 AS INTEGER) AS revision FROM orders"),
    "manifest_anchors": (manifest_anchors, "SELECT o_custkey AS video_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS anchor, o_orderkey * 10 AS ts_ms, left(md5(o_orderkey || 'd'), 16) AS dhash, left(md5(o_orderkey || 'b'), 16) AS blockhash, CAST(o_orderkey % 256 AS INTEGER) AS mean_luma, CAST(o_orderkey % 99 AS INTEGER) AS edge FROM orders"),
    "chat_import": (chat_import, f"WITH {LINES} SELECT n AS row_number, ms - CASE WHEN basis = 'absolute' THEN m ELSE 0 END AS ts_ms, event_type AS text, author_id FROM parsed, firsts WHERE basis = b"),
    "chat_import_rejects": (chat_import_rejects, f"WITH {LINES} SELECT 'malformed-row' AS code, count(*) AS n FROM l WHERE bad UNION ALL SELECT 'invalid-timestamp', count(*) FROM l WHERE untimed AND NOT bad UNION ALL SELECT 'mixed-basis', count(*) FROM parsed, firsts WHERE basis <> b"),
    "captions_json3": (captions_json3, "SELECT conv_id AS broadcast_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS cue, turn * 15000 AS start_ms, md5(trim(left(trim(regexp_replace(regexp_replace(text || chr(10), '[\\p{Cc}\\p{Cf}]', ' ', 'g'), '\\s+', ' ', 'g')), 500))) AS text FROM conversations WHERE trim(text) <> ''"),
    "caption_files": (caption_files, "SELECT conv_id AS broadcast_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS cue, turn * 15000 AS start_ms, md5(trim(left(trim(regexp_replace(regexp_replace(text || chr(10), '[\\p{Cc}\\p{Cf}]', ' ', 'g'), '\\s+', ' ', 'g')), 500))) AS text FROM conversations WHERE trim(text) <> ''"),
    "caption_chapters": (caption_chapters, f"""WITH {CAPTIONS}, ends AS (SELECT broadcast_id, max(end_ms) AS d FROM captions GROUP BY ALL), axis AS (SELECT broadcast_id, CAST(unnest(range(0, CAST(ceil(d / 120000) AS BIGINT))) AS INTEGER) AS cell, cell * 120000 AS start_ms, least(d, (cell + 1) * 120000) AS end_ms FROM ends),
      held AS (SELECT a.broadcast_id, a.cell, any_value(a.start_ms) AS start_ms, any_value(a.end_ms) AS end_ms, coalesce(string_agg(text, ' ' ORDER BY c.start_ms, c.cue), '') AS t FROM axis a LEFT JOIN captions c ON a.broadcast_id = c.broadcast_id AND c.start_ms < a.end_ms AND c.end_ms >= a.start_ms GROUP BY ALL)
      SELECT broadcast_id, cell, start_ms::BIGINT AS start_ms, end_ms, md5({REP.format('t', 3000, 747)}) AS summary FROM held"""),
    "compact_chapters": (compact_chapters, f"""WITH {CHAPTERS}, s AS (SELECT *, count(*) OVER (PARTITION BY broadcast_id) AS size FROM chapters), g AS (SELECT *, CAST(((n + 1) * least(24, size) - 1) // size AS INTEGER) AS grp FROM s),
      c AS (SELECT broadcast_id, grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_chapters, avg(CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1.0 END) AS ratio, bool_and(doc_id % 5 <> 0) AS complete, string_agg('[' || (start_ms // 1000) || 's] ' || text, ' ' ORDER BY n) AS t FROM g GROUP BY ALL)
      SELECT broadcast_id, grp AS group, start_ms, end_ms, n_chapters, {rounded('ratio', 'ratio')}, complete, md5({REP.format('t', 3000, 747)}) AS summary FROM c""".replace("AS group", 'AS "group"')),
    "chapter_refs": (chapter_refs, f"""WITH {CHAPTERS}, l AS (SELECT broadcast_id, doc_id AS lead, n + doc_id % 3 AS f, n + doc_id % 5 AS t FROM chapters)
      SELECT lead, a.start_ms AS lead_start, b.end_ms AS lead_end, CASE WHEN a.start_ms IS NULL OR b.end_ms IS NULL THEN 'missing-chapter' WHEN b.end_ms <= a.start_ms THEN 'disorder' END AS problem FROM l LEFT JOIN chapters a ON a.broadcast_id = l.broadcast_id AND a.n = l.f LEFT JOIN chapters b ON b.broadcast_id = l.broadcast_id AND b.n = l.t"""),
    "phase_cues": (phase_cues, f"""WITH {CAPTIONS}, p AS (SELECT broadcast_id, cue AS id, start_ms + 4000 AS peak_ms FROM captions), b AS (SELECT p.*, c.cue, c.start_ms, c.start_ms - peak_ms AS away, CASE WHEN abs(c.start_ms - peak_ms) <= 5000 THEN 'near' WHEN c.start_ms < peak_ms THEN 'before' ELSE 'after' END AS phase FROM p JOIN captions c USING (broadcast_id))
      SELECT broadcast_id, id, phase, cue FROM b QUALIFY row_number() OVER (PARTITION BY broadcast_id, id, phase ORDER BY abs(away), start_ms, cue) = 1"""),
    "name_mentions": (name_mentions, f"WITH {MENTIONS} SELECT id, participant, name FROM mentions"),
    "participant_mentions": (participant_mentions, f"""WITH {MENTIONS}, c AS (SELECT source, participant, count(*) AS n FROM mentions JOIN documents ON doc_id = id GROUP BY ALL), j AS (SELECT source AS broadcast_id, participant, coalesce(n, 0) AS n_chapters
      FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT unnest({sorted({p for p, _ in NAMES})}) AS participant) LEFT JOIN c USING (source, participant)) SELECT *, CASE WHEN max(n_chapters) OVER (PARTITION BY broadcast_id) > 0 THEN 'transcript-mentions' ELSE 'catalog-only' END AS status FROM j"""),
    "sentence_citations": (sentence_citations, f"""WITH s AS (SELECT conv_id, turn, unnest(l) AS sentence, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS s FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?\\n]+[.!?]*') AS l FROM conversations WHERE role <> 'user')),
      a AS (SELECT conv_id, turn AS text_id, s, unnest({WORDS.format('sentence')}) AS w FROM s), b AS (SELECT conv_id, turn AS id, unnest({WORDS.format('text')}) AS w FROM conversations WHERE role = 'user'),
      p AS (SELECT conv_id AS broadcast_id, id, text_id, s, CAST(sum(least(8, length(w))) AS BIGINT) AS score FROM a JOIN b USING (conv_id, w) GROUP BY ALL HAVING score >= 2)
      SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY broadcast_id, id ORDER BY score DESC, text_id, s) = 1"""),
    "text_functions": (text_functions, f"""WITH b AS (SELECT *, string_split(regexp_replace(lower(nfc_normalize(text)), '\\s+', '', 'g'), '') AS c FROM documents)
      SELECT doc_id, md5(left(array_to_string(list_filter(c, lambda x, i: NOT coalesce(x = c[i - 1] AND x = c[i - 2], false)), ''), 160)) AS norm, md5(trim(left(trim(regexp_replace(regexp_replace(text, '[\\p{{Cc}}\\p{{Cf}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), 500))) AS clean,
        md5(CASE WHEN length(text) <= 300 THEN text ELSE left(text, 198) || ' … ' || right(text, 99) END) AS head_tail, md5({REP.format('text', 400, 97)}) AS sample, md5(CASE WHEN regexp_matches(text, '^[\\t\\r ]*[=+\\-@]') THEN chr(39) || text ELSE text END) AS safe,
        md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text, '(?i)\\.(?:mp4|webm|mkv|mov|m4v)\\s*$', ''), '\\[\\s*[A-Za-z0-9_-]{{11}}\\s*\\]\\s*$', '')), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))) AS title, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text || ' [ Ab_-9Ab_-9x ] .MKV ', '(?i)\\.(?:mp4|webm|mkv|mov|m4v)\\s*$', ''), '\\[\\s*[A-Za-z0-9_-]{{11}}\\s*\\]\\s*$', '')), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))) AS file, md5(sha256(length(source) || ':' || source || '|' || length(text) || ':' || text)) AS fingerprint FROM b"""),
    "field_bytes": (field_bytes, None),
    "term_overlap": (term_overlap, f"""WITH d AS (SELECT doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS nx FROM documents), w AS (SELECT doc_id, {WORDS.format('text')} AS a, {WORDS.format('nx')} AS b FROM d WHERE nx IS NOT NULL), i AS (SELECT doc_id, len(a) AS n, list_intersect(a, b) AS c FROM w)
      SELECT doc_id, {rounded('ratio', 'CASE WHEN n = 0 THEN 0 ELSE len(c) / n END')}, CAST(coalesce(list_sum(list_transform(c, lambda x: least(8, length(x)))), 0) AS BIGINT) AS weight FROM i"""),
    "timecodes": (timecodes, f"WITH {CANDIDATES} SELECT id, {TC.format('peak_ms')} AS clock, {SRT.format(TC.format('peak_ms'), 'peak_ms')} AS srt FROM candidates"),
    "video_ids": (video_ids, "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN true END AS found FROM pages"),
    "artifacts": (artifacts, "SELECT page_id, sha256(html) AS digest, CAST(strlen(html) AS BIGINT) AS bytes, 'sha256/' || left(sha256(html), 2) || '/' || sha256(html) AS storage_key FROM pages"),
    "caption_refs": (caption_refs, "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'https://t.example/c?p=' || page_id || '&l=1' END AS caption_url FROM pages"),
    "highlights_csv": (highlights_csv, f"""WITH {EDITS} SELECT id, '"' || CASE WHEN title LIKE '=%' THEN '''' ELSE '' END || title || '","' || {TC.format('start_ms')} || '","' || {TC.format('end_ms')} || '","00:00:45","chat","say ""hi' || repeat(chr(34), 3) AS line FROM edits"""),
    "highlights_json": (highlights_json, f"""WITH {EDITS} SELECT id, '{{"id":' || id || ',"title":"' || title || '","start_ms":' || start_ms || ',"end_ms":' || end_ms || ',"reason":"chat"}}' AS json FROM edits"""),
    "highlights_markdown": (highlights_markdown, f"WITH {EDITS} SELECT broadcast_id, md5(string_agg('- ' || {TC.format('start_ms')} || '–' || {TC.format('end_ms')} || ' ' || title, chr(10) ORDER BY start_ms, end_ms, id)) AS markdown FROM edits GROUP BY ALL"),
    "clip_subtitles": (clip_subtitles, f"""WITH {CAPTIONS}, k AS (SELECT broadcast_id, cue AS clip, start_ms + 2500 AS s, start_ms + 40000 AS e FROM captions),
      h AS (SELECT k.broadcast_id, clip, greatest(s, c.start_ms) - s AS a, least(e, c.end_ms) - s AS b, cue, text, row_number() OVER (PARTITION BY k.broadcast_id, clip ORDER BY greatest(s, c.start_ms), cue) AS n FROM k JOIN captions c ON k.broadcast_id = c.broadcast_id AND greatest(s, c.start_ms) < least(e, c.end_ms))
      SELECT broadcast_id, clip, md5(string_agg(n || chr(13) || chr(10) || {SRT.format(TC.format('a'), 'a')} || ' --> ' || {SRT.format(TC.format('b'), 'b')} || chr(13) || chr(10) || text || chr(13) || chr(10), chr(13) || chr(10) ORDER BY n) || chr(13) || chr(10)) AS srt FROM h GROUP BY ALL"""),
}
