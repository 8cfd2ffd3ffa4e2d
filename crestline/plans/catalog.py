"""Queries of catalogs and ledgers, on orders, line items, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import catalog, ledger
from .tables import read, rounded

NOW = "timestamp_ntz'1998-06-01 00:00:00'"
now = lambda: F.expr(NOW)
PERMANENT = "o_orderpriority = '1-URGENT'"


def videos(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_custkey as channel_id", "o_orderkey as video_id", "concat('Video ', o_orderkey % 97) as title", "o_orderdate as published_at", "case o_orderstatus when 'F' then 'published' when 'P' then 'retryable' else 'transcript-ready' end as state",
        "case o_orderkey % 3 when 0 then 'context' when 1 then 'fingerprint' else 'transcript' end as stage", "o_orderkey % 5 as attempts", f"{PERMANENT} as permanent",
        f"case when o_orderstatus = 'P' then {NOW} + make_dt_interval(cast(o_orderkey % 21 - 10 as int)) end as next_at", "case when o_orderkey % 4 = 0 then concat('a', o_orderkey) end as artifact", "o_totalprice",
    )


VIDEOS = """videos AS (SELECT o_custkey AS channel_id, o_orderkey AS video_id, 'Video ' || (o_orderkey % 97) AS title, o_orderdate AS published_at, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'P' THEN 'retryable' ELSE 'transcript-ready' END AS state,
  CASE o_orderkey % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'fingerprint' ELSE 'transcript' END AS stage, o_orderkey % 5 AS attempts, o_orderpriority = '1-URGENT' AS permanent, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '1998-06-01' + to_days(CAST(o_orderkey % 21 - 10 AS INTEGER)) END AS next_at,
  CASE WHEN o_orderkey % 4 = 0 THEN 'a' || o_orderkey END AS artifact, o_totalprice FROM orders)"""
WINDOW = "published_at <= TIMESTAMP '1998-06-01' AND published_at >= TIMESTAMP '1998-06-01' - to_days(3650)"


def due_videos(spark, sf_dir):
    return catalog.due_videos(videos(spark, sf_dir), now(), 3650, 12).select("channel_id", "video_id", "rank", "pick")


def work_queue(spark, sf_dir):
    return catalog.work_queue(videos(spark, sf_dir), now(), 3650).select("channel_id", "video_id", "phase", "ready", "place")


def retry_times(spark, sf_dir):
    return videos(spark, sf_dir).select("video_id", catalog.next_retry(F.col("attempts"), F.col("permanent"), now()).alias("next_at"))


def catalog_merge(spark, sf_dir):
    every = videos(spark, sf_dir)
    known = every.where("video_id % 3 <> 0").withColumn("revision", (F.col("video_id") % 7).cast("int"))
    feed = every.where("video_id % 5 <> 0").withColumn("title", F.when(F.col("video_id") % 2 == 0, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")))
    return catalog.merge_catalog(known, feed).select("video_id", "title", "revision", "change")


def retention_plan(spark, sf_dir):
    size = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sum(F.floor("l_extendedprice")).cast("long").alias("bytes"))
    jobs = read(spark, sf_dir, "orders").selectExpr("o_custkey as owner", "o_orderkey as job_id", "case o_orderstatus when 'F' then 'completed' when 'P' then 'abandoned' else 'running' end as status", "to_date(o_orderdate) as day").join(size, "job_id")
    return catalog.plan_retention(jobs, F.lit("1998-06-01").cast("date"), 1500, 1_000_000).select("owner", "job_id", "reason", "bytes")


def source_rotation(spark, sf_dir):
    sources = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))
    return catalog.rotate_sources(sources, 100)


def catalog_identity(spark, sf_dir):
    every = videos(spark, sf_dir).select("video_id", "title", F.floor("o_totalprice").cast("long").alias("duration_ms"), F.when(F.col("video_id") % 5 > 1, F.floor(F.col("video_id") / 5 * F.when(F.col("video_id") % 5 == 2, 1).otherwise(5)).cast("long")).alias("fingerprint"))
    queries = every.select(F.col("video_id").alias("query_id"), F.when(F.col("video_id") % 3 == 0, F.col("video_id")).alias("video_id"), "title", (F.col("duration_ms") + 500).alias("duration_ms"), F.when(F.col("video_id") % 7 > 3, F.col("fingerprint")).alias("fingerprint"))
    return catalog.match_catalog(queries, every.where("video_id % 4 <> 1"))


def video_library(spark, sf_dir):
    return catalog.library(videos(spark, sf_dir)).select("channel_id", "video_id", "place")


def recent_uploads(spark, sf_dir):
    return videos(spark, sf_dir).where(catalog.within_window(F.col("published_at"), now(), 900)).select("video_id")


def _cells(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") % 50).alias("cell"), "l_returnflag", "l_linenumber", "l_partkey", "l_orderkey")


def plan_settlement(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    outcomes = cells.where("l_linenumber = 1 and l_partkey % 2 = 0").select("source", "cell", F.when(F.col("l_returnflag") == "R", "gap").otherwise("chapter").alias("outcome"))
    return ledger.settlement(cells.where("cell < 45").select("source", "cell").distinct(), outcomes, ["source"])


def checkpoint_merge(spark, sf_dir):
    part = lambda n: _cells(spark, sf_dir).where(f"l_linenumber % 2 = {n}").groupBy("source", "cell").agg(F.min(F.when(F.col("l_returnflag") == "A", "gap").otherwise("success")).alias("outcome"), F.count("*").alias("attempt"), F.max(F.col("l_partkey") % 3).alias("rank"))
    return ledger.merge_checkpoints(part(1), part(0), ["source", "cell"])


def status_ledger(spark, sf_dir):
    units = videos(spark, sf_dir).select("channel_id", F.col("state").alias("status"), (F.col("video_id") % 2 == 0).alias("required")).withColumn("status", F.regexp_replace("status", "-", "_"))
    return ledger.status_summary(units, ["channel_id"], ("published", "retryable", "transcript_ready"), "published")


def resumable_units(spark, sf_dir):
    return ledger.resumable(videos(spark, sf_dir).select("video_id"), videos(spark, sf_dir).where("state = 'published'"), ["video_id"])


def edit_replay(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("user_id as item", "event_id as seq", "cast(event_id % 4 as bigint) as expected_revision", "cast(floor(value * 1000) as bigint) as start_ms", "cast(floor(value * 1000) + 45000 as bigint) as end_ms")
    return ledger.replay_edits(e)


def event_fence(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("user_id % 10 as session_id", "event_id as seq", "cast(floor(value) as bigint) as event_id", "event_id % 3 as epoch")
    fence = e.where("session_id < 8").select("session_id").distinct().withColumn("epoch", F.col("session_id") % 3)
    return ledger.fence_events(e, fence).groupBy("session_id", "verdict").agg(F.count("*").alias("n"))


def proposals(spark, sf_dir):
    rows = videos(spark, sf_dir).select(F.col("video_id").alias("id"), "title", "stage", F.when(F.col("video_id") % 3 == 0, "user").otherwise("machine").alias("owner"))
    fresh = videos(spark, sf_dir).where("video_id % 2 = 0").select(F.col("video_id").alias("id"), F.concat("title", F.lit("!")).alias("title"), F.lit("context").alias("stage"))
    return ledger.apply_proposals(rows, fresh, ["title", "stage"])


def latest_bindings(spark, sf_dir):
    b = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 11).alias("file"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("value"))
    return ledger.upsert_bindings(b, ["owner", "file"], "owner", 6).select("owner", "file", "value", "place")


def due_lanes(spark, sf_dir):
    v = videos(spark, sf_dir)
    return ledger.due_reasons([("urgent", v.where("permanent")), ("retry", v.where("state = 'retryable'")), ("fresh", v.where("published_at >= timestamp_ntz'1997-01-01 00:00:00'"))], "video_id")


def repeated_titles(spark, sf_dir):
    return ledger.duplicates(videos(spark, sf_dir), ["channel_id", "title"])


def qualified_candidates(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").selectExpr("doc_id as id", "case when toxic = 1 then 'reject' when quality = 1 then 'select' else 'review' end as decision")
    return ledger.qualify(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), labels).select("id", "verdict")


def gap_summary(spark, sf_dir):
    return qualified_candidates(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def stage_times(spark, sf_dir):
    marks = read(spark, sf_dir, "events").selectExpr("user_id", "event_id as seq", "cast(event_id * 1000 as bigint) as at_ms")
    return ledger.stage_report(marks, ["user_id"]).select("seq", "elapsed_ms", N.round_half_up(F.col("share"), 6).alias("share"))


CELLS = "cells AS (SELECT l_suppkey AS source, l_orderkey % 50 AS cell, l_returnflag, l_linenumber, l_partkey FROM lineitem)"
PART = "SELECT source, cell, min(CASE WHEN l_returnflag = 'A' THEN 'gap' ELSE 'success' END) AS outcome, count(*) AS attempt, max(l_partkey % 3) AS rank, '{1}' AS side FROM cells WHERE l_linenumber % 2 = {0} GROUP BY source, cell"

QUERIES = {
    "due_videos": (due_videos, f"WITH {VIDEOS}, d AS (SELECT *, CAST(CASE WHEN state <> 'retryable' THEN 0 WHEN permanent THEN 3 WHEN stage = 'fingerprint' THEN 2 ELSE 1 END AS INTEGER) AS rank FROM videos WHERE {WINDOW} AND state <> 'published' AND (state <> 'retryable' OR next_at <= TIMESTAMP '1998-06-01')) SELECT channel_id, video_id, rank, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY rank, published_at DESC, video_id) AS INTEGER) AS pick FROM d QUALIFY pick <= 12"),
    "work_queue": (work_queue, f"WITH {VIDEOS}, q AS (SELECT *, CASE WHEN state = 'retryable' THEN CASE WHEN stage = 'context' THEN 'context' WHEN stage IN ('review', 'fingerprint') THEN 'review' ELSE 'caption' END WHEN state = 'transcript-ready' THEN 'context' WHEN state = 'context-ready' THEN 'review' ELSE 'caption' END AS phase, next_at IS NULL OR next_at <= TIMESTAMP '1998-06-01' AS ready FROM videos WHERE {WINDOW} AND state NOT IN ('published', 'review-ready')) SELECT channel_id, video_id, phase, ready, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY ready DESC, published_at DESC, video_id) AS INTEGER) AS place FROM q"),
    "retry_times": (retry_times, f"WITH {VIDEOS} SELECT video_id, TIMESTAMP '1998-06-01' + to_hours(CAST(CASE WHEN permanent THEN [24, 72, 168, 336] ELSE [3, 6, 12, 24] END[least(attempts + 1, 4)] AS INTEGER)) AS next_at FROM videos"),
    "catalog_merge": (catalog_merge, f"""WITH {VIDEOS}, k AS (SELECT *, CAST(video_id % 7 AS INTEGER) AS revision FROM videos WHERE video_id % 3 <> 0), f AS (SELECT video_id, CASE WHEN video_id % 2 = 0 THEN title || ' (new)' ELSE title END AS title FROM videos WHERE video_id % 5 <> 0),
      j AS (SELECT coalesce(k.video_id, f.video_id) AS video_id, k.video_id IS NULL AS fresh, CASE WHEN k.artifact IS NOT NULL OR f.video_id IS NULL THEN k.title ELSE f.title END AS title, k.title AS old, k.revision FROM k FULL OUTER JOIN f ON k.video_id = f.video_id)
      SELECT video_id, title, CAST(CASE WHEN fresh THEN 1 ELSE revision + CASE WHEN title <> old THEN 1 ELSE 0 END END AS INTEGER) AS revision, CASE WHEN fresh THEN 'added' WHEN title <> old THEN 'changed' ELSE 'same' END AS change FROM j"""),
    "retention_plan": (retention_plan, """WITH sizes AS (SELECT l_orderkey AS job_id, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL),
      jobs AS (SELECT o_custkey AS owner, o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'abandoned' ELSE 'running' END AS status, CAST(o_orderdate AS DATE) AS day, bytes FROM orders JOIN sizes ON job_id = o_orderkey),
      r AS (SELECT *, CASE WHEN status = 'abandoned' THEN 'abandoned' WHEN status = 'completed' AND DATE '1998-06-01' - day >= 1500 THEN 'past_retention' END AS r0 FROM jobs),
      s AS (SELECT *, sum(CASE WHEN r0 IS NULL THEN bytes ELSE 0 END) OVER (PARTITION BY owner) AS rest, sum(CASE WHEN r0 IS NULL AND status <> 'completed' THEN bytes ELSE 0 END) OVER (PARTITION BY owner) AS guarded,
        coalesce(sum(CASE WHEN r0 IS NULL AND status = 'completed' THEN bytes ELSE 0 END) OVER (PARTITION BY owner ORDER BY day, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
      SELECT owner, job_id, coalesce(r0, 'over_cap') AS reason, bytes FROM s WHERE r0 IS NOT NULL OR (status = 'completed' AND guarded <= 1000000 AND rest - before > 1000000)"""),
    "source_rotation": (source_rotation, "SELECT s_suppkey AS n, ((s_suppkey - 33) % (SELECT count(*) FROM supplier) + (SELECT count(*) FROM supplier)) % (SELECT count(*) FROM supplier) AS turn FROM supplier"),
    "catalog_identity": (catalog_identity, f"""WITH {VIDEOS}, q AS (SELECT video_id AS query_id, CASE WHEN video_id % 3 = 0 THEN video_id END AS want, title, CAST(floor(o_totalprice) AS BIGINT) + 500 AS d, CASE WHEN video_id % 7 > 3 AND video_id % 5 > 1 THEN CASE WHEN video_id % 5 = 2 THEN video_id // 5 ELSE video_id END END AS f FROM videos),
      v AS (SELECT video_id, title, CAST(floor(o_totalprice) AS BIGINT) AS d, CASE WHEN video_id % 5 > 1 THEN CASE WHEN video_id % 5 = 2 THEN video_id // 5 ELSE video_id END END AS f FROM videos WHERE video_id % 4 <> 1), p AS (SELECT f, count(*) AS np, min(video_id) AS printed FROM v WHERE f IS NOT NULL GROUP BY ALL),
      n AS (SELECT query_id, count(*) AS n, min(video_id) AS found FROM q JOIN v ON q.title = v.title AND abs(q.d - v.d) <= 2000 GROUP BY ALL)
      SELECT query_id, CASE WHEN v.video_id IS NOT NULL THEN 'by-id' WHEN np = 1 THEN 'by-fingerprint' WHEN np > 1 THEN 'ambiguous' WHEN n = 1 THEN 'by-title' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN v.video_id IS NOT NULL THEN want WHEN np = 1 THEN printed WHEN np IS NULL AND n = 1 THEN found END AS match
      FROM q LEFT JOIN v ON q.want = v.video_id LEFT JOIN n USING (query_id) LEFT JOIN p ON p.f = q.f"""),
    "video_library": (video_library, f"WITH {VIDEOS} SELECT channel_id, video_id, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id) AS INTEGER) AS place FROM videos WHERE state = 'published'"),
    "recent_uploads": (recent_uploads, f"WITH {VIDEOS} SELECT video_id FROM videos WHERE published_at <= TIMESTAMP '1998-06-01' AND published_at >= TIMESTAMP '1998-06-01' - to_days(900)"),
    "plan_settlement": (plan_settlement, f"""WITH {CELLS}, p AS (SELECT DISTINCT source, cell FROM cells WHERE cell < 45), o AS (SELECT source, cell, count(*) AS n, min(CASE WHEN l_returnflag = 'R' THEN 'gap' ELSE 'chapter' END) AS outcome FROM cells WHERE l_linenumber = 1 AND l_partkey % 2 = 0 GROUP BY ALL),
      j AS (SELECT coalesce(p.source, o.source) AS source, p.cell IS NOT NULL AS planned, coalesce(n, 0) AS n, outcome FROM p FULL OUTER JOIN o ON p.source = o.source AND p.cell = o.cell),
      c AS (SELECT source, count(*) FILTER (WHERE planned) AS n_planned, count(*) FILTER (WHERE planned AND n = 1) AS n_settled, count(*) FILTER (WHERE planned AND n = 0) AS n_missing, count(*) FILTER (WHERE n > 1) AS n_repeated, count(*) FILTER (WHERE NOT planned) AS n_unplanned, count(*) FILTER (WHERE outcome = 'gap') AS n_gaps FROM j GROUP BY ALL)
      SELECT *, n_missing = 0 AND n_repeated = 0 AND n_unplanned = 0 AND n_gaps = 0 AS settled FROM c"""),
    "checkpoint_merge": (checkpoint_merge, f"WITH {CELLS}, b AS ({PART.format(1, 'current')} UNION ALL {PART.format(0, 'pending')}) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source, cell ORDER BY outcome = 'gap', CASE WHEN outcome = 'gap' THEN 0 WHEN side = 'pending' THEN 1 ELSE 0 END, attempt DESC, rank, side) = 1"),
    "status_ledger": (status_ledger, f"WITH {VIDEOS} SELECT channel_id, count(*) FILTER (WHERE state = 'published') AS n_published, count(*) FILTER (WHERE state = 'retryable') AS n_retryable, count(*) FILTER (WHERE state = 'transcript-ready') AS n_transcript_ready, count(*) FILTER (WHERE video_id % 2 = 0 AND state = 'published') = count(*) FILTER (WHERE video_id % 2 = 0) AS complete FROM videos GROUP BY ALL"),
    "resumable_units": (resumable_units, f"WITH {VIDEOS} SELECT video_id FROM videos WHERE state <> 'published'"),
    "edit_replay": (edit_replay, """WITH RECURSIVE e AS (SELECT user_id AS item, event_id % 4 AS x, CAST(floor(value * 1000) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
      f AS (SELECT DISTINCT item, 0::BIGINT AS rn, 0::BIGINT AS revision, 0::BIGINT AS refused, NULL::BIGINT AS start_ms FROM e UNION ALL
        SELECT f.item, e.rn, CASE WHEN x = revision THEN revision + 1 ELSE revision END, CASE WHEN x = revision THEN refused ELSE refused + 1 END, CASE WHEN x = revision THEN s ELSE start_ms END FROM f JOIN e ON e.item = f.item AND e.rn = f.rn + 1)
      SELECT item, revision, refused, start_ms, start_ms + 45000 AS end_ms FROM f QUALIFY row_number() OVER (PARTITION BY item ORDER BY rn DESC) = 1"""),
    "event_fence": (event_fence, """WITH e AS (SELECT user_id % 10 AS session_id, event_id % 3 AS epoch, row_number() OVER (PARTITION BY CAST(floor(value) AS BIGINT) ORDER BY event_id) AS rn FROM events),
      v AS (SELECT session_id, CASE WHEN session_id >= 8 THEN 'session' WHEN epoch < session_id % 3 THEN 'stale-epoch' WHEN epoch > session_id % 3 THEN 'future-epoch' WHEN rn > 1 THEN 'repeat' ELSE 'accepted' END AS verdict FROM e) SELECT session_id, verdict, count(*) AS n FROM v GROUP BY ALL"""),
    "field_proposals": (proposals, f"""WITH {VIDEOS}, r AS (SELECT video_id AS id, title, stage, CASE WHEN video_id % 3 = 0 THEN 'user' ELSE 'machine' END AS owner, video_id % 2 = 0 AS p FROM videos)
      SELECT id, owner, CAST(CASE WHEN p AND owner = 'user' THEN 1 + CASE WHEN stage <> 'context' THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS n_held, CASE WHEN p AND owner <> 'user' THEN title || '!' ELSE title END AS title, CASE WHEN p AND owner <> 'user' THEN 'context' ELSE stage END AS stage FROM r"""),
    "latest_bindings": (latest_bindings, "WITH l AS (SELECT o_custkey AS owner, o_orderkey % 11 AS file, o_orderdate AS made, o_orderkey AS value FROM orders QUALIFY row_number() OVER (PARTITION BY owner, file ORDER BY made DESC, value DESC) = 1) SELECT owner, file, value, CAST(row_number() OVER (PARTITION BY owner ORDER BY made DESC, file) AS INTEGER) AS place FROM l QUALIFY place <= 6"),
    "due_lanes": (due_lanes, f"WITH {VIDEOS}, u AS (SELECT video_id, 'urgent' AS r FROM videos WHERE permanent UNION SELECT video_id, 'retry' FROM videos WHERE state = 'retryable' UNION SELECT video_id, 'fresh' FROM videos WHERE published_at >= TIMESTAMP '1997-01-01') SELECT video_id, string_agg(r, '+' ORDER BY r) AS reasons FROM u GROUP BY ALL"),
    "repeated_titles": (repeated_titles, f"WITH {VIDEOS} SELECT channel_id, title, count(*) AS n FROM videos GROUP BY ALL HAVING n > 1"),
    "qualified_candidates": (qualified_candidates, "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'selected' ELSE 'review' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "gap_summary": (gap_summary, "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'selected' ELSE 'review' END AS verdict, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL"),
    "stage_times": (stage_times, f"WITH m AS (SELECT user_id, event_id AS seq, (event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), event_id)) * 1000 AS elapsed_ms FROM events), t AS (SELECT *, sum(elapsed_ms) OVER (PARTITION BY user_id) AS total FROM m) SELECT seq, elapsed_ms, {rounded('share', 'CASE WHEN total > 0 THEN elapsed_ms / total ELSE 0 END')} FROM t"),
}
