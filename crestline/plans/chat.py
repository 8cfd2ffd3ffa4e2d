"""Queries of the chat operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import chat
from .tables import MESSAGES, durations, messages, rounded

R6 = lambda c: N.round_half_up(F.col(c), 6).alias(c)


def _dense(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    return chat.densify(chat.buckets(chat.align(msgs, durations(msgs))), durations(msgs))


def chat_buckets(spark, sf_dir):
    return _dense(spark, sf_dir).select("broadcast_id", "bucket", "n_messages", "n_reactions", "n_authors", "top_author", "n_repeats")


def chat_bucket_scores(spark, sf_dir):
    kept = ["msg_base", "msg_score", "msg_ratio", "uniq_base", "uniq_score", "uniq_ratio", "spam_penalty", "score"]
    return chat.score_buckets(_dense(spark, sf_dir)).select("broadcast_id", "bucket", *map(R6, kept), "eligible")


def chat_local_peaks(spark, sf_dir):
    return chat.local_peaks(chat.score_buckets(_dense(spark, sf_dir))).select("broadcast_id", "bucket", R6("score"))


def chat_highlights(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    return chat.select_highlights(msgs, durations(msgs)).select("broadcast_id", "pick", "peak_ms", "start_ms", "end_ms", R6("score"), "n_messages", "n_authors")


def chat_alignment(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    return chat.alignment_counts(msgs, durations(msgs), -600_000)


def chat_clamped(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    return chat.align(msgs, durations(msgs), -600_000, clamp=True).select("event_id", "ts_ms")


def chat_author_aliases(spark, sf_dir):
    """Pseudonyms in order of first message."""
    from ..sources.chat_files import alias_authors

    msgs = messages(spark, sf_dir).withColumnRenamed("event_id", "row_number")
    return alias_authors(msgs).select("row_number", "alias")


BUCKETS = f"""{MESSAGES},
marked AS (SELECT *, CAST(floor(ts_ms / 5000) AS INTEGER) AS bucket, left(regexp_replace(lower(text), '\\s+', '', 'g'), 160) AS norm FROM messages WHERE ts_ms BETWEEN 0 AND 3599999),
axis AS (SELECT broadcast_id, CAST(unnest(range(0, 720)) AS INTEGER) AS bucket FROM (SELECT DISTINCT broadcast_id FROM messages)),
per_author AS (SELECT broadcast_id, bucket, count(*) AS n_authors, max(n) AS top_author FROM (SELECT broadcast_id, bucket, author_id, count(*) AS n FROM marked WHERE author_id <> '' GROUP BY ALL) GROUP BY ALL),
per_text AS (SELECT broadcast_id, bucket, sum(n - 1) AS n_repeats FROM (SELECT broadcast_id, bucket, norm, count(*) AS n FROM marked WHERE norm <> '' GROUP BY ALL) GROUP BY ALL),
counted AS (SELECT broadcast_id, bucket, count(*) AS n_messages, count(*) FILTER (WHERE regexp_matches(text, '(?i){T.REACTIONS}')) AS n_reactions FROM marked GROUP BY ALL),
dense AS (SELECT broadcast_id, bucket, coalesce(n_messages, 0) AS n_messages, coalesce(n_reactions, 0) AS n_reactions, coalesce(n_authors, 0) AS n_authors, coalesce(top_author, 0) AS top_author, CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_repeats
  FROM axis LEFT JOIN counted USING (broadcast_id, bucket) LEFT JOIN per_author USING (broadcast_id, bucket) LEFT JOIN per_text USING (broadcast_id, bucket))"""

SCORES = f"""{BUCKETS},
rolled AS (SELECT *, list(n_messages) OVER w AS m0, list(n_authors) OVER w AS u0 FROM dense WINDOW w AS (PARTITION BY broadcast_id ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 2 PRECEDING)),
based AS (SELECT r.*, CASE WHEN bucket > 4 THEN m0 ELSE (SELECT list(d.n_messages) FROM dense d WHERE d.broadcast_id = r.broadcast_id AND abs(d.bucket - r.bucket) > 1) END AS m,
  CASE WHEN bucket > 4 THEN u0 ELSE (SELECT list(d.n_authors) FROM dense d WHERE d.broadcast_id = r.broadcast_id AND abs(d.bucket - r.bucket) > 1) END AS u FROM rolled r),
centred AS (SELECT *, list_median(m) AS msg_base, list_median(u) AS uniq_base FROM based),
spread AS (SELECT *, list_median(list_transform(m, lambda x: abs(x - msg_base))) AS msg_mad, list_median(list_transform(u, lambda x: abs(x - uniq_base))) AS uniq_mad FROM centred),
signals AS (SELECT *, least(8.0, greatest(-3.0, (n_messages - msg_base) / greatest(1.0, 1.4826 * msg_mad)))::DOUBLE AS msg_score, (n_messages + 1) / (msg_base + 1) AS msg_ratio,
  least(8.0, greatest(-3.0, (n_authors - uniq_base) / greatest(1.0, 1.4826 * uniq_mad)))::DOUBLE AS uniq_score, (n_authors + 1) / (uniq_base + 1) AS uniq_ratio,
  CASE WHEN n_messages = 0 THEN 0 ELSE n_repeats / n_messages END AS rep, CASE WHEN n_messages = 0 THEN 0 ELSE top_author / n_messages END AS single, CASE WHEN n_messages = 0 THEN 0 ELSE n_reactions / n_messages END AS react FROM spread),
penalised AS (SELECT *, rep * 3 + greatest(0.0, single - 0.5) * 4 + CASE WHEN rep >= 0.8 AND single >= 0.75 THEN 2 ELSE 0 END AS spam_penalty FROM signals),
raw AS (SELECT *, greatest(0.0, msg_score) * 1.1 + greatest(0.0, uniq_score) * 0.8 + react * 2.25 + ln(1 + n_messages) * 0.15 - spam_penalty AS raw FROM penalised),
scored AS (SELECT *, floor(raw * 1e6 + 0.5) / 1e6 AS score, ((n_messages >= 4 AND (msg_score >= 2.5 OR msg_ratio >= 2.5)) OR (n_authors >= 3 AND n_reactions >= 2 AND (uniq_score >= 1.5 OR uniq_ratio >= 2)))
  AND NOT (rep >= 0.8 AND single >= 0.75) AND raw >= 2.25 AS eligible FROM raw),
peaks AS (SELECT * FROM scored WINDOW w AS (PARTITION BY broadcast_id ORDER BY bucket) QUALIFY eligible AND score > coalesce(lag(score) OVER w, '-infinity'::DOUBLE) AND score >= coalesce(lead(score) OVER w, '-infinity'::DOUBLE))"""


def greedy_sql(name: str, source: str, order: str, most: int, clash: str, keys: str = "broadcast_id") -> str:
    """Recursive SQL for a greedy choice: rows of source in order, each taken unless it clashes with a taken row t."""
    return f"""{name}_ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}),
{name}_fold AS (
  SELECT {keys}, 0::BIGINT AS rn, []::STRUCT(s BIGINT, e BIGINT, a BIGINT, b BIGINT)[] AS taken, false AS took FROM (SELECT DISTINCT {keys} FROM {source})
  UNION ALL
  SELECT f.{keys}, r.rn, CASE WHEN t.ok THEN list_append(f.taken, {{'s': r.s::BIGINT, 'e': r.e::BIGINT, 'a': r.a::BIGINT, 'b': r.b::BIGINT}}) ELSE f.taken END, t.ok
  FROM {name}_fold f JOIN {name}_ranked r ON r.{keys} = f.{keys} AND r.rn = f.rn + 1,
  LATERAL (SELECT len(f.taken) < {most} AND len(list_filter(f.taken, lambda t: {clash})) = 0 AS ok) t),
{name} AS (SELECT r.*, row_number() OVER (PARTITION BY r.{keys} ORDER BY r.rn) AS pick FROM {name}_ranked r JOIN {name}_fold f ON r.{keys} = f.{keys} AND r.rn = f.rn WHERE f.took)"""


DISJOINT = "greatest(t.s, r.s) < least(t.e, r.e)"
CHOSEN = f"""{SCORES},
shaped AS (SELECT *, bucket * 5000 + 2500 AS peak_ms, greatest(0, least(bucket * 5000 + 2500 - 20000, 3555000)) AS s FROM peaks),
placed AS (SELECT *, s + 45000 AS e, 0 AS a, 0 AS b FROM shaped),
{greedy_sql("chosen", "placed", "score DESC, bucket", 12, DISJOINT)}"""

QUERIES = {
    "chat_buckets": (chat_buckets, f"WITH {BUCKETS} SELECT * FROM dense"),
    "chat_bucket_scores": (chat_bucket_scores, f"WITH {SCORES} SELECT broadcast_id, bucket, {', '.join(rounded(c, c) for c in ('msg_base', 'msg_score', 'msg_ratio', 'uniq_base', 'uniq_score', 'uniq_ratio', 'spam_penalty', 'score'))}, eligible FROM scored"),
    "chat_local_peaks": (chat_local_peaks, f"WITH {SCORES} SELECT broadcast_id, bucket, {rounded('score', 'score')} FROM peaks"),
    "chat_highlights": (chat_highlights, f"WITH RECURSIVE {CHOSEN} SELECT broadcast_id, CAST(pick AS INTEGER) AS pick, peak_ms::BIGINT AS peak_ms, s::BIGINT AS start_ms, e::BIGINT AS end_ms, {rounded('score', 'score')}, n_messages, n_authors FROM chosen"),
    "chat_alignment": (chat_alignment, f"WITH {MESSAGES} SELECT broadcast_id, count(*) FILTER (WHERE ts_ms >= 600000) AS n_inside, count(*) FILTER (WHERE ts_ms < 600000) AS n_before, count(*) FILTER (WHERE ts_ms >= 4200000) AS n_after FROM messages GROUP BY ALL"),
    "chat_clamped": (chat_clamped, f"WITH {MESSAGES} SELECT event_id, greatest(0, ts_ms - 600000) AS ts_ms FROM messages"),
    "chat_author_aliases": (chat_author_aliases, f"""WITH {MESSAGES}, firsts AS (SELECT broadcast_id, author_id, min(event_id) AS f FROM messages GROUP BY ALL),
      named AS (SELECT broadcast_id, author_id, 'author_' || lpad(CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY f) AS VARCHAR), 6, '0') AS alias FROM firsts)
      SELECT event_id AS row_number, alias FROM messages JOIN named USING (broadcast_id, author_id)"""),
}
