"""Operators without SQL, and small cases with known results."""

from __future__ import annotations

import hashlib
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import numbers as N
from crestline.functions import text as T
from crestline.operators import audio, chat, context, intervals, leads, selection, visual
from crestline.sources import chat_files, documents
from crestline.streaming import live


def one(df):
    return df.first()[0]


def test_chat_spike_is_found(spark):
    quiet = [("b", t, "hello there", f"u{t}") for t in range(2500, 120_000, 5000)]
    spike = [("b", 60_000 + 100 * k, "ㅋㅋㅋ 대박!!", f"s{k}") for k in range(14)]
    msgs = spark.createDataFrame(quiet + spike, "broadcast_id string, ts_ms long, text string, author_id string")
    durations = spark.createDataFrame([("b", 120_000)], "broadcast_id string, duration_ms long")
    found = chat.select_highlights(msgs, durations).collect()
    assert [(r["peak_ms"], r["start_ms"], r["end_ms"], r["n_messages"]) for r in found] == [(62_500, 42_500, 87_500, 15)]


def test_single_author_spam_is_not_eligible(spark):
    spam = [("b", 60_000 + 10 * k, "buy buy", "one") for k in range(40)]
    msgs = spark.createDataFrame(spam, "broadcast_id string, ts_ms long, text string, author_id string")
    durations = spark.createDataFrame([("b", 120_000)], "broadcast_id string, duration_ms long")
    assert chat.select_highlights(msgs, durations).count() == 0


@pytest.mark.parametrize(("k", "rate"), [(0, 0.5), (3, 1.2), (12, 4.0), (900, 850.0)])
def test_poisson_tail(spark, k, rate):
    got = one(spark.range(1).select(N.poisson_tail(F.lit(k), F.lit(rate))))
    total = sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k))
    assert got == pytest.approx(max(0.0, min(1.0, 1 - total)) if k else 1.0, abs=2e-3)


def test_density_marks_burst_and_quiet(spark):
    counts = [1, 2, 10, 0, 1, 1]
    points = spark.createDataFrame([("b", 300_000 * b + i) for b, n in enumerate(counts) for i in range(n)], "broadcast_id string, t_ms long")
    durations = spark.createDataFrame([("b", 1_800_000)], "broadcast_id string, duration_ms long")
    kinds = [r["density"] for r in selection.event_density(points, durations).orderBy("bin").collect()]
    assert kinds[2] == "burst" and kinds[3] == "quiet"


def test_text_functions(spark):
    texts = ["plain", "=SUM(A1)", "aaaa   bbb\tccc", "x" * 900, "é​à" * 200, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    got = df.select(T.norm_repeat(c), T.csv_safe(c), T.head_tail(c, 300), T.representative(c, 400), T.clean_text(c, 50)).collect()
    for t, r in zip(texts, got, strict=True):
        assert r[1] == ("'" + t if t[:1] in ("=", "+", "-", "@") else t)
        assert len(r[2]) <= 300 and len(r[3]) <= 400 and len(r[4]) <= 50
        assert (r[2] == t) == (len(t) <= 300)
        assert "aaa" not in r[0]
    assert one(df.limit(1).select(T.content_fingerprint(F.lit("ab"), F.lit("c")))) == hashlib.sha256(b"2:ab|1:c").hexdigest()


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁ①Ａ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.nfkc("t")).collect()] == [unicodedata.normalize("NFKC", "ﬁ①Ａ"), None]


def test_diverse_selection_prefers_distance(spark):
    rows = [("b", k, k * 1000 * s, k * 1000 * s + 45_000, k, k * 1000 * s + 20_000, q, ["audio"], [f"k{k}"]) for k, (s, q) in enumerate([(1, 1.0), (1, 0.99), (300, 0.9)])]
    df = spark.createDataFrame(rows, "broadcast_id string, episode int, start_ms long, end_ms long, representative long, peak_ms long, score double, kinds array<string>, keys array<string>").withColumn("broadcast_id", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "broadcast_id long, block int, quota double, block_ms double")
    picks = [r["representative"] for r in selection.select_diverse(df, none, budget=2, balance=0.5).orderBy("pick").collect()]
    assert picks == [0, 2]


def test_frame_descriptor_and_seeds(spark):
    flat, ramp = [10] * 64, [k * 4 for k in range(64)]
    rows = [("b", 5000 * k, ramp if k >= 30 else flat) for k in range(60)]
    frames = spark.createDataFrame(rows, "broadcast_id string, ts_ms long, luma array<int>")
    described = visual.describe(frames)
    assert described.where("ts_ms = 0").first()["mean_luma"] == 10
    assert [r["ts_ms"] for r in visual.visual_seeds(described).collect()] == [150_000]


def test_subtract_and_coverage(spark):
    plan = spark.createDataFrame([("b", 1, 0, 100), ("b", 2, 100, 200)], "k string, id int, start_ms long, end_ms long")
    cover = spark.createDataFrame([("b", 20, 30), ("b", 25, 50), ("b", 90, 120), ("b", 190, 300)], "k string, start_ms long, end_ms long")
    left = intervals.subtract(plan, cover, ["k"], "id").orderBy("start_ms").collect()
    assert [(r["id"], r["start_ms"], r["end_ms"]) for r in left] == [(1, 0, 20), (1, 50, 90), (2, 120, 190)]
    assert intervals.covered_ms(cover, ["k"]).first()["covered_ms"] == 30 + 30 + 110


def test_readers_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages":[{"relativeMs":"1500","text":"hi","user":"u"},{"time":"01:02:03.500","content":"yo"}]}')
    messages, rejects = chat_files.import_chat(chat_files.read_chat_json(spark, str(tmp_path / "a.json")))
    assert sorted(r["ts_ms"] for r in messages.collect()) == [1500, 3_723_500] and rejects.count() == 0
    (tmp_path / "b.jsonl").write_text('{"seconds": 2, "body": "a"}\nbroken\n{"seconds": 3}\n')
    messages, rejects = chat_files.import_chat(chat_files.read_chat_jsonl(spark, str(tmp_path / "b.jsonl")))
    assert [r["ts_ms"] for r in messages.collect()] == [2000] and sorted(r["code"] for r in rejects.collect()) == ["malformed-row", "missing-text"]
    (tmp_path / "c.csv").write_text('Time,Message,Nickname\n5,"a ""quoted""\nline",me\n')
    messages, _ = chat_files.import_chat(chat_files.read_chat_csv(spark, str(tmp_path / "c.csv")))
    assert [(r["ts_ms"], r["text"], r["author_id"]) for r in messages.collect()] == [(5000, 'a "quoted"\nline', "me")]
    (tmp_path / "feed.xml").write_text("<feed><entry><yt:videoId>abc</yt:videoId><yt:channelId>c</yt:channelId><title>T</title><published>2024-01-02T03:04:05+00:00</published><updated>2024-01-02T03:04:05+00:00</updated></entry></feed>")
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x><feed><entry></entry></feed>")
    assert [r["video_id"] for r in documents.read_atom_feed(spark, str(tmp_path / "*.xml")).collect()] == ["abc"]


def test_detect_format(spark):
    heads = ["[1]", '{"a":1}', '{"a":1}\n{"b":2}', "a,b\n1,2", "  ", "﻿[1]"]
    df = spark.createDataFrame([(h,) for h in heads], "v string")
    assert [r[0] for r in df.select(chat_files.detect_format(F.col("v"))).collect()] == ["json", "json", "jsonl", "csv", "empty", "json"]


def test_fence_takes_every_allowed_pair(spark, tmp_path):
    n = 120_000
    spark.range(n).selectExpr("id as event_id", "id as session_id", "id % 3 as epoch", "timestamp_millis(1700000000000) as ts").write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("event_id long, session_id long, epoch long, ts timestamp").parquet(str(tmp_path / "events"))
    live.run_to_table(live.fence(events, spark.range(n).selectExpr("id as session_id", "id % 3 as epoch")), str(tmp_path / "out"), "append")
    assert spark.read.parquet(str(tmp_path / "out" / "batches")).count() == n


def plain_selection(rows, quotas, width, budget=12, balance=0.75, share=0.15):
    """The selection by plain loops over dictionaries."""
    low, high = min(r["score"] for r in rows), max(r["score"] for r in rows)
    left = [dict(r, q=(r["score"] - low) / (high - low) if high - low > 2.2e-16 else min(1, max(0, r["score"])), dup=0.0, block=min(len(quotas) - 1, int(r["peak_ms"] // width))) for r in rows]
    used, seen, taken, slots = [0] * len(quotas), set(), [], min(budget, math.floor(budget * share + 0.5))

    def value(r):
        over = max(0, used[r["block"]] - max(0.25, quotas[r["block"]]) + 1)
        return round((balance * r["q"] + (1 - balance) * (1 - r["dup"])) / (1 + 0.35 * over) + 0.08 * r["recommended"], 9)

    def choose(pool):
        if not pool:
            return False
        best = min(pool, key=lambda r: (-value(r), -round(r["q"], 9), r["peak_ms"], r["representative"]))
        left.remove(best)
        taken.append(best["representative"])
        used[best["block"]] += 1
        seen.update(best["kinds"])
        for r in left:
            over = max(0, min(r["end_ms"], best["end_ms"]) - max(r["start_ms"], best["start_ms"])) / max(1, min(r["end_ms"] - r["start_ms"], best["end_ms"] - best["start_ms"]))
            weight = 0.8 if {*r["keys"]} & {*best["keys"]} else 0.2 if {*r["kinds"]} & {*best["kinds"]} else 0.1
            r["dup"] = max(r["dup"], over, weight * math.exp(-(((r["peak_ms"] - best["peak_ms"]) / 90_000) ** 2)))
        return True

    while len(taken) < budget - slots and choose([r for r in left if r["eligible"]]):
        pass
    while len(taken) < budget and left:
        fresh = [r for r in left if not used[r["block"]] or {*r["kinds"]} - seen]
        if not choose(fresh) and not choose([r for r in left if r["eligible"]]):
            break
    return taken


def test_diverse_selection_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b in range(6):
        for k in range(int(rng.integers(1, 40))):
            peak = int(rng.integers(0, 3_600_000))
            rows.append(dict(broadcast_id=b, episode=k, representative=k, start_ms=peak - 20_000, end_ms=peak + 25_000, peak_ms=peak, score=float(rng.random()), kinds=[["audio", "chat", "visual"][int(rng.integers(3))]], keys=[str(int(rng.integers(9)))], eligible=bool(rng.random() > 0.3), recommended=bool(rng.random() > 0.8)))
    schema = "broadcast_id long, episode int, representative long, start_ms long, end_ms long, peak_ms long, score double, kinds array<string>, keys array<string>, eligible boolean, recommended boolean"
    quotas = [(b, k, float(q), 900_000.0) for b in range(6) for k, q in enumerate([5.0, 3.0, 3.0, 1.0])]
    got = selection.select_diverse(spark.createDataFrame([tuple(r.values()) for r in rows], schema), spark.createDataFrame(quotas, "broadcast_id long, block int, quota double, block_ms double")).orderBy("broadcast_id", "pick").collect()
    for b in range(6):
        assert [r["representative"] for r in got if r["broadcast_id"] == b] == plain_selection([r for r in rows if r["broadcast_id"] == b], [5.0, 3.0, 3.0, 1.0], 900_000)


def test_scattered_order(spark):
    rows = [(1, k, 1000 * k, 1000 * (k + 1)) for k in range(21)] + [(2, 0, 5, 9)]
    got = {b: [] for b in (1, 2)}
    for r in leads.scattered_order(spark.createDataFrame(rows, "broadcast_id long, n int, start_ms long, end_ms long")).orderBy("pick").collect():
        got[r["broadcast_id"]].append(r["n"])
    center = [(k + 0.5) / 21 for k in range(21)]
    want = [min(range(21), key=lambda k: (round(abs(center[k] - leads.GOLDEN), 12), k))]
    while len(want) < 21:
        want.append(min((k for k in range(21) if k not in want), key=lambda k: (-round(min(abs(center[k] - center[j]) for j in want), 12), k)))
    assert got == {1: want, 2: [0]}


def test_refinement_plan_claims_by_rank(spark):
    rows = [(1, 1, 0, 100_000, 0.9), (1, 2, 50_000, 150_000, 0.8), (1, 3, 60_000, 90_000, 0.7), (1, 4, 0, 10, 0.5), (2, 5, 10_000, 500_000, 0.6)]
    df = spark.createDataFrame(rows, "broadcast_id long, lead int, start_ms long, end_ms long, confidence double")
    got = sorted(tuple(r) for r in leads.refinement_plan(df, 360_000).collect())
    # three leads share the budget: 120 s each; the third lies within the first
    assert got == [(1, 1, 0, 60_000), (1, 1, 60_000, 100_000), (1, 2, 100_000, 150_000), (2, 5, 75_000, 135_000), (2, 5, 135_000, 195_000), (2, 5, 195_000, 255_000), (2, 5, 255_000, 315_000), (2, 5, 315_000, 375_000), (2, 5, 375_000, 435_000)]


def test_refinement_leads_take_topics_in_turn(spark):
    rows = [(1, k, k // 6, 60_000 * k, 60_000 * k + 30_000, 0.5 + 0.01 * k, "select" if k in (1, 2, 7) else "reject", 0.9) for k in range(18)] + [(2, 1, 0, 0, 9, 0.9, "reject", 0.9)]
    got = leads.refinement_leads(spark.createDataFrame(rows, "broadcast_id long, lead int, topic int, start_ms long, end_ms long, confidence double, decision string, verdict_confidence double")).orderBy("pick").collect()
    assert {r["broadcast_id"] for r in got} == {1}
    # the jury's by confidence, then topic 1 (one selected) before topic 0 (two), each time the lead farthest away
    assert [r["lead"] for r in got] == [7, 2, 1, 11, 5, 9, 10, 4, 8, 6, 3, 0]


def test_windows_from_samples(spark):
    rng, rate = np.random.default_rng(2), 16_000
    seconds = [rng.normal(0, 0.2, (2, rate)).clip(-1, 1), np.zeros((2, rate)), None, np.stack([np.sin(np.arange(rate) * 2 * np.pi * 1000 / rate)] * 2) * [[0.5], [-0.5]], rng.normal(0, 0.1, (2, 7000))]
    rows = [(1, k, s.tolist()) for k, s in enumerate(seconds) if s is not None] + [(1, 9, [[], []]), (1, 10, None)]
    got = {r["i"]: r for r in audio.windows_from_samples(spark.createDataFrame(rows, "broadcast_id long, i int, channels array<array<double>>"), rate).collect()}
    assert sorted(got) == [0, 1, 3, 4]
    high, low, at = 8000 / (8000 + 2 * math.pi * 300), 1 - math.exp(-2 * math.pi * 3400 / 8000), None
    for k, s in enumerate(seconds):
        if s is None:
            at = None
            continue
        before, passed, band = at or (0.0, 0.0, 0.0) if k else (0.0, 0.0, 0.0)
        x = s[:, ::2]
        speech = 0.0
        for v in x.mean(axis=0):
            passed = high * (passed + v - before)
            band += low * (passed - band)
            before = v
            speech += band * band
        at = (before, passed, band)
        energy = (x * x).mean(axis=0)
        mono = x.mean(axis=0)
        want = (energy.mean() ** 0.5, np.abs(x).max(), ((mono[1:] >= 0) != (mono[:-1] >= 0)).mean(), min(1.0, speech / energy.sum()) if energy.sum() else 0.0)
        assert [got[k][c] for c in ("rms", "peak", "zcr", "speech")] == pytest.approx(want, abs=2e-5), k
    assert got[3]["rms"] > 0.35 and got[3]["speech"] == 0  # opposite phases keep their energy


def test_allocated_bytes(spark):
    rows = [([500, 40, 3000], 900), ([10, 10, 10], 900), ([5000, 5000, 5000], 301), ([0, 0, 0], 5), ([1000, 1000, 1], 600)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<int>, b int").select(T.allocate_bytes(F.col("s"), [2, 1, 3], F.col("b"), 100)).collect()]
    for (sizes, budget), given in zip(rows, got, strict=True):
        assert all(min(n, 100) <= g <= n for g, n in zip(given, sizes, strict=True))
        assert sum(given) == min(sum(sizes), max(budget, sum(min(n, 100) for n in sizes)))
    assert got[0] == [364, 40, 496]
    text = "é" * 500
    cut = one(spark.range(1).select(T.head_tail_bytes(F.lit(text), F.lit(99))))
    assert len(cut.encode()) <= 99 and cut.count("é") >= 47 and one(spark.range(1).select(T.head_tail_bytes(F.lit("ab"), F.lit(9)))) == "ab"


def test_identity_basis_vetoes(spark):
    rows = [(1, 2, None, None), (None, None, 3, 4), (None, None, None, 4), (None, 5, 1, 1), (None, None, None, None), (6, 2, None, None)]
    fits = lambda v: F.when(v < 5, v != 3)
    from crestline.functions import predicates

    df = spark.createDataFrame(rows, "m long, r long, f long, e long")
    got = df.select(*predicates.identity_basis(*(F.col(c) for c in "mrfe"), fits)).collect()
    assert [tuple(r) for r in got] == [("manual-pasted", 1), (None, None), ("editor-confirmed-catalog", 4), ("registered-local-binding", 5), (None, None), ("manual-pasted", 6)]


def test_context_of_empty_tables(spark):
    clips = spark.createDataFrame([], "broadcast_id long, id long, start_ms long, end_ms long, duration_ms long")
    cues = spark.createDataFrame([], "broadcast_id long, r_start long, r_end long, r_id long, text string")
    notes = spark.createDataFrame([], "id long, decision string, category string")
    assert context.context_packets(clips, cues, cues, notes).collect() == []
    assert context.subtitle_available(cues.select("broadcast_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")), clips).collect() == []
