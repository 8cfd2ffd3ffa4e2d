"""Fingerprint identity: acceptance before distance, durations, thirds, shares, offsets, unique choice; against plain loops."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from crestline.operators import identity

ANCHORS = "video_id string, anchor int, ts_ms long, dhash long, blockhash long, mean_luma int, duration_ms long"
SAMPLES = "broadcast_id string, ts_ms long, dhash long, blockhash long, mean_luma int"
OFFSETS = range(-30_000, 30_001, 5_000)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain_match(anchors, duration, samples, offset):
    """(evaluated, matched, thirds, median, p90) of one video and broadcast."""
    evaluated, taken, thirds = 0, [], set()
    for ts, d, b, luma in anchors:
        seen = []
        for t, d2, b2, luma2 in samples:
            if abs(t - ts - offset) <= 2750:
                h, k = ((d ^ d2) & (2**64 - 1)).bit_count(), ((b ^ b2) & (2**64 - 1)).bit_count()
                seen.append((not (h <= 18 and k <= 20 and h + k <= 32 and abs(luma - luma2) <= 56), h + k))
        if seen:
            evaluated += 1
            refused, distance = min(seen)
            if not refused:
                taken.append(distance)
                thirds.add(min(2, ts * 3 // duration))
    taken.sort()
    return evaluated, len(taken), len(thirds), statistics.median(taken) if taken else None, taken[-(-9 * len(taken) // 10) - 1] if taken else None


def frames(spark, anchors, samples):
    a = [(v, i, ts, signed(d), signed(b), luma, duration) for v, (duration, rows) in anchors.items() for i, (ts, d, b, luma) in enumerate(rows)]
    s = [(v, t, signed(d), signed(b), luma) for v, rows in samples.items() for t, d, b, luma in rows]
    return spark.createDataFrame(a, ANCHORS), spark.createDataFrame(s, SAMPLES)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(7)
    flip = lambda x, n: x ^ sum(1 << k for k in rnd.sample(range(64), n))
    anchors, samples, lengths = {}, {}, {}
    for v in range(6):
        duration = 600_000 + 700 * v
        anchors[f"v{v}"] = (duration, [(25_000 + 50_000 * i, rnd.getrandbits(64), rnd.getrandbits(64), rnd.randrange(256)) for i in range(12)])
    for v, (duration, rows) in anchors.items():
        for shift, noise in ((0, 6), (10_000, 9), (2_000, 14)):
            name = f"{v}+{shift}"
            lengths[name] = duration + shift // 10
            samples[name] = [(ts + shift, flip(d, rnd.randint(0, noise)), flip(b, rnd.randint(0, noise)), luma) for ts, d, b, luma in rows if rnd.random() < 0.9]
            samples[name] += [(ts + shift + 1500, rnd.getrandbits(64), flip(b, 2), luma) for ts, d, b, luma in rows]
    samples["short"], lengths["short"] = samples["v0+0"][:5], 600_000
    return anchors, samples, lengths


def test_durations(spark):
    cases = [(1_000_000, 2_000), (2_000_000, 2_000), (2_500_400, 2_500), (2_500_500, 2_501), (9_000_000, 9_000), (36_000_000, 10_000)]
    df = spark.createDataFrame(cases, "duration_ms long, want long")
    assert df.where(identity.duration_tolerance(F.col("duration_ms")) != F.col("want")).count() == 0
    videos = spark.createDataFrame([(f"v{ms}", ms) for ms, _ in cases], "video_id string, duration_ms long")
    around = [(f"{ms}{d:+}", ms + d) for ms, t in cases for d in (-t - 1, -t, 0, t, t + 1)]
    got = {(r[0], r[1]) for r in identity.compatible_pairs(videos, spark.createDataFrame(around, "broadcast_id string, duration_ms long")).collect()}
    assert got == {(f"v{ms}", name) for ms, t in cases for name, other in around if abs(ms - other) <= t}


def test_accepted_samples_come_first(spark):
    """An anchor with samples at (19, 0) and (10, 12) bits takes the second, though it is farther."""
    anchors, samples = frames(spark, {"v": (600_000, [(5_000, 0, 0, 9)])}, {"b": [(5_000, 2**19 - 1, 0, 9), (6_000, 2**10 - 1, 2**12 - 1, 9)]})
    got = identity.match_offsets(anchors, samples, spark.createDataFrame([("v", "b")], "video_id string, broadcast_id string"), [0]).first()
    assert (got["n_evaluated"], got["n_matched"], got["median_distance"], got["p90_distance"]) == (1, 1, 22, 22)


def test_matches_equal_plain_loops(spark, case):
    anchors, samples, lengths = case
    a, s = frames(spark, anchors, samples)
    pairs = spark.createDataFrame([(v, b) for v in anchors for b in samples], "video_id string, broadcast_id string")
    got = {(r["video_id"], r["broadcast_id"], r["offset_ms"]): tuple(r)[4:] for r in identity.match_offsets(a, s, pairs).collect()}
    want = {(v, b, o): plain_match(rows, duration, samples[b], o) for v, (duration, rows) in anchors.items() for b in samples for o in OFFSETS}
    assert got == want
    decided = {(r["video_id"], r["broadcast_id"]): r for r in identity.decide(identity.match_offsets(a, s, pairs), s).collect()}
    for (v, b), r in decided.items():
        few = len(samples[b]) < 8
        best = min(OFFSETS, key=lambda o: (-want[v, b, o][1], -want[v, b, o][2], 1e9 if want[v, b, o][3] is None else want[v, b, o][3], abs(o), o))
        n, matched, thirds, median, p90 = want[v, b, best]
        assert r["offset_ms"] == (None if few else best)
        assert r["matched"] == (not few and n >= 9 and matched >= 9 and thirds == 3 and median <= 21 and p90 <= 32)
    assert {r["reason"] for r in decided.values()} >= {"multi-anchor-consensus", "anchor-consensus-failed", "insufficient-local-samples"}
    assert any(r["matched"] and r["offset_ms"] == 10_000 for r in decided.values())


def test_only_offset_zero_makes_it_unique(spark, case):
    anchors, samples, lengths = case
    a, s = frames(spark, anchors, samples)
    twin = a.where("video_id = 'v3'").withColumn("video_id", F.lit("twin"))
    a = a.unionByName(twin)
    broadcasts = spark.createDataFrame(list(lengths.items()) + [("none", 1)], "broadcast_id string, duration_ms long")
    pairs = identity.compatible_pairs(a.select("video_id", "duration_ms").distinct(), broadcasts)
    got = {r[0]: tuple(r)[1:] for r in identity.unique_match(broadcasts, identity.decide(identity.match_offsets(a, s, pairs, [0]), s)).collect()}
    assert got["v0+0"] == (1, "verified", "v0") and got["v3+0"] == (2, "ambiguous", None)
    assert got["v0+10000"] == got["short"] == got["none"] == (0, "none", None) and len(got) == len(lengths) + 1


def test_two_thirds_are_not_enough(spark):
    rows = [(10_000 + 15_000 * i, 77, 99, 50) for i in range(12)]
    anchors, samples = frames(spark, {"v": (600_000, rows)}, {"b": rows})
    pairs = spark.createDataFrame([("v", "b")], "video_id string, broadcast_id string")
    assert identity.decide(identity.match_offsets(anchors, samples, pairs, [0]), samples).first()["reason"] == "insufficient-temporal-coverage"
    empty = samples.limit(0)
    assert identity.decide(identity.match_offsets(anchors, empty, pairs), empty).first()["reason"] == "insufficient-local-samples"
