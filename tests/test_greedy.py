"""Choices by parts against plain loops over whole broadcasts, and their work on one long broadcast."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from crestline.operators import fusion, greedy, leads, selection

KINDS = ["audio", "chat", "visual", "semantic"]


def scattered(n: int, seed: int, span_ms: int) -> list[tuple]:
    """Intervals with gaps between some of them, ties and repeats included; the third broadcast has one without length."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.randrange(0, span_ms, 500)
        length = r.choice([1000, 8000, 20_000, 45_000])
        rows.append((i % 3, i, KINDS[r.randrange(4)], start + r.randrange(0, length, 500), start, start + length, r.randrange(1, 20) / 20, str(r.randrange(40))))
    return [*rows, (2, n, "chat", 5000, 5000, 5000, 0.5, "x")]


@pytest.fixture(scope="module", params=[1, 2])
def found(request, spark):
    rows = scattered(240, request.param, 4_000_000)
    schema = "broadcast_id long, id long, kind string, peak_ms long, start_ms long, end_ms long, score double, key string"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def test_suppress_and_spacing_by_parts(found):
    rows, df = found
    order = [F.desc("score"), F.asc("start_ms"), F.asc("id")]
    ranked = sorted(rows, key=lambda r: (-r[6], r[4], r[1]))

    def plain(clash, most):
        taken = {}
        for r in ranked:
            own = taken.setdefault(r[0], [])
            if len(own) < most and not any(clash(a, r) for a in own):
                own.append(r)
        return sorted((b, r[1], k) for b, own in taken.items() for k, r in enumerate(own, 1))

    def over(a, x):
        met = min(a[5], x[5]) - max(a[4], x[4])
        return met > 0 and met >= 0.5 * min(a[5] - a[4], x[5] - x[4])

    got = lambda d: sorted((r.broadcast_id, r.id, r.pick) for r in d.collect())
    for most in (7, 96):
        assert got(greedy.suppress(df, ["broadcast_id"], order, most)) == plain(over, most)
        assert got(greedy.keep_disjoint(df, ["broadcast_id"], order, most)) == plain(lambda a, x: max(a[4], x[4]) < min(a[5], x[5]), most)
        assert got(greedy.keep_spaced(df, ["broadcast_id"], order, most, 30_000, "peak_ms")) == plain(lambda a, x: abs(a[3] - x[3]) < 30_000, most)


def test_intervals_without_beginning_or_end(spark):
    df = spark.createDataFrame([(1, 1, 100, None), (1, 2, 500, 600), (1, 3, 0, 50), (2, 1, None, 10), (2, 2, 5, 9), (2, 3, 20, 30)], "b long, id long, start_ms long, end_ms long")
    got = greedy.keep_disjoint(df, ["b"], [F.asc("id")], 9)
    assert sorted((r.b, r.id) for r in got.collect()) == [(1, 1), (1, 3), (2, 1), (2, 3)]
    assert greedy.keep_disjoint(df.limit(0), ["b"], [F.asc("id")], 9).collect() == []


def test_columns_that_have_no_order_are_kept(spark):
    df = spark.sql("SELECT 1L AS b, 0L AS start_ms, 5L AS end_ms, map('a', 1) AS m UNION ALL SELECT 1L, 2L, 6L, map('b', 2)")
    got = greedy.keep_disjoint(df, ["b"], [F.asc("start_ms")], 9).collect()
    assert [(r.m, r.pick) for r in got] == [({"a": 1}, 1)]


def test_matching_by_parts(spark):
    r = random.Random(4)
    rows = sorted({(1, i % 40, i % 37, 30_000 * (i % 40), 30_000 * (i % 40) + 4000 * (i % 37 % 3), r.randrange(5)) for i in range(200)})
    rows = [(b, a, 1000 + s // 1000, p, s, w) for b, a, c, p, s, w in rows]
    df = spark.createDataFrame(rows, "b long, l long, r long, l_at long, r_at long, w int").repartition(3)
    used, want = set(), []
    for row in sorted(rows, key=lambda x: (-x[5], x[1], x[2])):
        if ("l", row[1]) not in used and ("r", row[2]) not in used:
            used |= {("l", row[1]), ("r", row[2])}
            want.append((row[1], row[2], len(want) + 1))
    got = greedy.match_pairs(df, ["b"], [F.desc("w"), F.asc("l"), F.asc("r")], "l", "r", ("l_at", "r_at"))
    assert sorted((x.l, x.r, x.pick) for x in got.collect()) == sorted(want)


def test_fused_sources_by_parts(found):
    rows, df = found
    want = []
    for b in range(3):
        taken = []
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: (r[2] != "semantic", -r[6], r[4], r[1])):
            for a in taken:
                over = max(0, min(a["end"], r[5]) - max(a["start"], r[4]))
                near = over >= 0.5 * min(a["end"] - a["start"], r[5] - r[4]) or abs(a["peak"] - r[3]) <= 8000
                if near and not ("semantic" in a["kinds"] and r[2] == "semantic"):
                    a["ids"].append(r[1])
                    a["kinds"].add(r[2])
                    a["score"] = min(1.0, 1 - (1 - a["score"]) * (1 - r[6]))
                    break
            else:
                taken.append({"ids": [r[1]], "kinds": {r[2]}, "start": r[4], "end": r[5], "peak": r[3], "score": r[6]})
        want += [(b, n, sorted(a["ids"]), sorted(a["kinds"]), a["start"], a["end"], round(a["score"], 9)) for n, a in enumerate(taken)]
    got = fusion.fuse_sources(df).collect()
    assert sorted((r.broadcast_id, r.n, r.ids, r.kinds, r.start_ms, r.end_ms, round(r.score, 9)) for r in got) == sorted(want)


def test_episodes_by_parts(found):
    rows, df = found
    span, want = selection.SPAN_MS, []
    for b in range(3):
        made = []
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: (r[4], r[3], r[1])):
            for e in reversed(made):
                over = max(0, min(e["end"], r[5]) - max(e["start"], r[4]))
                near = over >= 0.35 * max(1, min(e["end"] - e["start"], r[5] - r[4])) or over > 0 and abs(r[3] - e["rep"][1]) <= 30_000
                if max(e["end"], r[5]) - min(e["start"], r[4]) <= span and (near or r[7] in e["keys"] and r[4] - e["end"] <= span):
                    e["ids"].append(r[1])
                    e["keys"].add(r[7])
                    e["start"], e["end"], e["rep"] = min(e["start"], r[4]), max(e["end"], r[5]), min(e["rep"], (-r[6], r[3], r[1]))
                    break
            else:
                made.append({"ids": [r[1]], "keys": {r[7]}, "start": r[4], "end": r[5], "rep": (-r[6], r[3], r[1])})
        want += [(b, n, sorted(e["ids"]), e["start"], e["end"], e["rep"][2]) for n, e in enumerate(made)]
    got = selection.build_episodes(df).collect()
    assert sorted((r.broadcast_id, r.episode, r.ids, r.start_ms, r.end_ms, r.representative) for r in got) == sorted(want)


def test_farthest_first_equals_all_distances():
    r = random.Random(9)
    for _ in range(300):
        n = r.randrange(1, 40)
        at = sorted(r.randrange(r.choice([5, 60, 1000])) for _ in range(n))
        rank = r.sample(range(n), n)
        order = sorted(range(n), key=lambda k: (at[k], rank[k]))
        rank = [rank[k] for k in order]
        focus = r.random() * 60
        want = [min(range(n), key=lambda k: (abs(at[k] - focus), rank[k]))]
        while len(want) < n:
            rest = [k for k in range(n) if k not in want]
            want.append(min(rest, key=lambda k: (-min(abs(at[k] - at[p]) for p in want), rank[k])))
        assert leads.farthest_first(at, rank, focus) == want


def test_one_long_broadcast(spark):
    n = 100_000
    base = spark.range(n).selectExpr("1L AS broadcast_id", "id", "id * 200000 + (id * 7919) % 90000 AS start_ms", "(id % 97) / 97D AS score", "element_at(array('audio', 'chat', 'visual'), cast(id % 3 + 1 AS int)) AS kind", "cast(id % 50 AS string) AS key")
    df = base.selectExpr("*", "start_ms + 10000 AS peak_ms", "start_ms + 45000 AS end_ms", "id AS n")
    began = time.time()
    assert greedy.suppress(df, ["broadcast_id"], [F.desc("score"), F.asc("id")], n).count() == n
    assert selection.build_episodes(df).count() == n
    assert fusion.fuse_sources(df).count() == n
    assert leads.scattered_order(df.select("broadcast_id", "n", "start_ms", "end_ms")).count() == n
    assert time.time() - began < 120
