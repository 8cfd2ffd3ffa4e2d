"""The two best prototypes and the agreement of a label's samples against all pairs."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import voice_search


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.mark.parametrize("most", [10_000, 37])
def test_best_two_equal_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(voice_search, "MOST_PROTOTYPES", most)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16))
    protos = unit(np.concatenate([centres[k % 12] + rng.normal(0, 0.1, 16) for k in range(150)]).reshape(150, 16))
    protos[7] = protos[3]  # a tie
    queries = np.concatenate([centres[rng.integers(0, 12, 200)] + rng.normal(0, 0.2, (200, 16)), -protos[:1], protos[3:4], rng.normal(0, 1, (20, 16))])
    rows = [(k, q.tolist()) for k, q in enumerate(queries)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, [0.0] * 16), (-3, [1.0]), (0, rows[0][1])], "id long, embedding array<double>")
    p = spark.createDataFrame([(f"p{k:03}", v.tolist()) for k, v in enumerate(protos)], "label string, prototype array<double>")
    got = {(r["id"], r["place"]): r for r in voice_search.best_two(df, p).collect()}
    assert len(got) == 2 * len(queries)
    cos = np.clip(unit(queries) @ protos.T, 0, 1)
    for k in range(len(queries)):
        order = sorted(range(150), key=lambda j: (-round(cos[k, j], 12), j))
        for place in (1, 2):
            assert got[k, place]["score"] == pytest.approx(cos[k, order[place - 1]], abs=1e-12) and got[k, place]["label"] == f"p{order[place - 1]:03}"
    if most > 150:
        assert np.mean([got[k, 1]["compared"] for k in range(200)]) < 50  # of 150
    assert {r["verdict"] for r in voice_search.identify(voice_search.best_two(df, p), 0.6, 0.004).collect()} == {"unknown", "ambiguous", "identified"}
    assert voice_search.best_two(df, p.limit(0)).collect() == [] and voice_search.best_two(df.limit(0), p).collect() == []


def all_pairs(x):
    c = np.clip(unit(x) @ unit(x).T, 0, 1)[np.triu_indices(len(x), 1)]
    return len(c), c.mean(), c.min()


@pytest.mark.parametrize("tile", [512, 9])
def test_consistency_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(voice_search, "TILE", tile)
    rng = np.random.default_rng(4)
    own = {"close": rng.normal(0, 0.05, (120, 8)) + rng.normal(0, 1, 8), "wide": rng.normal(0, 1, (60, 8)), "pair": np.eye(8)[:2], "one": np.ones((1, 8)), "same": np.ones((5, 8)), "balanced": np.concatenate([np.eye(8), -np.eye(8)])}
    rows = [(label, k, v.tolist()) for label, x in own.items() for k, v in enumerate(x)] + [("close", 999, [0.0] * 8), ("none", 1, None)]
    df = spark.createDataFrame(rows, "label string, id long, embedding array<double>")
    got = {r["label"]: r for r in voice_search.consistency(df).collect()}
    assert set(got) == {"close", "wide", "pair", "same", "balanced"}
    for label in got:
        n, mean, least = all_pairs(own[label])
        assert got[label]["n_pairs"] == n and got[label]["mean_cosine"] == pytest.approx(mean, abs=1e-9) and got[label]["least_cosine"] == pytest.approx(least, abs=1e-9), label
    if tile == 9:
        assert got["close"]["n_compared"] < got["close"]["n_pairs"] and got["wide"]["n_compared"] == got["wide"]["n_pairs"]


def test_consistency_of_one_large_label(spark):
    """20,000 samples of one voice are 200 million pairs; few are measured."""
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 1, 16)
    x = centre + rng.normal(0, 1, (20_000, 1)) ** 2 * rng.normal(0, 0.02, (20_000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").withColumn("label", F.lit("a"))
    began = time.time()
    got = voice_search.consistency(df).first()
    assert got["n_pairs"] == 20_000 * 19_999 // 2 and got["n_compared"] < 0.1 * got["n_pairs"] and time.time() - began < 60
    u = unit(x)
    assert got["mean_cosine"] == pytest.approx(((u.sum(axis=0) ** 2).sum() - 20_000) / 2 / got["n_pairs"], abs=1e-9)
    far = u[np.argsort(u @ unit(u.sum(axis=0)))[:3000]]
    assert got["least_cosine"] == pytest.approx((far @ far.T).min(), abs=1e-9)
