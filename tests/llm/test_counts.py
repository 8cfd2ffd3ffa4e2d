"""Token counts, centroid clustering and source divergence against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from crestline.llm import centroids, divergence, token_counts

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def strings():
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "b", "ab", "the", "é", "日本", "\x00", "\xa0", "　", "<s>", "<0x41>", "😀", "\r\n", "...", "====", "ſ", "ﬁ", "é"]
    found = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    return [*found, " " * 5000, "\n" * 3000, "a" * 30_000, "日本語" * 9000, "".join(map(chr, rnd.sample(range(0xA0, 0xD7FF), 5000)))]


@pytest.mark.parametrize("part", [1 << 19, 50])
def test_safe_cuts_equal_whole_texts(strings, monkeypatch, part):
    monkeypatch.setattr(token_counts, "PART", part)
    assert token_counts.Safe.accepts(MODEL)
    assert token_counts.Safe(MODEL).lengths(strings) == token_counts.Pieces(MODEL).lengths(strings)


def test_slices_have_equal_bytes():
    texts = pa.array(["x" * 40, None, "", "é" * 30, "y" * 500, "z"])
    assert [s.to_pylist() for s in token_counts.slices(texts, 100)] == [["x" * 40, None, "", "é" * 30], ["y" * 500], ["z"]]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = [*texts, (1, None), (1, None), (None, "a <|endoftext|> b <s>"), (-2, ""), (-3, "long words " * 400_000)]
    df = spark.createDataFrame([(d, t, -1, "x") for d, t in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted(map(tuple, token_counts.count_tokens(df, path).collect()), key=str)
    whole = (token_counts.Whole if name.endswith("json") else token_counts.Pieces)(path).lengths([t or "" for _, t in rows])
    assert got == sorted(((d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(rows, whole, strict=True)), key=str)


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    marks = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in marks[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cents = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(own, cents, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    per = Counter()
    for _, c, d in found:
        per[c] += d
    return sorted(((i, c, d, per[c], sum(per.values()), cents[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize(("n", "lead", "spread"), [(300, 16, 1.0), (300, 2, 30.0), (5, 64, 1.0), (200, 4, 0.002)])
def test_centroids_equal_brute_force(spark, n, lead, spread):
    rng = np.random.default_rng(n + lead)
    x = (rng.normal(0, 0.1, (n, 64)) + rng.integers(-2, 3, (n, 1)) * spread * rng.normal(0, 1, (1, 64))).astype(np.float32)
    rows = [(k // 2 if k < 20 else k, v.tolist()) for k, v in enumerate(x)] + [(None, x[0].tolist()), (7, x[1].tolist())]
    odd = [(1, None), (2, [1.0] * 63), (3, [None] + [1.0] * 63), (4, [float("nan")] * 64), (5, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, 3) for r in rows + odd], "vec_id long, embedding array<float>, cluster int")
    got = centroids.cluster(df, lead=lead).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows, 8, 10)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(1)
    groups = rng.normal(0, 1, (8, 64))
    rows = [(k, (groups[k % 8] + rng.normal(0, 0.02, 64)).tolist()) for k in range(800)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).agg({"measured": "avg"}).first()[0]
    assert got < 2.5


def test_centroids_too_large(spark):
    df = spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond|OVERFLOW"):
        centroids.cluster(df).collect()


def brute_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", divergence.words((text or "").encode())) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df, n_lang, by = Counter(), Counter(), {}
        for _, source, terms in own:
            df.update(set(terms))
            n_lang.update(terms)
            by.setdefault(source, Counter()).update(terms)
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        share = lambda n: {t: 1 + (10**9 * (n[t] + 5)) // (sum(n[u] for u in kept) + 5 * v) for t in kept}
        q, p = share(n_lang), {s: share(n) for s, n in by.items()}
        for s in by:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in by if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1])), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item.decode(), value, rank))
    return sorted(out)


@pytest.mark.parametrize(("block", "entries", "held"), [(128, 1 << 16, 400_000), (2, 5, 40), (3, 1, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, entries, held):
    for name, value in (("BLOCK", block), ("ENTRIES", entries), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(5)
    vocabulary = ["the", "The", "été", "ÉTÉ", "日本", "a1b", "x-y", "\xa0nb", "mid", "rare"]
    rows = [(rnd.choice(["en", "fr", None]), f"s{min(int(rnd.expovariate(0.4)), 8)}", " ".join(rnd.choices(vocabulary, weights=range(10, 0, -1), k=rnd.randint(0, 9)))) for _ in range(150)]
    rows += [("en", None, None), ("en", "silent", "12 34"), ("one", "alone", "the the"), ("bare", "p", "q"), ("bare", "r", ""), (None, "s0", "the " * 50_000)] * 1
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, g int, term string")
    got = divergence.audit(df, min_docs=6, top=3)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 6, 3)
