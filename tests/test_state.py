"""Streams whose rows come out of order: equal to the batch form, state that ends, restarts between write and commit."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import audio, ledger
from crestline.streaming import live, ordered


def plain_bursts(counts):
    out = []
    for k, n in enumerate(counts):
        base = np.array(counts[max(0, k - 60) : k][:-1], dtype=float)
        if len(base) >= 4:
            center = np.median(base)
            out.append(float(np.clip((n - center) / max(1.0, 1.4826 * np.median(np.abs(base - center))), -3, 8)))
    return out


def state_rows(spark, path, name):
    return spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", name).load().count()


def test_bursts_out_of_order_and_state_that_ends(spark, tmp_path):
    rnd = random.Random(1)
    counts = {b: [rnd.randint(0, 9) + 40 * (rnd.random() < 0.05) for _ in range(90)] for b in (1, 2)}
    rows = [(b, k, n, 1_700_000_000 + 5 * k) for b, own in counts.items() for k, n in enumerate(own)]
    df = spark.createDataFrame(rows, "broadcast_id long, bucket int, n long, s long").select("broadcast_id", "bucket", "n", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "t")
    live.run_as_it_comes(df, lambda s: ordered.bursts(s, "2 minutes", keep_ms=3_600_000), path, groups=3, disorder_s=110, rocksdb=True)
    got = spark.read.parquet(f"{path}/batches").collect()
    for b, own in counts.items():
        assert [r["score"] for r in sorted((r for r in got if r["broadcast_id"] == b), key=lambda r: r["bucket"])] == pytest.approx(plain_bursts(own))
    assert len({r["epoch"] for r in got}) > 2  # they came in several micro-batches, and did not wait for the end
    # the row that moved the watermark on waits; nothing else is left
    assert state_rows(spark, path, "waiting") == 1 and state_rows(spark, path, "known") == 0


def test_edits_out_of_order_equal_the_fold(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, 100 * i + k, rnd.choice((k // 3, rnd.randint(0, 4))), 1000 * k, 1000 * k + 45_000, 1_700_000_000 + 7 * k) for i in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "item long, seq long, expected_revision long, start_ms long, end_ms long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = str(tmp_path / "t")
    live.run_as_it_comes(df, lambda s: ordered.apply_edits(s, "2 minutes", keep_ms=10**12), path, groups=3, disorder_s=110, rocksdb=True)
    got = spark.read.parquet(f"{path}/batches")
    assert got.count() == got.select("item", "seq").distinct().count() == len(rows)
    last = got.groupBy("item").agg(F.max_by(F.struct("revision", "refused", "start_ms", "end_ms"), "seq").alias("s")).select("item", "s.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, ledger.replay_edits(df).select("item", "revision", "refused", "start_ms", "end_ms").collect()))
    verdicts = {(r["item"], r["seq"]): r["status"] for r in got.collect()}
    revision = {}
    for item, seq, expected, *_ in rows:
        own = revision.get(item, 0)
        assert verdicts[item, seq] == ("applied" if expected == own else "stale-revision" if expected < own else "future-revision")
        revision[item] = own + (expected == own)
    assert {*verdicts.values()} == {"applied", "stale-revision", "future-revision"}


def test_sound_out_of_order_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(b, i, rng.normal(0, 0.2, (2, 800)).clip(-1, 1).tolist(), 1_700_000_000 + i) for b in (1, 2) for i in range(24) if (b, i // 4) != (2, 1)]
    df = spark.createDataFrame(rows, "broadcast_id long, i int, channels array<array<double>>, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = str(tmp_path / "t")
    live.run_as_it_comes(df, lambda s: ordered.sound_windows(s, 800, "20 seconds", 60_000), path, groups=3, disorder_s=15, rocksdb=True)
    got = {(r["broadcast_id"], r["i"]): r for r in spark.read.parquet(f"{path}/batches").collect()}
    batch = audio.windows_from_samples(df.drop("ts"), 800).collect()
    assert len(got) == len(batch) == len(rows)
    for r in batch:
        assert [got[r["broadcast_id"], r["i"]][c] for c in ("rms", "peak", "zcr", "speech")] == pytest.approx([r[c] for c in ("rms", "peak", "zcr", "speech")], abs=2e-6)


def test_stop_between_write_and_commit(spark, tmp_path):
    """A query that dies after it wrote a batch, before the batch is committed, gives each unit once after its restart."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema("unit long").option("maxFilesPerTrigger", 1).parquet(source)
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "unit").coalesce(1).write.mode("append").parquet(source)
    seen = []

    def stop(number):
        seen.append(number)
        if number == 1 and seen.count(1) == 1:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        live.run_to_table(stream(), path, "append", written=stop)
    assert spark.read.parquet(f"{path}/batches").count() == 20  # written, not committed
    spark.range(30, 40).withColumnRenamed("id", "unit").coalesce(1).write.mode("append").parquet(source)
    live.run_to_table(stream(), path, "append", written=stop)
    assert seen[:3] == [0, 1, 1]
    assert sorted(r["unit"] for r in spark.read.parquet(f"{path}/batches").collect()) == list(range(40))


def test_sessions_are_written_once_when_they_end(spark, tmp_path):
    rows = [(b, 1_700_000_000 + b + 10 * k + 600 * (k // 5)) for b in (1, 2) for k in range(20)]
    df = spark.createDataFrame(rows, "broadcast_id long, s long").select("broadcast_id", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "t")
    live.run_as_it_comes(df, lambda s: live.sessions(s, "60 seconds", "5 minutes"), path, groups=3, disorder_s=100)
    got = spark.read.parquet(f"{path}/batches")
    assert sorted((r["broadcast_id"], r["n"]) for r in got.collect()) == [(b, 5) for b in (1, 2) for _ in range(4)]


def test_many_items_share_few_state_keys(spark, tmp_path, monkeypatch):
    """A timer and some calls for each item took hours; items without a key or a revision leave the others as they are."""
    monkeypatch.setattr(ordered, "SHARDS", 4)
    big = 2**60 + 1
    rows = [(None if i == 7 else big + i, k, None if k == 2 else k, big, big + 1, 1_700_000_000 + 7 * k) for i in range(60) for k in range(4)]
    df = spark.createDataFrame(rows, "item long, seq long, expected_revision long, start_ms long, end_ms long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = str(tmp_path / "t")
    live.run_as_it_comes(df, lambda s: ordered.apply_edits(s, "2 minutes", keep_ms=10**15), path, groups=2, disorder_s=20, rocksdb=True)
    got = spark.read.parquet(f"{path}/batches")
    wanted = [(i, k, s, r) for i in {r[0] for r in rows} for k, s, r in ((0, "applied", 1), (1, "applied", 2), (2, "stale-revision", 2), (3, "future-revision", 2))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.select("item", "seq", "status", "revision").collect()), key=key) == sorted(wanted, key=key)
    assert {r["start_ms"] for r in got.collect()} == {big}
    state = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "timer").load()
    assert 0 < state.count() <= 4
