"""Captions and feeds by format name: equal to the column functions, by partitions, and as streams that go on."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from crestline.sources import documents, formats
from crestline.streaming import live

ODD = ["", "no json", "[]", '{"events": 3}', '{"events": [1, {"tStartMs": 5}]}']


def track(k):
    text = lambda n: f"Ｃue {k} {n}\x01 more​ "
    cues = [{"tStartMs": 100 * n, "dDurationMs": 90, "segs": [{"utf8": text(n)}, {"utf8": "x\n" * n}]} for n in range(4)]
    cues += [cues[-1], {"tStartMs": -1, "dDurationMs": 1, "segs": [{"utf8": "a"}]}, {"tStartMs": 900, "segs": [{}, {"utf8": "tail"}]}, {"tStartMs": 950, "dDurationMs": 1, "segs": [{"utf8": " \n"}]}]
    return json.dumps({"events": cues})


def feed(k):
    entries = "".join(f"<entry>\n<yt:videoId>v{k}-{n}</yt:videoId><yt:channelId> c{k} </yt:channelId><title>T {n}</title><published>2024-03-0{n + 1}T10:00:00+09:00</published><updated>{'soon' if n else '2024-05-01T00:00:00Z'}</updated></entry>" for n in range(3))
    return ("<!doctype x>" if k % 5 == 4 else "") + f"<feed>{entries}</feed>"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("formats")
    (path / "captions").mkdir()
    (path / "feeds").mkdir()
    for k in range(12):
        (path / "captions" / f"{k:02}.json3").write_text(track(k))
        (path / "feeds" / f"{k:02}.xml").write_text(feed(k))
    for k, text in enumerate(ODD):
        (path / "captions" / f"odd{k}.json").write_text(text)
    (path / "feeds" / "large.xml").write_text(feed(1) + " " * 2_000_001)
    formats.register(spark)
    return path


def test_captions_equal_the_column_functions(spark, folders):
    folder = str(folders / "captions")
    got = spark.read.format("caption_json3").option("per_partition", 3).load(folder)
    assert got.rdd.getNumPartitions() == 6
    want = documents.read_captions_json3(spark, folder).withColumn("file", F.regexp_replace("broadcast_id", "^file:/*", "/"))
    columns = ["file", "cue", "start_ms", "duration_ms", "text"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.count() == 12 * 5 and got.where("text = 'Cue 3 0 more'").count() == 1


def test_feeds_equal_the_column_functions(spark, folders):
    folder = str(folders / "feeds")
    got = spark.read.format("channel_feed").load(folder).drop("file")
    want = documents.read_atom_feed(spark, folder)
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() == 30


def test_empty_folder_and_missing_path(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("caption_json3").load(str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="folder must be named"):
        spark.read.format("caption_json3").load().collect()


def test_restarted_stream_reads_no_file_twice(spark, tmp_path):
    formats.register(spark)
    folder, path = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    read = lambda: spark.readStream.format("caption_json3").load(str(folder)).where("cue = 1")

    def run():
        query = read().writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batches/epoch={n}")).option("checkpointLocation", f"{path}/state").start()
        query.processAllAvailable()
        query.stop()

    for part in range(3):
        for k in range(4):
            (folder / f"{part}-{k}.json3").write_text(track(k))
        time.sleep(0.05)
        run()
    run()
    files = [r["file"].split("/")[-1] for r in spark.read.parquet(f"{path}/batches").collect()]
    assert sorted(files) == sorted(f"{part}-{k}.json3" for part in range(3) for k in range(4))
    assert len({r["epoch"] for r in live.latest(spark, path, ["file"]).withColumn("epoch", F.lit(0)).collect()}) == 1
