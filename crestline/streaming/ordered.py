"""State that takes rows in the order of their event time, whatever micro-batch they come in.

Rows wait in state until the watermark has passed them; an event-time timer then hands all that have become due on in
order, and what a key needs to remember is a few values. What a key remembers ends ``keep_ms`` of event time after its last
row, by the same timers; a row that comes later than that begins anew. What comes later than the watermark is dropped by Spark
before it gets here: no row can be overtaken by one that was handed on.

Keys are filed by their hash under SHARDS state keys, each with one timer. A call to the state store, a timer and the frames
that Spark hands over cost some milliseconds for each state key and micro-batch, whatever few rows it has.

Queries with these processors need the RocksDB state store, which ``live.run_to_table`` turns on for them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import audio

#: Buckets of a burst's baseline, and how many it needs at least.
BASELINE, LEAST_BASELINE = 60, 4
#: Bytes in one piece of state: longer messages to the state store break off.
PIECE = 4096
#: State keys that the keys of a stream are filed under.
SHARDS = 1024


class InOrder(StatefulProcessor):
    """Base: ``place`` names the long column that orders rows of one time, ``inputs`` the others; ``pack`` makes of them the
    values that wait, one list for each row. ``fresh`` is what a key remembers at first; ``step`` takes memory, place and values
    of a row and gives memory and rows of output."""

    place, inputs, columns = "", [], []

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first boolean, raw binary")
        self.known = handle.getListState("known", "first boolean, raw binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                first = min(int(part["at"].min()), int(part["at"].max()) if first is None else first)
                keys, at, place = part["name"].tolist(), part["at"].tolist(), part[self.place].tolist()
                _append(self.waiting, list(zip(keys, at, place, self.pack(*(part[c] for c in self.inputs)), strict=True)))
        if first is not None:
            self._wake(first)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        # of rows that repeat a key, time and place the last to come counts
        entries = {r[:3]: r[3] for part in _parts(self.waiting) for r in part}
        due = sorted((r for r in entries if r[1] <= now), key=lambda r: r[1:])
        known = {k: v for part in _parts(self.known) for k, v in part.items()}
        out = []
        for r in due:
            name, at, place = r
            last, memory = known.get(name) or (at, self.fresh())
            if at > last + self.keep_ms:
                memory = self.fresh()
            memory, found = self.step(memory, int(place), entries.pop(r))
            known[name] = at, memory
            out += [(name, *f) for f in found]
        kept = {k: v for k, v in known.items() if v[0] + self.keep_ms >= now}
        if due:
            self.waiting.clear()
            if entries:
                _append(self.waiting, [(*r, values) for r, values in entries.items()])
        if due or len(kept) < len(known):
            self.known.clear()
            if kept:
                _append(self.known, kept)
        self.timer.clear()
        if entries or kept:
            self._wake(min([r[1] for r in entries] + [last + self.keep_ms + 1 for last, _ in kept.values()]))
        yield pd.DataFrame(out, columns=self.columns)

    def _wake(self, at: int) -> None:
        """One timer for the state key: the earliest."""
        (before,) = self.timer.get() or (None,)
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def pack(self, *columns: pd.Series) -> list[tuple]:
        return [tuple(map(_plain, r)) for r in zip(*(c.tolist() for c in columns), strict=True)]

    def fresh(self) -> list:
        raise NotImplementedError

    def step(self, memory: list, place: int, values: tuple) -> tuple[list, list[tuple]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _append(state, what) -> None:
    raw = pickle.dumps(what, protocol=5)
    for at in range(0, len(raw), PIECE):
        state.appendValue((at == 0, raw[at : at + PIECE]))


def _parts(state) -> Iterator:
    """What was appended, in that order."""
    held: list[bytes] = []
    for first, raw in state.get():
        if first and held:
            yield pickle.loads(b"".join(held))
            held = []
        held.append(bytes(raw))
    if held:
        yield pickle.loads(b"".join(held))


def _plain(v):
    return None if v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v) else v


class Bursts(InOrder):
    """Burst score of each bucket against the 60 before it, the last one left out."""

    place, inputs = "bucket", ["n"]
    columns = ["name", "bucket", "n", "score"]

    def fresh(self):
        return [[]]

    def step(self, memory, place, values):
        (n,) = values
        ring = list(memory[0])
        base, found = np.array(ring[:-1][-(BASELINE - 1) :], dtype=float), []
        if len(base) >= LEAST_BASELINE:
            center = np.median(base)
            found = [(place, int(n), float(np.clip((n - center) / max(1.0, 1.4826 * np.median(np.abs(base - center))), -3, 8)))]
        return [[*ring, int(n)][-BASELINE:]], found


class SoundWindows(InOrder):
    """Feature windows of decoded seconds; the memory is the filter's three values and the last second."""

    place, inputs = "i", ["n_channels", "flat"]
    columns = ["name", "i", "rms", "peak", "zcr", "speech"]

    def __init__(self, keep_ms: int, rate: int):
        super().__init__(keep_ms)
        self.rate = rate

    def pack(self, n_channels, flat):
        return [(int(n), np.asarray(x, dtype="<f8").tobytes()) for n, x in zip(n_channels, flat, strict=True)]

    def fresh(self):
        return [0.0, 0.0, 0.0, -2]

    def step(self, memory, place, values):
        n_channels, raw = values
        samples = np.frombuffer(raw, dtype="<f8").reshape(n_channels, -1)
        before, passed, band, second = memory
        if place != second + 1:
            before = passed = band = 0.0
        window, (before, passed, band) = audio.one_window(samples, self.rate, before, passed, band)
        return [float(before), float(passed), float(band), place], [(place, *(float(np.floor(v * 1e6 + 0.5) / 1e6) for v in window))]


class Edits(InOrder):
    """Edit commands of an item, each checked against the revision that it expects; every command gets its verdict."""

    place, inputs = "seq", ["expected_revision", "start_ms", "end_ms"]
    columns = ["name", "seq", "status", "revision", "refused", "start_ms", "end_ms"]

    def fresh(self):
        return [0, 0, None, None]

    def step(self, memory, place, values):
        expected, start_ms, end_ms = values
        revision, refused, *span = memory
        if expected == revision:
            memory = [revision + 1, refused, start_ms, end_ms]
            return memory, [(place, "applied", *memory)]
        status = "stale-revision" if expected is None or expected < revision else "future-revision"
        memory = [revision, refused + 1, *span]
        return memory, [(place, status, *memory)]


def _run(rows: DataFrame, key: str, late: str, processor: InOrder, schema: str) -> DataFrame:
    # as text, a key that is missing does not turn those beside it into floating numbers
    shard, text = F.pmod(F.xxhash64(key), F.lit(SHARDS)).alias("shard"), F.col(key).cast("string").alias("name")
    timed = rows.withWatermark("ts", late).select(shard, text, "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), processor.place, *processor.inputs)
    found = timed.groupBy("shard").transformWithStateInPandas(processor, f"name string, {schema}", "append", "eventTime")
    return found.withColumn("name", F.col("name").cast(rows.schema[key].dataType)).withColumnRenamed("name", key)


def bursts(buckets: DataFrame, late: str = "1 minute", keep_ms: int = 6 * 3_600_000) -> DataFrame:
    """Scores of buckets(broadcast_id, bucket, n, ts), in order of ts, then bucket."""
    return _run(buckets, "broadcast_id", late, Bursts(keep_ms), "bucket int, n long, score double")


def sound_windows(chunks: DataFrame, rate: int, late: str = "1 minute", keep_ms: int = 6 * 3_600_000) -> DataFrame:
    """Windows of chunks(broadcast_id, i, channels, ts), one for each second."""
    # lists of lists do not come through Arrow here: the channels go one behind the other
    flat = chunks.select("broadcast_id", "i", "ts", F.size("channels").alias("n_channels"), F.flatten("channels").cast("array<double>").alias("flat"))
    return _run(flat, "broadcast_id", late, SoundWindows(keep_ms, rate), "i int, rms double, peak double, zcr double, speech double")


def apply_edits(commands: DataFrame, late: str = "1 minute", keep_ms: int = 6 * 3_600_000) -> DataFrame:
    """Verdicts of commands(item, seq, expected_revision, start_ms, end_ms, ts): a row for each command with its status and
    the item's state after it. ``keep_ms`` must exceed the life of an item: after it a new command finds revision 0."""
    return _run(commands, "item", late, Edits(keep_ms), "seq long, status string, revision long, refused long, start_ms long, end_ms long")
