"""Token ids in binary blocks, coded by a static range asymmetric numeral system (rANS).

Documents are encoded by a public tokenizer and written in ascending doc_id order. One frequency table, counted over
the whole corpus, codes every block. A block holds whole documents and stands alone: LANES interleaved states, states
and stream place checkpointed every CHECKPOINT steps so that parts decode on their own, and a checksum of its ids.

Layout of the store (folders of Parquet files, so any store that Spark writes to will do):
- ``table``: symbol, freq; the frequencies sum to 2**PROB_BITS.
- ``blocks``: shard, block, n_tokens, n_docs, payload. The payload is little-endian: magic ``RNS1``, u32 lanes, u32
  checkpoint steps, u32 documents, u64 ids, u64 words, u32 crc32 of the ids, u32 crc32 of the table, then i64 doc_id
  and u8 null flag and u64 length of each document, per checkpoint u64 words before it and u64 states, and u32 words.

Defined results: a null or empty text is the end id alone; rows that repeat are written each, those of one doc_id by the
hash of their text; a null doc_id sorts first; a text of any length is one document and lies in one block; an empty table
gives a store without blocks; other columns are not read.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir

PROB_BITS, LANES, CHECKPOINT = 20, 4096, 64
#: Ids of a block at least (whole documents) and bytes of ids of a shard.
BLOCK, SHARD_BYTES = 1 << 19, 24 << 20
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIQQII")


def frequencies(counts: np.ndarray, bits: int = PROB_BITS) -> np.ndarray:
    """Counts scaled to sum 2**bits; every counted symbol keeps one at least."""
    total = 1 << bits
    freq = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if not len(used):
        return freq
    if len(used) > total:
        raise ValueError("more symbols than slots")
    share = counts[used].astype(float) * (total - len(used)) / counts[used].sum()
    freq[used] = 1 + np.floor(share).astype(np.int64)
    short = total - int(freq.sum())
    order = np.lexsort((used, -(share - np.floor(share))))
    freq[used[order[:short]]] += 1
    return freq


class Codec:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = PROB_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << bits) - 1)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Checkpoints (words before, states) for every ``every`` steps from the first, and the words."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words, points = [], []
        room = np.uint64(63) - self.bits
        for step in range(steps - 1, -1, -1):
            own = ids[step * lanes : (step + 1) * lanes]
            x, f = state[: len(own)], self.freq[own]
            full = (x >> room) >= f
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
            high = x // f
            state[: len(own)] = (high << self.bits) + (x - high * f) + self.start[own]
            if step % every == 0:
                points.append((step, state.copy()))
        words.reverse()
        before = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        return [(int(before[step]), s) for step, s in reversed(points)], np.concatenate(words) if words else np.zeros(0, dtype=np.uint32)

    def decode(self, points: list[tuple[int, np.ndarray]], words: np.ndarray, n: int, lanes: int, every: int, part: int | None = None) -> np.ndarray:
        """All ids, or those of one checkpoint's part."""
        parts = range(len(points)) if part is None else [part]
        out = []
        for k in parts:
            at, state = points[k][0], points[k][1].copy()
            for step in range(k * every, min((k + 1) * every, -(-n // lanes))):
                x = state[: min(lanes, n - step * lanes)]
                slot = x & self.mask
                symbol = self.symbol[slot]
                x = self.freq[symbol] * (x >> self.bits) + slot - self.start[symbol]
                low = np.flatnonzero(x < LOW)
                x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
                at += len(low)
                state[: len(x)] = x
                out.append(symbol)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def pack(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
        points, words = self.encode(ids)
        head = _HEAD.pack(b"RNS1", LANES, CHECKPOINT, len(doc_ids), len(ids), len(words), zlib.crc32(ids.astype("<u4").tobytes()), self.crc)
        known = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
        marks = b"".join(struct.pack("<Q", w) + s.astype("<u8").tobytes() for w, s in points)
        return head + known + lengths.astype("<u8").tobytes() + marks + words.astype("<u4").tobytes()

    def unpack(self, payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """doc_ids, lengths and ids of a block; a checksum that differs is an error."""
        magic, lanes, every, docs, n, n_words, crc, table_crc = _HEAD.unpack_from(payload)
        if magic != b"RNS1" or table_crc != self.crc:
            raise ValueError("not a block of this table")
        at = _HEAD.size
        doc_ids = np.frombuffer(payload, "<i8", docs, at)
        null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
        lengths = np.frombuffer(payload, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        points = []
        for _ in range(-(-(-(-n // lanes)) // every)):
            points.append((struct.unpack_from("<Q", payload, at)[0], np.frombuffer(payload, "<u8", lanes, at + 8)))
            at += 8 + 8 * lanes
        ids = self.decode(points, np.frombuffer(payload, "<u4", n_words, at), n, lanes, every)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block differs")
        return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths, ids


#: Python takes these for white space, tokenizers (Unicode White_Space) do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(rf"(?:\S|[{SEPARATORS}])+")


_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def split_words(text: str) -> list[str]:
    """The stretches between the tokenizer's white space."""
    return _WORD.findall(text) if any(c in text for c in SEPARATORS) else text.split()


class WordCache:
    """Ids of a text by way of its white-space words, each encoded once by the library.

    Exact for tokenizers whose pieces never span white space, that split letters from punctuation and mark the end of
    each piece, as the word tokenizer does; words are remembered up to a bound, then forgotten together. Only words of
    ASCII and Latin-1 letters, which are composed and have one lower-case letter each, are put in lower case here; all
    others, which normalizing may compose, take apart or reorder, are given to the library one by one as they are.
    """

    MARKS = ".,!#$%&*|;:?"

    def __init__(self, path: str, bound: int = 700_000, portion: int = 500):
        os.environ["RAYON_NUM_THREADS"] = "1"  # a task has one core; more threads only take memory
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.bound, self.portion = Tokenizer.from_file(path), bound, portion
        # the same model without normalizing and splitting, for words that are one piece and normal already
        self.bare = Tokenizer(self.library.model)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bare_ascii = Tokenizer(self.library.model)  # ASCII letters stand for themselves as bytes
        self.bare_ascii.normalizer, self.bare_ascii.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {}

    def _learn(self, fresh: set[str], kind: str) -> None:
        """Encode new words. Those of plain letters are one piece each: encoded many to a text and told apart by their
        last ids; plain letters with marks behind are put together from both; the rest is encoded as it is."""
        known, latin, marks = self.ids, _LATIN.fullmatch, self.MARKS
        ascii_, other, joined, alone = [], [], [], []
        for w in fresh:
            if w.isalpha():
                (ascii_ if w.isascii() else other if latin(w) else alone).append(w)
            else:
                s = w.rstrip(marks)
                if len(s) < len(w) and s.isalpha() and (s.isascii() or latin(s)):
                    joined.append((w, s))
                else:
                    alone.append(w)
        for s in {s for _, s in joined}.difference(fresh).difference(known):
            (ascii_ if s.isascii() else other).append(s)
        alone += {w[len(s) :] for w, s in joined}.difference(alone).difference(known)
        for bare, words in ((self.bare_ascii, ascii_), (self.bare, other)):
            groups = [words[k : k + self.portion] for k in range(0, len(words), self.portion)]
            done = bare.encode_batch_fast([" ".join(g).lower() for g in groups], add_special_tokens=False)
            for found, group in zip(done, groups, strict=True):
                ids = np.array(found.ids, dtype=kind)
                stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
                if len(stops) != len(group):
                    alone += group
                    continue
                raw, stops = ids.tobytes(), stops.tolist()
                known.update(zip(group, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        for word, found in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            known[word] = np.array(found.ids, dtype=kind).tobytes()
        known.update({w: known[s] + known[w[len(s) :]] for w, s in joined})

    def encode(self, texts: list[str], end: int, kind: str) -> list[bytes]:
        if len(self.ids) > self.bound:
            self.ids = {}
        gc.disable()  # the many small lists below hold no cycles
        try:
            words = [split_words(t) for t in texts]
            self._learn(set().union(*words).difference(self.ids), kind)
            last, ids = np.array([end], dtype=kind).tobytes(), self.ids.__getitem__
            return [b"".join(map(ids, w)) + last for w in words]
        finally:
            gc.enable()


_TOKENIZERS: dict = {}


def tokenizer(path: str) -> WordCache:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCache(path)
    return _TOKENIZERS[path]


def token_ids(docs: DataFrame, path: str, end: int, vocabulary: int, kind: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (orders equal ids) and the ids of each document as little-endian integers. The last row of a
    partition has no ids but the counts of all its ids, as little-endian 64-bit integers, in place of them."""
    names = ["doc_id", "row_key", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, dtype="<i8")
        for batch in batches:
            for at in range(0, len(batch), 400):
                part = batch.slice(at, 400)
                ids = tokenizer(path).encode([t or "" for t in part.column(2).to_pylist()], end, kind)
                counts += np.bincount(np.frombuffer(b"".join(ids), dtype=kind), minlength=vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, row_key long, ids binary, counts binary")


def id_counts(plain: DataFrame, vocabulary: int) -> np.ndarray:
    """Count of each id over the whole corpus, from those of the partitions; at most vocabulary rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                counts += np.frombuffer(own, dtype="<i8")
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["symbol", "n"])

    counts = np.zeros(vocabulary, dtype=np.int64)
    found = plain.where("counts is not null").select("counts").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    for row in found.collect():
        counts[row["symbol"]] = row["n"]
    return counts


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write the store at path."""
    spark, kind = docs.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"
    plain = f"{path}/plain"
    token_ids(docs, tokenizer_path, end, vocabulary, kind, id_col, text_col).write.option("compression", "zstd").parquet(plain)
    rows = spark.read.schema("doc_id long, row_key long, ids binary, counts binary").parquet(plain)
    counts, ids = id_counts(rows, vocabulary), rows.where("counts is null").select("doc_id", "row_key", "ids")
    freq, width = frequencies(counts), np.dtype(kind).itemsize
    spark.createDataFrame([(int(s), int(freq[s])) for s in np.flatnonzero(freq)], "symbol int, freq long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard, number = Codec(freq), TaskContext.get().partitionId(), 0
        held, total = [], 0

        def block() -> pa.RecordBatch:
            own = np.concatenate([np.frombuffer(i, dtype=kind) for _, i in held])
            payload = codec.pack([d for d, _ in held], np.array([len(i) // width for _, i in held]), own)
            cols = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "block", "n_tokens", "n_docs", "payload"])

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, own))
                total += len(own) // width
                if total >= BLOCK:
                    yield block()
                    held, total, number = [], 0, number + 1
        if held:
            yield block()

    shards = max(1, -(-int(counts.sum()) * width // SHARD_BYTES))
    ordered = ids.repartitionByRange(shards, "doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    ordered.select("doc_id", "ids").mapInArrow(run, "shard int, block int, n_tokens long, n_docs long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, start, ids (little-endian u32) of every document of the store, from its files."""
    blocks = spark.read.schema("shard int, block int, n_tokens long, n_docs long, payload binary").parquet(f"{path}/blocks")
    freq = np.zeros(vocabulary, dtype=np.int64)
    for row in spark.read.schema("symbol int, freq long").parquet(f"{path}/table").collect():
        freq[row["symbol"]] = row["freq"]
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = blocks.select("shard", "block", (F.sum("n_tokens").over(W.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("in_shard"))
    places = within.join(shards, "shard").select("shard", "block", (F.col("in_shard") + F.col("shard_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(freq)
            for payload, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = codec.unpack(payload)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.join(places, ["shard", "block"]).select("payload", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/tokens-{uuid.uuid4().hex}"
