"""Exact substring de-duplication with suffix arrays.

Every byte covered by a LENGTH-byte string that also starts anywhere else in the corpus is removed.

1. Windows are filed by content. In every LENGTH-byte window the 64-byte gram with the least hash is the window's
   anchor, so two equal windows have equal anchors at equal offsets. The window starts of a document that share an
   anchor are a run, its bytes the run's context: about one run for 170 bytes, counted by anchor hash and context digest.
2. Anchors seen once drop out. A context seen twice is repeated as a whole. Anchors with several distinct contexts are
   dealt out to shards, one copy of each context. An anchor with more than GROUP contexts is first split by content: its
   windows fall in classes by the bytes before the anchor, STEP to a class, and two equal windows share the bytes that
   all windows of their class share. These cores are counted, at most 15 a context; one that stands alone has no repeat,
   and the contexts of each other core go on as a group of their own, with the windows of its class only. A group that
   still has more than GROUP contexts is dealt out over several shards.
   Within a whole group the same is done in place, with coarser classes.
3. A shard sorts its suffixes by Larsson-Sadakane refinement in numpy and takes common prefixes by
   Kasai's rule, in lanes. Neighbours that share LENGTH bytes are repeats.
4. The windows of split groups, at most STEP a context and class, are merged across shards by binary search in sorted
   digests, dealt out by digest.
5. The found ranges of window starts go back to every copy of a context and are joined to the documents.

No step gathers an anchor, a context or a group of copies: they are counted, split or joined.

Beside this, documents that share a passage of PASSAGE words or more with another one are marked: the gram with the
least hash of each window of words is its mark, and marks that two documents have are counted by an aggregate.

Defined results: a null text has no bytes; a text under LENGTH bytes keeps all of them; a text of any length is read
whole, in parts that share what a window needs; rows that repeat, also under one doc_id, count as separate documents,
so that their long strings repeat, but share no passage with themselves; a null doc_id is carried along; of equal
windows none is the first, all go; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_as_bytes

LENGTH, GRAM = 400, 64
#: Words of a passage that is reported where another document has it too, and of the grams that it is found by.
PASSAGE, PASSAGE_GRAM = 51, 30
#: Bytes hashed at once, contexts of a group in one shard at most, bytes of a shard, and window starts of a class.
PIECE, GROUP, SHARD, STEP = 1 << 20, 512, 1 << 19, 24
#: Window starts of a class where a whole group is at hand.
COARSE = 84

_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.random.default_rng(12).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    h, width = _BYTE[raw], 1
    for odd in _ODD[: GRAM.bit_length() - 1]:
        h = h[:-width] * odd + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * _ODD[7]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i, by prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(h: np.ndarray, gram: int, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts in texts laid end to end, from the hashes of their grams: (text number, anchor, first start,
    last start), anchor hashes."""
    chosen = sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(0, ends - begins - length + 1)
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    owner, anchor = np.repeat(np.arange(len(ends)), counts), (chosen[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])) if len(starts) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([first[1:], [len(starts)]])[: len(first)] - 1
    return owner[first], anchor[first], starts[first], starts[last], h[anchor[first]]


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in portions of about PIECE bytes; longer texts in parts that share no window: numbers, offsets, parts."""
    numbers, offsets, parts, total = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            if total and total + len(part) > 2 * PIECE:
                yield numbers, offsets, parts
                numbers, offsets, parts, total = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            total += len(part)
    if parts:
        yield numbers, offsets, parts


RUNS = "doc_id long, row_key long, anchor long, ctx_a long, ctx_b long, start long, size int, place int"


def window_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs of all documents: where the windows start, the anchor's place behind the first, its hash and the context's
    digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for numbers, offsets, parts in pieces(texts_as_bytes(batch, "text"), length):
                joined = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                owner, anchor, first, last, hashes = runs_of(gram_hashes(np.frombuffer(joined, dtype=np.uint8)), GRAM, ends, length)
                begins = ends - [len(p) for p in parts]
                digests = b"".join(xxhash.xxh3_128_digest(joined[a : b + length], c - a) for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True))
                pair = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                of = [numbers[k] for k in owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in of], pa.int64()), pa.array([keys[k] for k in of], pa.int64()), pa.array(hashes.view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                        pa.array(first - begins[owner] + np.array(offsets, dtype=np.int64)[owner]), pa.array((last - first + 1).astype(np.int32)), pa.array((anchor - first).astype(np.int32)),
                    ],
                    names=["doc_id", "row_key", "anchor", "ctx_a", "ctx_b", "start", "size", "place"],
                )

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, RUNS)


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys in order; where there is room, numbers that hold their place are sorted, which is faster."""
    low = max(1, len(key) - 1).bit_length()
    if bits + low > 64:
        return np.argsort(key, kind="stable")
    return (np.sort(key << np.uint64(low) | np.arange(len(key), dtype=np.uint64)) & np.uint64((1 << low) - 1)).astype(np.int64)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement: each round sorts only the groups that are not yet single, by
    the rank of the suffix that starts where the known prefix ends. Kasai's rule needs the full order."""
    n, known = len(text), 5
    padded = np.concatenate([text, np.zeros(known, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(known):  # five bytes, and below them how many of these the text still has
        key = (key << np.uint64(8)) | padded[k : k + n]
    key = (key << np.uint64(3)) | np.minimum(known, n - np.arange(n)).astype(np.uint64)
    order = _order(key, 8 * known + 3)
    fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    heads = np.flatnonzero(fresh)
    rank = np.empty(n + 1, dtype=np.int64)  # one above the slot of the group's head; that of the empty suffix is 0
    rank[order] = np.repeat(heads + 1, np.diff(np.concatenate([heads, [n]])))
    rank[n] = 0
    wide = n.bit_length()
    open_slots = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    while len(open_slots):
        suffix = order[open_slots]
        key = rank[suffix].astype(np.uint64) << np.uint64(wide) | rank[np.minimum(suffix + known, n)].astype(np.uint64)
        again = _order(key, 2 * wide)
        order[open_slots] = suffix = suffix[again]
        key = key[again]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(fresh)
        rank[suffix] = np.repeat(open_slots[heads] + 1, np.diff(np.concatenate([heads, [len(suffix)]])))
        open_slots = open_slots[~(fresh & np.concatenate([fresh[1:], [True]]))]
        known *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, lanes: int = 16384) -> np.ndarray:
    """Kasai: for each suffix in order, the bytes it shares with the one before, up to depth. The text is cut into
    lanes that advance together, each dropping at most one shared byte from a position to the next."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
    eight = np.zeros(n + 8, dtype=np.uint64)  # the eight bytes from each place on, the first of them lowest
    for k in range(8):
        eight |= padded[k : k + n + 8] << np.uint64(8 * k)
    steps = -(-n // lanes)
    begin = np.arange(0, n, steps)
    shared, out = np.zeros(len(begin), dtype=np.int64), np.zeros(n, dtype=np.int32)
    for step in range(steps):
        at = begin[: np.searchsorted(begin, n - step)] + step
        other = before[at]
        shared = np.where(other >= 0, np.maximum(shared[: len(at)] - 1, 0), 0)
        limit = np.minimum(depth, n - np.maximum(at, other))
        going = np.flatnonzero((other >= 0) & (shared < limit))
        while len(going):
            s = shared[going]
            apart = eight[at[going] + s] ^ eight[other[going] + s]
            # the lowest bit in which they differ tells how many bytes are the same
            more = np.where(apart == 0, 8, np.log2((apart & -apart).astype(float), where=apart != 0, out=np.zeros(len(s))).astype(np.int64) >> 3)
            shared[going] = s = np.minimum(s + more, limit[going])
            going = going[(more == 8) & (s < limit[going])]
        out[at] = shared
    return out[order]


def repeats_in_shard(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the window starts of the contexts laid end to end: their places, whether they repeat here, and whether
    they speak for their string (the first of each cluster of equal windows)."""
    text = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    windows = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begins, sizes, strict=True)])
    is_window = np.zeros(len(text), dtype=bool)
    is_window[windows] = True
    order = suffix_order(text)
    cluster = np.cumsum(common_prefixes(text, order, length) < length)
    held = is_window[order]
    number = cluster[held]
    at = order[held]
    size = np.bincount(number)[number]
    speaks = np.concatenate([[True], number[1:] != number[:-1]])
    repeated, spoken = np.zeros(len(text), dtype=bool), np.zeros(len(text), dtype=bool)
    repeated[at], spoken[at] = size > 1, speaks
    return windows, repeated[windows], spoken[windows]


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def classes_of(raw: bytes, place: int, step: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The classes of a context's windows, step bytes before the anchor to a class: number, first and last window, and
    the core, which is the bytes that all windows of the class share, whether the context has them or not."""
    n = len(raw) - length + 1
    for k in range((place - n + 1) // step, place // step + 1):
        core = raw[place - k * step : place - (k + 1) * step + 1 + length]
        yield k, max(0, place - (k + 1) * step + 1), min(n - 1, place - k * step), core


def window_cores(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """contexts(anchor, ctx_a, ctx_b, place, bytes) to a row for each class of windows that a context has: its first
    window, their number, and the digest of its core."""
    names = ["anchor", "ctx_a", "ctx_b", "class", "core_a", "core_b", "at", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, ctx_a, ctx_b, place, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, first, last, core in classes_of(raw, place, STEP, length):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(core), dtype=np.int64)
                    rows.append((anchor, ctx_a, ctx_b, k, int(digest[0]), int(digest[1]), first, last - first + 1))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return contexts.select("anchor", "ctx_a", "ctx_b", "place", "bytes").mapInArrow(run, "anchor long, ctx_a long, ctx_b long, class int, core_a long, core_b long, at int, size int")


def hopeful(group: list[tuple], length: int) -> list[tuple]:
    """The contexts of a whole group, cut down to the windows of classes whose core another context has too: no other
    window can repeat, so that what stands alone never reaches the suffix array."""
    cores: dict[tuple[int, bytes], int] = {}
    own = []
    for _, _, _, _, at, place, raw in group:
        own.append([(k, first, last, (k, core)) for k, first, last, core in classes_of(raw, place - at, COARSE, length)])
        for *_, core in own[-1]:
            cores[core] = cores.get(core, 0) + 1
    out = []
    for (split, anchor, ctx_a, ctx_b, at, place, raw), classes in zip(group, own, strict=True):
        spans: list[list[int]] = []
        for _, first, last, core in sorted(c for c in classes if cores[c[3]] > 1)[::-1]:
            if spans and spans[-1][1] == first - 1:
                spans[-1][1] = last
            else:
                spans.append([first, last])
        out += [(split, anchor, ctx_a, ctx_b, at + first, place, raw[first : last + length]) for first, last in spans]
    return out


def split_by_content(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Contexts of crowded anchors to groups of the contexts that share a core: deal, n, anchor, ctx_a, ctx_b, at, place,
    bytes."""
    context, core = ["anchor", "ctx_a", "ctx_b"], ["anchor", "class", "core_a", "core_b"]
    cores = stored(window_cores(contexts, length), "suffix-cores")
    met = stored(cores.groupBy(*core).agg(F.count("*").alias("n")).where("n > 1"), "suffix-met")
    parts = cores.join(met, core).select(*context, F.xxhash64(*core).alias("deal"), "n", "at", F.col("size").alias("width"))
    parts = stored(parts, "suffix-parts")  # written before it is joined, so that Spark can split a crowded anchor
    cut = contexts.join(parts, context)
    return cut.select("deal", "n", *context, "at", "place", F.expr(f"substring(bytes, at + 1, width + {length - 1})").alias("bytes"))


def shard_repeats(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """contexts(deal, part, split, anchor, ctx_a, ctx_b, at, place, bytes), dealt out and sorted by deal and part. Returns
    ranges lo..hi of repeated window offsets and, for split groups, a digest of each window that speaks for its string."""
    names = ["anchor", "ctx_a", "ctx_b", "lo", "hi", "digest_a", "digest_b"]

    def solve(group: list[tuple]) -> pa.RecordBatch:
        _, repeated, spoken = repeats_in_shard([g[-1] for g in group], length)
        rows, done = [], 0
        for split, anchor, ctx_a, ctx_b, at, _, raw in group:
            n = len(raw) - length + 1
            rows += [(anchor, ctx_a, ctx_b, at + int(lo), at + int(hi), None, None) for lo, hi in zip(*_ranges(repeated[done : done + n]), strict=True)]
            if split:
                for k in np.flatnonzero(spoken[done : done + n]).tolist():
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(raw[k : k + length]), dtype=np.int64)
                    rows.append((anchor, ctx_a, ctx_b, at + k, at + k, int(a), int(b)))
            done += n
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, size, key = [], [], 0, None
        for batch in batches:
            for deal, part, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (deal, part) != key:
                    group = group if group and group[0][0] else hopeful(group, length)
                    shard, size = shard + group, size + sum(len(g[-1]) for g in group)
                    group, key = [], (deal, part)
                    if size >= SHARD:
                        yield solve(shard)
                        shard, size = [], 0
                group.append(tuple(own))
        shard += group if group and group[0][0] else hopeful(group, length)
        if shard:
            yield solve(shard)

    wanted = contexts.select("deal", "part", "split", "anchor", "ctx_a", "ctx_b", "at", "place", "bytes")
    return wanted.mapInArrow(run, "anchor long, ctx_a long, ctx_b long, lo int, hi int, digest_a long, digest_b long")


def merge_shards(spoken: DataFrame) -> DataFrame:
    """Windows that speak for their string in several shards: sorted digests, looked up by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not own:
            return
        rows = pa.Table.from_batches(own)
        digest = np.empty(len(rows), dtype=[("a", np.int64), ("b", np.int64)])
        digest["a"], digest["b"] = rows["digest_a"].to_numpy(), rows["digest_b"].to_numpy()
        order = np.argsort(digest)
        ranked = digest[order]
        met = np.searchsorted(ranked, digest, "right") - np.searchsorted(ranked, digest, "left") > 1
        yield from rows.filter(pa.array(met)).to_batches()

    return spoken.repartition("digest_a").mapInArrow(run, spoken.schema)


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row_key and the ranges of starts of repeated strings in documents that have any."""
    runs = stored(window_runs(docs, length), "suffix-runs")
    # aggregates are written before they are joined, so that both sides of a join are plain shuffles, which Spark can
    # split where one anchor or context holds a large part of the rows
    again = stored(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    runs = stored(runs.join(again, "anchor", "left_semi"), "suffix-again")
    context = ["anchor", "ctx_a", "ctx_b"]
    distinct = runs.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "start", "size", "place")).alias("at"))
    distinct = stored(distinct.select(*context, "n", "at.*"), "suffix-contexts")
    kinds = stored(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-kinds")
    several = distinct.join(kinds, "anchor")
    wanted = several.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct(*context, "kinds", "start", "size", "place")).alias("contexts"))
    cut = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["row_key"] == wanted["row_key"]))
    cut = cut.select(F.encode("text", "UTF-8").alias("raw"), F.explode("contexts").alias("c"), docs["row_key"])
    cut = cut.select("c.*", F.expr(f"substring(raw, cast(c.start + 1 as int), c.size + {length - 1})").alias("bytes"))
    crowded = not kinds.where(F.col("kinds") > GROUP).isEmpty()
    cut = stored(cut, "suffix-cut") if crowded else cut
    dealt = cut.where(F.col("kinds") <= GROUP).select(F.col("anchor").alias("deal"), F.col("kinds").alias("n"), *context, F.lit(0).alias("at"), "place", "bytes")
    if crowded:
        dealt = dealt.unionByName(split_by_content(cut.where(F.col("kinds") > GROUP), length))
    parts = F.ceil(F.col("n") / GROUP).cast("long")
    dealt = dealt.withColumn("split", F.col("n") > GROUP).withColumn("part", F.pmod(F.xxhash64("ctx_b"), parts))
    found = stored(shard_repeats(dealt.repartition("deal", "part").sortWithinPartitions("deal", "part", "anchor", "ctx_a", "ctx_b"), length), "suffix-found")
    merged = merge_shards(found.where("digest_a is not null"))
    ranges = found.where("digest_a is null").unionByName(merged).select(*context, "lo", "hi")
    same = distinct.where("n > 1").select(*context, F.lit(0).alias("lo"), (F.col("size") - 1).alias("hi"))
    verdicts = stored(ranges.unionByName(same).groupBy(*context).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "suffix-verdicts")
    hit = runs.join(verdicts, context).select("doc_id", "row_key", F.transform("ranges", lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start")).alias("hi"))).alias("ranges"))
    return hit.groupBy("doc_id", "row_key").agg(F.sort_array(F.flatten(F.collect_list("ranges"))).alias("ranges"))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _span_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, from prefix sums; equal spans have equal hashes wherever they stand."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(base, len(values) - 1)[: len(values)])])
    h = (total[ends] - total[starts]) * _powers(_inverse(base), len(values))[starts]
    h ^= h >> np.uint64(32)
    return h * _ODD[7]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, words being split at ASCII white space."""
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return (_span_hashes(_BYTE[raw], int(_ODD[0]), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)), starts


def word_parts(text: bytes, words: int) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut at white space; each begins with the last words of the one before."""
    at, size = 0, PIECE
    while at + size < len(text):
        part = text[at : at + size]
        rest = part.rsplit(None, words + 1)
        if len(rest) > words + 1 and rest[0]:
            yield part[: len(part) - len(rest[-1])]  # the last word may be cut
            at, size = at + len(rest[0]), PIECE
        else:
            size *= 2
    yield text[at:]


def passage_marks(docs: DataFrame, words: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """row_key and the hash of the gram with the least hash in each window of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch, "text"), strict=True):
                for part in word_parts(text, words):
                    keys.append(key)
                    parts.append(part + b" ")
                    size += len(part)
                    if size >= PIECE:
                        yield marks_of(keys, parts)
                        keys, parts, size = [], [], 0
            yield marks_of(keys, parts)

    def marks_of(keys: list[int], parts: list[bytes]) -> pa.RecordBatch:
        hashes, starts = word_hashes(np.frombuffer(b"".join(parts), dtype=np.uint8))
        both = np.zeros((2, 0), dtype=np.int64)
        if len(hashes) >= words:
            first = np.arange(len(hashes) - gram + 1)
            ends = np.searchsorted(starts, np.cumsum([len(p) for p in parts]))
            owner, _, _, _, marks = runs_of(_span_hashes(hashes, int(_ODD[1]), first, first + gram), gram, ends, words)
            both = np.stack([np.array(keys, dtype=np.int64)[owner], marks.view(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["row_key", "mark"])

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, mark long")


def passage_sharers(docs: DataFrame, words: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """row_key of each document that shares a passage with another one. Every passage of so many words is met, for equal
    windows choose equal grams; of shorter ones those of at least gram words may be."""
    marks = stored(passage_marks(docs, words, gram), "passage-marks")
    shared = marks.groupBy("mark").agg(F.min("row_key").alias("a"), F.max("row_key").alias("b")).where("a <> b").select("mark")
    return marks.join(stored(shared, "passage-shared"), "mark", "left_semi").select("row_key").distinct()


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (removed byte ranges), kept (what is left) and
    shares_passage (whether another document has a passage of more than 50 of its words, see passage_sharers)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    found = repeated_ranges(docs, length)
    sharers = docs.select("doc_id", "row_key").join(passage_sharers(docs), "row_key", "left_semi")
    both = found.withColumn("shares", F.lit(False)).unionByName(sharers.select("doc_id", "row_key", F.lit(None).cast(found.schema["ranges"].dataType).alias("ranges"), F.lit(True).alias("shares")))
    found = both.groupBy(F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key")).agg(F.max("ranges").alias("ranges"), F.max("shares").alias("shares"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = texts_as_bytes(batch, "text"), batch.column(2).to_pylist()
            rows = []
            for text, own in zip(texts, ranges, strict=True):
                spans: list[list[int]] = []
                for r in own or ():
                    if spans and r["lo"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["hi"] + length)
                    else:
                        spans.append([r["lo"], r["hi"] + length])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                kept = b"".join([*kept, text[at:]]) if spans else text
                rows.append((len(text), len(text) - len(kept), len(spans), spans, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256", "shares_passage"])

    both = docs.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key")), "left")
    wanted = both.select("doc_id", "text", "ranges", F.coalesce("shares", F.lit(False)).alias("shares"))
    return wanted.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary, kept_sha256 string, shares_passage boolean")
