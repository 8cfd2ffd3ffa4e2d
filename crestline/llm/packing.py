"""Best-fit packing into sequences of several permitted lengths.

Pieces of documents are packed in portions of PORTION pieces, longest first. A piece goes into the open bin with the
least room that holds it, whatever the bin's size. Where none does, a bin is opened, and its size is chosen for what is
still to be packed: for each permitted length the rest of the room is filled on paper with the longest pieces left that
fit, and the length that costs least for a token so placed is opened. A sequence costs its length, a share that grows
with its square as attention does, and an overhead, so that a long one must be filled to pay, and a short one wins where
it can be filled. In the end each bin shrinks to the least permitted length that holds its contents. The portion is packed
into bins of the largest length alone as well, and the cheaper of both packings is kept. A document longer than the
largest length is cut into pieces of that length and a rest.

Defined results: a null or empty text has its end token alone; a text of any length is packed whole, in pieces; pieces of
equal length are taken in order of doc_id and piece, and sizes of equal cost from the shortest on; rows that repeat are
packed each; a null doc_id is carried along; an empty table gives no bins; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES, OVERHEAD, ATTENTION, PORTION = (512, 1024, 2048, 4096), 16, 16_384, 50_000


def bin_cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """Cost of a sequence: its length, a quadratic share that equals the length at ``attention``, and an overhead."""
    return overhead + capacity + capacity * capacity / attention


def fill(room: int, left: list[int], present: int) -> int:
    """Tokens that the longest pieces left would bring into room; bit n of present is set if left[n] is not 0."""
    start = room
    while room:
        fits = present & ((2 << room) - 1)
        if not fits:
            break
        n = fits.bit_length() - 1
        many = min(left[n], room // n)
        room -= many * n
        present &= (1 << n) - 1
    return start - room


def pack_portion(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final capacity of each piece; where bins of the largest length alone cost less once they have
    shrunk, these are taken."""
    cost = {c: bin_cost(c, overhead, attention) for c in sorted(capacities)}
    found = []
    for opened in (cost, {max(cost): cost[max(cost)]}):
        bins, offsets, used = best_fit(lengths, opened)
        final = np.array(list(cost))[np.searchsorted(list(cost), used)] if used else np.zeros(0, dtype=np.int64)
        found.append((sum(cost[c] for c in final.tolist()), len(found), bins, offsets, final))
    _, _, bins, offsets, final = min(found, key=lambda f: f[:2])
    return bins, offsets, final[bins]


def best_fit(lengths: np.ndarray, cost: dict[int, float]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the tokens of each bin; cost: of a bin of each length that may be opened."""
    order = np.argsort(-lengths, kind="stable")
    sizes = sorted(cost)
    left = np.bincount(lengths, minlength=sizes[-1] + 1).tolist()
    present = sum(1 << n for n in range(1, len(left)) if left[n])
    rooms: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set if a bin has r tokens of room
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for piece in order.tolist():
        n = int(lengths[piece])
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: cost[c] / (n + fill(c - n, left, present)))
            own = len(used)
            used.append(0)
        bins[piece], offsets[piece] = own, used[own]
        used[own] += n
        if room > n:
            rooms.setdefault(room - n, []).append(own)
            open_rooms |= 1 << (room - n)
    return bins, offsets, used


def token_count(text_col: str):
    """Words and an end token."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, portion: int = PORTION) -> DataFrame:
    """lengths(doc_id, n_tokens) to one row per piece: doc_id, piece, n_tokens, bin_id, bin_offset, capacity.

    Portions are dealt out evenly, whatever the keys; a bin's id names its partition, portion and number.
    """
    largest = max(capacities)

    def solve(rows: list[tuple], partition: int, number: int) -> pa.RecordBatch:
        ids, pieces, sizes = zip(*sorted(rows, key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[1])), strict=True)
        sizes = np.array(sizes, dtype=np.int64)
        bins, offsets, final = pack_portion(sizes, capacities, overhead, attention)
        names = np.int64(partition << 40) + np.int64(number << 20) + bins
        cols = [pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(sizes), pa.array(names), pa.array(offsets), pa.array(final)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "capacity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, rows = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for doc_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in range(-(-n // largest)):
                    rows.append((doc_id, piece, min(largest, n - piece * largest)))
                    if len(rows) == portion:
                        yield solve(rows, partition, number)
                        rows, number = [], number + 1
        if rows:
            yield solve(rows, partition, number)

    parts = max(1, -(-lengths.count() // portion))
    dealt = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens").repartition(parts)
    return dealt.mapInArrow(run, "doc_id long, piece int, n_tokens long, bin_id long, bin_offset long, capacity long")


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(docs.select(F.col(id_col).alias("doc_id"), token_count(text_col).alias("n_tokens")), capacities)
