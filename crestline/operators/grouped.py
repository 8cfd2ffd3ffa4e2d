"""Python on the rows of one group at a time, many groups in an Arrow batch: a group costs no batch of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def starts(keys: pa.Array) -> np.ndarray:
    """Whether a row begins a group, of keys that stand together."""
    of = keys.dictionary_encode("encode").indices.to_numpy()
    return np.concatenate([[True], of[1:] != of[:-1]])


def pick_rows(df: DataFrame, key: str, order: list[Column], columns: list[str], choose: Callable[[pa.RecordBatch], tuple[list[int], dict[str, list]]], more: dict[str, pa.DataType]) -> DataFrame:
    """The rows of each group that choose picks, in order of picks: their ``columns`` and ``more``, the lists that it gives.

    choose gets a group's rows in order; of a batch the last group waits for the next one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), *(f"{c} {'int' if t == pa.int32() else t}" for c, t in more.items())])

    def picked(rows: pa.RecordBatch) -> pa.RecordBatch:
        begin = np.append(np.flatnonzero(starts(rows.column(key))), len(rows))
        at, extra = [], {}
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            mine, values = choose(rows.slice(a, b - a))
            at += [a + int(k) for k in mine]
            for name, column in values.items():
                extra.setdefault(name, []).extend(column)
        out = rows.select(columns).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*out.columns, *(pa.array(extra.get(n, []), t) for n, t in more.items())], names=[*columns, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            if rows.num_rows:
                cut = int(np.flatnonzero(starts(rows.column(key)))[-1])
                if cut:
                    yield picked(rows.slice(0, cut))
                rest = rows.slice(cut)
        if rest is not None:
            yield picked(rest)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
