"""Token counts by the libraries themselves: batches of equal bytes are encoded in Arrow tasks, only lengths come back.

A batch of rows is cut into slices of BATCH_BYTES, whatever its number of rows, and a text longer than PART characters
into parts, so that memory is bounded by the slice and not by the text. A cut lies only where it is safe:

- sentencepiece writes a space as U+2581 and joins neighbours only to pieces of its vocabulary. Two characters that
  stand side by side in no piece are never joined, so that a text may be cut between them and the lengths added. In front
  of a space or a line feed this holds for every such model that ``Safe`` accepts; within a unit without either, the pairs
  of the vocabulary are asked. The library puts a space before each text; a part is therefore counted behind a line feed,
  which no piece holds, and the length of the line feed alone is taken off.
- The units of a text, from one safe cut to the next, repeat. Units are encoded once for each task, up to CACHE of them.
- A sentencepiece model that normalises, knows symbols of its own or joins across spaces, and every model of the
  tokenizers library, gets whole texts: nothing there proves a cut.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; a null doc_id keeps its
row; texts of any length are counted whole; special strings are plain text for sentencepiece and what the file says for
tokenizers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts encoded at once, characters of a part, units of up to UNIT characters that a task remembers.
BATCH_BYTES, PART, UNIT, CACHE = 1 << 20, 1 << 19, 48, 600_000

SPACE = "▁"
_UNITS = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive runs of texts with limit bytes at most, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield texts.slice(at, stop - at)
        at = stop


class Whole:
    """Counts of a model of the tokenizers library, special strings by its own default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Counts of a sentencepiece model, whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


class Safe(Pieces):
    """Counts of a sentencepiece model by units between safe cuts; ``accepts`` tells whether its cuts are proved."""

    def __init__(self, path: str):
        super().__init__(path)
        self.head = len(self.model.encode("\n"))
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.joined = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.cache: dict[str, int] = {}

    @staticmethod
    def accepts(path: str) -> bool:
        """A plain BPE that keeps white space, has no normaliser or symbols of its own, and no piece with a space inside."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix
        own = any(p.type == proto.SentencePiece.USER_DEFINED for p in proto.pieces)
        across = any("\n" in p.piece or " " in p.piece or SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        return plain and not own and not across and trainer.byte_fallback and trainer.model_type == trainer.BPE

    def _parts(self, text: str) -> Iterator[str]:
        """The text, which begins with the library's own space, in parts of about PART characters cut before white space."""
        at = 0
        while len(text) - at > PART:
            stop = at + PART
            while stop < len(text) and not (text[stop] == "\n" or text[stop] == " " and text[stop - 1] != " "):
                stop += 1
            yield text[at:stop]
            at = stop
        yield text[at:]

    def _cut(self, unit: str) -> Iterator[str]:
        """A long unit in pieces of UNIT characters or more, cut between characters that no piece joins."""
        plain, at = unit.replace(" ", SPACE), 0
        for k in range(1, len(unit)):
            if k - at >= UNIT and plain[k - 1 : k + 1] not in self.joined:
                yield unit[at:k]
                at = k
        yield unit[at:]

    def _learn(self, units: set[str]) -> dict[str, int]:
        """Lengths of units, encoded in batches of bytes."""
        found, batch, size = {}, [], 0
        for unit in units:
            batch.append(unit)
            size += 4 * len(unit)
            if size >= BATCH_BYTES:
                found |= self._encoded(batch)
                batch, size = [], 0
        return found | self._encoded(batch)

    def _encoded(self, units: list[str]) -> dict[str, int]:
        return dict(zip(units, (n - self.head for n in super().lengths(["\n" + u for u in units])), strict=True))

    def _known(self, units: set[str]) -> dict[str, int]:
        """Lengths of these units: the remembered ones, and those that are encoded now, together."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        fresh = units - self.cache.keys()
        long = {u: list(self._cut(u)) for u in fresh if len(u) > UNIT}
        found = self._learn({u for u in fresh if len(u) <= UNIT} | {p for parts in long.values() for p in parts})
        self.cache.update((u, n) for u, n in found.items() if len(u) <= UNIT)
        return {u: sum(found[p] for p in parts) for u, parts in long.items()}

    def lengths(self, texts: list[str]) -> list[int]:
        """Texts of BATCH_BYTES together; the parts of a longer text one after the other."""
        parts = [list(self._parts(" " + t.replace(SPACE, " "))) if t else [] for t in texts]
        if any(len(p) > 1 for p in parts):
            return [sum(n for part in own for n in self._sums([part])) for own in parts]
        return self._sums(["".join(own) for own in parts])

    def _sums(self, parts: list[str]) -> list[int]:
        units = [_UNITS.findall(part) for part in parts]
        extra = self._known(set().union(*units))
        known = self.cache
        if extra:
            return [sum(known[u] if u in known else extra[u] for u in own) for own in units]
        return [sum(map(known.__getitem__, own)) for own in units]


def counter(path: str) -> Whole | Pieces:
    if path.endswith(".json"):
        return Whole(path)
    return Safe(path) if Safe.accepts(path) else Pieces(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. ``tokenizer`` is a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            for part in slices(texts, BATCH_BYTES):
                size = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                n = pa.array(count.lengths(part.fill_null("").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), size, n], names=["doc_id", "n_bytes", "n_tokens"])
                at += len(part)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
