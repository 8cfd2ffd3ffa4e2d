"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models are trained: one of random strings, one of ordinary identifiers. A run of token
characters is reported when the random model explains it much better than the identifier model. The training data are
labelled character strings: ``random`` are the values that the fixed patterns find in the corpus and a seeded,
documented sample of generated keys; ``ordinary`` are all other runs of the corpus. Only the table of transition
counts (alphabet squared, twice) reaches the driver.

Defined results: a null text counts as empty and has no span; repeated rows are scanned each on its own; spans of the
method that overlap a span of the patterns are left out; spans that begin together are ordered by kind; a text of any
length is scanned whole, in time that grows with its length; an empty table gives no rows, and an empty corpus leaves the
generated sample and smoothing; other columns are not read, and redact keeps them as they are.
"""

from __future__ import annotations

import bisect
import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, texts_as_bytes

ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
_CODE = np.full(256, SIZE, dtype=np.int64)
_CODE[np.frombuffer(ALPHABET, dtype=np.uint8)] = np.arange(SIZE)

ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "markov")

#: Alphabets and lengths of the generated keys that are labelled random: documented, seeded, the same at every size.
GENERATED = (b"0123456789abcdef", b"0123456789ABCDEF", ALPHABET[26:52] + b"234567", ALPHABET[:62], ALPHABET[:64])
GENERATED_EACH, GENERATED_LENGTH = 400, 40


@dataclass(frozen=True)
class MarkovScanner:
    """Log-likelihood ratios of the transitions, random against ordinary, and the limits of a finding."""

    ratio: np.ndarray
    min_length: int = 20
    min_total: float = 12.0
    min_mean: float = 0.5

    def scan_base(self, text: bytes) -> list[tuple[int, int, str]]:
        """Spans of the fixed patterns in bytes: (start, end, kind), by start and then kind."""
        found = []
        low = text.lower()
        if b"password" in low or b"passwd" in low or b"secret" in low or b"token" in low or b"key" in low:
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        if b"AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        for run in RUN.finditer(text):
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end())]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))

    def scan(self, text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans with those of the method, in bytes."""
        base = self.scan_base(text)
        starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, e, _ in base), max))
        added = []
        for run in RUN.finditer(text):
            a, b = run.span()
            before = bisect.bisect_left(starts, b)  # base spans that begin before the run ends
            if b - a < self.min_length or before and reach[before - 1] > a:
                continue
            code = _CODE[np.frombuffer(text, dtype=np.uint8, count=b - a, offset=a)]
            total = float(self.ratio[code[:-1], code[1:]].sum())
            if total >= self.min_total and total >= self.min_mean * (b - a - 1):
                added.append((a, b, "markov"))
        return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


def _generated_counts() -> np.ndarray:
    rng, counts = np.random.default_rng(20240229), np.zeros((SIZE, SIZE))
    for letters in GENERATED:
        codes = _CODE[np.frombuffer(letters, dtype=np.uint8)]
        drawn = codes[rng.integers(0, len(codes), (GENERATED_EACH, GENERATED_LENGTH))]
        np.add.at(counts, (drawn[:, :-1].ravel(), drawn[:, 1:].ravel()), 1)
    return counts


def _transitions(text: bytes) -> np.ndarray:
    code = _CODE[np.frombuffer(text, dtype=np.uint8)]
    both = (code[:-1] < SIZE) & (code[1:] < SIZE)
    return (code[:-1] * SIZE + code[1:])[both]


def labelled_transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of the corpus by label: one row for each label and transition of a partition."""
    counts, plain = np.zeros((2, SIZE * SIZE), dtype=np.int64), MarkovScanner(np.zeros((SIZE, SIZE)))
    for batch in batches:
        for text in texts_as_bytes(batch, "text"):
            counts[0] += np.bincount(_transitions(text), minlength=SIZE * SIZE)
            values, assigned = [], 0  # assigned: end of the last assignment, which may hold the hex run that follows
            for start, end, kind in plain.scan_base(text):
                if kind == "assign":
                    assigned = end
                    values.append(ASSIGN.match(text, start, end).group(2))
                elif kind == "access" or end > assigned:
                    values.append(text[start:end])
            if values:
                own = np.bincount(_transitions(b" ".join(values)), minlength=SIZE * SIZE)
                counts[1] += own
                counts[0] -= own
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[label, pair])], names=["label", "pair", "n"])


def train(docs: DataFrame, text_col: str = "text", smoothing: float = 1.0) -> MarkovScanner:
    """Fit both models on the whole corpus; 2 x alphabet x alphabet counts come to the driver."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(labelled_transitions, "label int, pair int, n long")
    table = np.zeros((2, SIZE * SIZE))
    for row in counts.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        table[row["label"], row["pair"]] = max(0, row["n"])
    ordinary, random = table[0].reshape(SIZE, SIZE), table[1].reshape(SIZE, SIZE)
    # the values found in the corpus weigh no more than the generated sample, so that one kind of key does not rule
    generated = _generated_counts()
    random = random * min(1.0, generated.sum() / max(1.0, random.sum())) + generated
    log = lambda c: np.log((c + smoothing) / (c + smoothing).sum(axis=1, keepdims=True))
    return MarkovScanner(log(random) - log(ordinary))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, scanner: MarkovScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, base spans, all spans (code points, end exclusive)."""
    scanner = scanner or train(docs, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_as_bytes(batch, "text"):
                base, spans = scanner.scan(text)
                base, spans = code_points(text, base), code_points(text, spans)
                n = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                rows.append((*n, _joined(base), _joined(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base string, spans string")


def redact(docs: DataFrame, scanner: MarkovScanner | None = None, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with each found span of the text replaced by mark; null stays null, other columns as they are, but for the
    length of a changed text where there is such a column."""
    scanner = scanner or train(docs, text_col)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([_without(t, scanner, mark) for t in texts], dtype=object)

    clean = f"clean_{uuid.uuid4().hex}"
    out = docs.withColumn(clean, cleaned(F.col(text_col)))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(clean).eqNullSafe(F.col(text_col)), F.col(length_col)).otherwise(F.char_length(clean).cast(kind)))
    return out.withColumn(text_col, F.col(clean)).drop(clean)


def _without(text: str | None, scanner: MarkovScanner, mark: str) -> str | None:
    if text is None:
        return None
    raw = text.encode()
    out, at = [], 0
    for start, end, _ in scanner.scan(raw)[1]:
        if start >= at:
            out += [raw[at:start], mark.encode()]
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def sha256_of(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)
