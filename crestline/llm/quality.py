"""Quality rules: document statistics, hard rules, and gradient-boosted trees flattened into numpy node arrays.

The trees are fitted on at most MAX_TRAIN labelled rows (the least hashes of doc_id), a documented bound; every
document is scored. Splits on features with a monotonic constraint keep the stated direction.

Defined results: a null text has no words and fails the rules; repeated rows are judged each on its own, and of rows that
repeat a labelled id one text is learned from; labels that are null, or of one class only, leave a constant model that
keeps what passes the rules; a text of any length is measured whole; of splits with the same gain the first feature and
least limit is taken; an empty table gives no rows; other columns are not read, and keep_good keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_as_bytes

MAX_TRAIN = 20_000
PORTION = 100  # texts that are measured at once
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "other_ratio", "distinct_ratio", "top_word_ratio", "stop_ratio", "log_lines", "line_words", "bang_ratio")
#: -1: a document is never better for more of it.
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "bang_ratio": -1}

_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)
_OTHER = np.setdiff1d(np.frombuffer(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), dtype=np.uint8), np.frombuffer(b".,!", dtype=np.uint8))


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 2_000_000:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(key)] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Base counts and features of a text."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    points = int(counts.sum() - counts[0x80:0xC0].sum())
    words = text.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    lines, seen, dup, filled = text.split(b"\n"), set(), 0, 0
    for line in lines:
        if line and not line.isspace():
            filled += 1
            dup += line in seen
            seen.add(line)
    word_chars, symbols, repeats = points - int(counts[_SPACES].sum()), int(counts[_SYMBOLS].sum()), repeat_words(ids, len(number))
    chars, top = max(1, word_chars), np.sort(np.bincount(ids))[::-1] if n else np.zeros(1)
    features = (
        np.log1p(n), word_chars / max(1, n), symbols / chars, dup / max(1, filled), repeats / max(1, n), counts[65:91].sum() / chars, counts[48:58].sum() / chars,
        counts[_OTHER].sum() / chars, len(number) / max(1, n), top[0] / max(1, n), top[:10].sum() / max(1, n), np.log1p(filled), n / max(1, filled), counts[33] / max(1, n),
    )
    return (n, word_chars, symbols, dup, repeats), tuple(map(float, features))


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as node arrays: inner nodes in heap order, then leaves."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    limit: np.ndarray  # go right where x > limit; inf where a node is not split
    value: np.ndarray  # (trees, 2**depth)
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (len(value) - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Logistic boosting on histograms; a child's value stays within bounds that its parents' constrained splits set."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        start = 4.0 if not len(y) else float(8 * y[0] - 4)
        return Trees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start, depth)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # code <= k: x <= cuts[k]
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    margin, all_feature, all_limit, all_value = np.full(len(y), start), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node, feature, limit = np.zeros(len(y), dtype=np.int64), np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        low, high, value = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf), np.zeros(leaves)
        worth = lambda g, h, a, b: np.clip(-g / (h + ridge), a, b)
        gain_of = lambda g, h, w: -(g * w + 0.5 * (h + ridge) * w * w)
        for at in range(inner):
            low[2 * at + 1 : 2 * at + 3], high[2 * at + 1 : 2 * at + 3] = low[at], high[at]
            rows = np.flatnonzero(node == at)
            if len(rows) >= 2 * least:
                g, h = grad[rows], hess[rows]
                whole, best = gain_of(g.sum(), h.sum(), worth(g.sum(), h.sum(), low[at], high[at])), (1e-6, None)
                for f, c in enumerate(cuts):
                    k = code[rows, f]
                    sums = [np.cumsum(np.bincount(k, weights=w, minlength=len(c) + 1))[:-1] for w in (g, h, np.ones(len(rows)))]
                    gl, hl, nl = sums
                    gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
                    wl, wr = worth(gl, hl, low[at], high[at]), worth(gr, hr, low[at], high[at])
                    gain = gain_of(gl, hl, wl) + gain_of(gr, hr, wr) - whole
                    gain[(nl < least) | (nr < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
                    if len(gain) and gain.max() > best[0]:
                        i = int(gain.argmax())
                        best = (float(gain[i]), (f, i, float(wl[i]), float(wr[i])))
                if best[1]:
                    f, i, wl, wr = best[1]
                    feature[at], limit[at] = f, cuts[f][i]
                    if monotone[f]:
                        mid = (wl + wr) / 2
                        (high if monotone[f] > 0 else low)[2 * at + 1] = mid
                        (low if monotone[f] > 0 else high)[2 * at + 2] = mid
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
        for leaf in range(leaves):
            rows = node == inner + leaf
            if rows.any():
                value[leaf] = rate * worth(grad[rows].sum(), hess[rows].sum(), low[inner + leaf], high[inner + leaf])
        margin += value[node - inner]
        all_feature.append(feature)
        all_limit.append(limit)
        all_value.append(value)
    return Trees(np.array(all_feature), np.array(all_limit), np.array(all_value), start, depth)


_STATS = ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def _measured(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(t) for t in texts]
    return np.array([b for b, _ in both], dtype=np.int64).reshape(-1, len(BASE)), np.array([f for _, f in both]).reshape(-1, len(FEATURES))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts and features of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, features = _measured(texts_as_bytes(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base.T), *map(pa.array, features.T)], names=["doc_id", *BASE, *FEATURES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, f"doc_id long, {_STATS}")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fit on at most max_train labelled documents (quality 0 or 1), those with the least hashes of doc_id."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # of rows that repeat an id the text with the least hash, so that at most max_train rows come to the driver
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = document_statistics(sample).join(F.broadcast(known), "doc_id").select("doc_id", *FEATURES, "quality").toPandas().sort_values("doc_id")
    monotone = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return fit_trees(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["quality"].to_numpy(float), monotone)


def _failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


def quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, base_failed, the trees' score and kept."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, features = _measured(texts_as_bytes(batch, "text"))
            failed, score = _failed(base), model.predict(features)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0.5))], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")


def passing(texts: pa.Array, model: Trees) -> pa.Array:
    """Whether texts pass the rules and the trees; of an Arrow batch of ten thousand a hundred are measured at once."""
    kept = [np.zeros(0, dtype=bool)]
    for at in range(0, len(texts), PORTION):
        base, features = _measured(texts.slice(at, PORTION).fill_null("").cast(pa.large_binary()).to_pylist())
        kept.append(~_failed(base) & (model.predict(features) >= 0.5))
    return pa.array(np.concatenate(kept))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The documents that pass the rules and the trees, with all their columns."""

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        return passing(texts, model)

    return docs.where(passes(F.col(text_col)))
