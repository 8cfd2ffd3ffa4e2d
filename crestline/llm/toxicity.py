"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

At most MAX_EXAMPLES labelled rows (the least hashes of doc_id, a documented bound) are the examples. The vector space
has every word of the examples. Document frequencies are counted over the whole corpus; a word's weight is raised by
how much its presence depends on the label among the examples (label_gain), and none is left out.
The index keeps postings in blocks of BLOCK examples and the greatest weight of each term in each block; blocks whose
upper bound cannot reach the K-th best cosine are not looked at, so the neighbours are exact. Votes are weighted
by 1 / (distance + SOFT) and calibrated by a logistic map that is fitted on the examples' own votes, each without
itself. The evidence are the neighbours and the shared words.

Labels, language, source and doc_id are never part of a vector. Defined results: a null or empty text, or one without
a word of any example, gets the smoothed share of toxic examples that have none either; null labels are left out; rows
that repeat score the same; of equally near examples the least number is taken; a text of any length is scored whole;
without examples of both classes every score is the share of toxic ones (0 if none); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EXAMPLES = 8192
K, BLOCK, SOFT = 15, 64, 0.05
#: What the terms that are not read at first may add to a score, of all that can be added.
SHARE = 0.01
_WORD = re.compile(r"[^\W_]+")
_SPACED = {c: " " for c in range(128) if not chr(c).isalnum()}


def terms_of(text: str | None) -> list[str]:
    """All that _WORD finds in the lower-cased text; texts of ASCII are split in less than half of its time."""
    if not text:
        return []
    return text.lower().translate(_SPACED).split() if text.isascii() else _WORD.findall(text.lower())


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... with counts[0] members, then those of the next."""
    ends = np.cumsum(counts)
    found = np.repeat(starts - ends + counts, counts)
    found += np.arange(len(found))
    return found


class BlockMaxIndex:
    """Unit vectors of examples, filed by term in blocks of neighbours."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # examples with the same heaviest term stand together, which keeps the blocks' bounds tight
        self.order = np.array(sorted(range(len(vectors)), key=lambda e: (int(vectors[e][0][vectors[e][1].argmax()]) if len(vectors[e][0]) else n_terms, e)), dtype=np.int64)
        self.blocks = -(-len(vectors) // BLOCK)
        none = [np.zeros(0, dtype=np.int64)]
        terms = np.concatenate(none + [vectors[e][0] for e in self.order])
        place = np.repeat(np.arange(len(vectors)), [len(vectors[e][0]) for e in self.order])
        weight = np.concatenate([np.zeros(0)] + [vectors[e][1] for e in self.order])
        sort = np.argsort(terms, kind="stable")
        terms, self.place, self.weight = terms[sort], place[sort].astype(np.int32), weight[sort]
        # an entry is a term in a block: its postings from start on, and the greatest of their weights
        new = np.flatnonzero(np.diff(terms * max(1, self.blocks) + self.place // BLOCK, prepend=-1))
        self.start = np.append(new, len(terms))
        self.block = self.place[new] // BLOCK
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.first = np.searchsorted(terms[new], np.arange(n_terms + 1))
        self.most_of = np.zeros(n_terms)  # greatest weight of each term
        np.maximum.at(self.most_of, terms[new], self.most)
        # the same postings by example, to complete a score
        self.cuts = np.searchsorted(place, np.arange(len(vectors) + 1))
        held = np.concatenate(none + [vectors[e][0] for e in self.order])
        self.held_terms, self.held_weights = held.astype(np.int32), np.concatenate([np.zeros(0)] + [vectors[e][1] for e in self.order])
        self.query = np.zeros(n_terms)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Exact best k examples by cosine, ties by number; only examples that share a term.

        The terms that can add most are read first, until the others together can add SHARE at most. What they give is a
        lower bound of each score, and the k-th best of these is the limit. Examples that cannot reach it with all that is
        left are out; where these bounds leave too many, what is left is bounded block by block, by the greatest weights
        there. The scores of the others are completed, or all postings read where that costs less.
        """
        reach = weights * self.most_of[terms]
        order = np.argsort(-reach)
        terms, weights = terms[order], weights[order]
        left = np.cumsum(reach[order][::-1])[::-1]  # what the terms from here on can add
        begin = self.start[self.first[terms]]
        many = self.start[self.first[terms + 1]] - begin
        n = int(np.searchsorted(-left, -SHARE * left[0])) if len(terms) else 0
        unread = int(many[n:].sum())
        part, near = self._read(begin[:n], many[:n], weights[:n]), None
        if n < len(terms) and len(part) > k:
            known = part[self.order != but] if but >= 0 else part
            limit = np.partition(known, -k)[-k] - 1e-9
            if limit > 0:
                near = np.flatnonzero(part >= limit - left[n])
                sizes = self.cuts[near + 1] - self.cuts[near]
                if sizes.sum() > unread:
                    rest = terms[n:]
                    counts = self.first[rest + 1] - self.first[rest]
                    entry = _ranges(self.first[rest], counts)
                    bound = np.bincount(self.block[entry], self.most[entry] * np.repeat(weights[n:], counts), self.blocks)
                    near = near[part[near] + bound[near // BLOCK] >= limit]
                    sizes = self.cuts[near + 1] - self.cuts[near]
                near = near if sizes.sum() <= unread else None
        if near is None:
            near, score = np.arange(len(part)), part + self._read(begin[n:], many[n:], weights[n:])
        else:
            self.query[terms] = weights
            held = _ranges(self.cuts[near], sizes)
            gain = self.query.take(self.held_terms.take(held))
            gain *= self.held_weights.take(held)
            total = np.append(0.0, np.cumsum(gain))
            self.query[terms] = 0.0
            ends = np.cumsum(sizes)
            score = total[ends] - total[ends - sizes]
        held = np.flatnonzero((score > 0) & (self.order[near] != but))
        if len(held) > k:
            held = held[score[held] >= np.partition(score[held], -k)[-k] - 1e-9]
        score, example = score[held], self.order[near[held]]
        rank = np.lexsort((example, -np.round(score, 12)))[:k]
        return score[rank], example[rank]

    def _read(self, begin: np.ndarray, many: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What some terms' postings add to the score of each example."""
        post = _ranges(begin, many)
        weight = self.weight.take(post)
        weight *= np.repeat(weights, many)
        return np.bincount(self.place.take(post), weight, len(self.order))


@dataclass
class NearestVotes:
    """Vocabulary, weights (idf, raised by the label gain), examples and calibration."""

    words: list[str]
    idf: np.ndarray
    ids: list[int]
    toxic: np.ndarray
    #: First posting of each example, and the postings' terms and counts; number counts words from 1.
    cuts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    fitted: bool = False
    slope: float = 1.0
    shift: float = 0.0
    bare: float = 0.0
    number: dict[str, int] = field(default_factory=dict)
    index: BlockMaxIndex | None = None

    def __post_init__(self) -> None:
        self.number = {w: k for k, w in enumerate(self.words, 1)}
        vectors = [unit(self.terms[a:b].astype(np.int64), self.counts[a:b], self.idf) for a, b in itertools.pairwise(self.cuts.tolist())]
        self.index = BlockMaxIndex(vectors, len(self.words))
        if self.fitted:
            return
        both = len(self.toxic) and 0 < self.toxic.sum() < len(self.toxic)
        empty = np.array([not len(t) for t, _ in vectors], dtype=bool)
        share = float(self.toxic.mean()) if len(self.toxic) else 0.0
        self.bare = (float(self.toxic[empty].sum()) + share) / (int(empty.sum()) + 1) if len(empty) else share
        if both and not empty.all():
            own = np.flatnonzero(~empty)
            votes = np.array([self.vote(*self.index.nearest(*vectors[e], but=e)) for e in own])
            self.slope, self.shift = logistic(np.log(votes / (1 - votes)), self.toxic[own])

    def terms_at(self, example: int) -> np.ndarray:
        return self.terms[self.cuts[example] : self.cuts[example + 1]]

    def packed(self) -> bytes:
        """All but the index, which workers build again."""
        held = (self.words, self.idf, self.ids, self.toxic, self.cuts, self.terms, self.counts, True, self.slope, self.shift, self.bare)
        return zlib.compress(pickle.dumps(held, protocol=5), 1)

    def vote(self, scores: np.ndarray, examples: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by nearness, with one vote spread as the labels are."""
        prior = (self.toxic.sum() + 1) / (len(self.toxic) + 2)
        weight = 1 / (1 - np.minimum(scores, 1) + SOFT)
        return float(((weight * self.toxic[examples]).sum() + prior) / (weight.sum() + 1))

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        found = Counter(terms_of(text))
        terms = np.fromiter(map(self.number.get, found, itertools.repeat(0)), np.int64, len(found))
        order = np.argsort(terms)[np.count_nonzero(terms == 0) :]  # words of no example come first, as 0
        terms, weights = unit(terms[order] - 1, np.fromiter(found.values(), np.int64, len(found))[order], self.idf)
        if not len(terms):
            return self.bare, terms, np.zeros(0, dtype=np.int64)
        scores, examples = self.index.nearest(terms, weights)
        if not len(examples):
            return self.bare, terms, examples
        vote = self.vote(scores, examples)
        return float(1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.shift)))), terms, examples


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit weights (1 + ln tf) * idf."""
    terms = np.array(sorted(counts), dtype=np.int64)
    return unit(terms, np.array([counts[t] for t in terms.tolist()], dtype=float), idf)


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * idf[terms]
    return terms, weights / np.sqrt((weights**2).sum()) if len(terms) else weights


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not below 0) and shift of a logistic fit, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, w = p - y, p * (1 - p) + 1e-9
        hess = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(hess, [(g * x).sum() + ridge * (a - 1), g.sum() + ridge * b])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(a)), float(b)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, toxic, term, n of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, y, w, n) for d, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w, n in (Counter(terms_of(t)) or {"": 1}).items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "toxic", "term", "n"])

    return docs.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, term string, n int")


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents of the corpus each word stands, and how many documents there are."""
    number = {w: k for k, w in enumerate(words, 1)}
    n_words = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_words + 1, dtype=np.int64)  # that of all documents comes first
        for batch in batches:
            for at in range(0, len(batch), 1000):
                texts, found = batch.column(0).slice(at, 1000).to_pylist(), []
                for text in texts:
                    found += filter(None, map(number.get, set(terms_of(text))))
                counts += np.bincount(np.array(found, dtype=np.int64), minlength=n_words + 1)
                counts[0] += len(texts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["term", "n"])

    counts = np.zeros(n_words + 1, dtype=np.int64)
    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return counts[1:], int(counts[0])


def label_gain(present: np.ndarray, present_toxic: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """1 + the square of the chi-square statistic, with Yates' correction, of each word's presence against the label."""
    n, m, a = float(n_toxic + n_other), present.astype(float), present_toxic.astype(float)
    apart = np.maximum(0, np.abs(a * (n_other - (m - a)) - (m - a) * (n_toxic - a)) - n / 2)
    under = n_toxic * n_other * m * (n - m)
    return 1 + np.divide(n * apart**2, under, out=np.zeros(len(m)), where=under > 0) ** 2


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> NearestVotes:
    """Fit on at most max_examples labelled rows that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    # as many rows as the bounded examples have distinct words
    counted = _counted(sample).groupBy("doc_id", "toxic", "term").agg(F.max("n").alias("n")).toArrow().combine_chunks()
    ids, first, example = np.unique(counted.column("doc_id").to_numpy(), return_index=True, return_inverse=True)
    toxic = counted.column("toxic").to_numpy()[first].astype(float)
    n_toxic = int(toxic.sum())
    if not 0 < n_toxic < len(ids):
        return NearestVotes([], np.zeros(0), ids.tolist(), toxic, np.zeros(len(ids) + 1, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))
    words = sorted({w for w in counted.column("term").unique().to_pylist() if w})
    frequency, total = document_frequencies(docs, words)
    term = pc.index_in(counted.column("term"), pa.array(words, pa.string())).fill_null(-1).to_numpy()
    n = counted.column("n").to_numpy()
    del counted  # the driver holds the index next
    known_term = term >= 0  # an example without words has an empty term
    order = np.lexsort((term[known_term], example[known_term]))
    example, term, n = example[known_term][order], term[known_term][order].astype(np.int64), n[known_term][order]
    gain = label_gain(np.bincount(term, minlength=len(words)), np.bincount(term, toxic[example], len(words)), n_toxic, len(ids) - n_toxic)
    idf = (np.log((1 + total) / (1 + frequency)) + 1) * gain
    cuts = np.searchsorted(example, np.arange(len(ids) + 1))
    return NearestVotes(words, idf, ids.tolist(), toxic, cuts, term.astype(np.int32), n.astype(np.int32))


_MODELS: dict[str, NearestVotes] = {}


def score(docs: DataFrame, model: NearestVotes, id_col: str = "doc_id", text_col: str = "text", shown: int = 3) -> DataFrame:
    """doc_id, score, neighbours (doc_ids of the nearest examples) and shared words of every document."""
    packed, key = model.packed(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = NearestVotes(*pickle.loads(zlib.decompress(packed)))
        model = _MODELS[key]
        mine = np.zeros(len(model.words), dtype=bool)
        for batch in batches:
            rows, scored = [], {}  # texts that repeat in a batch are scored once
            for text in batch.column(1).to_pylist():
                if text not in scored:
                    value, terms, examples = model.score(text)
                    mine[terms] = True
                    near = [model.terms_at(e) for e in examples[:shown].tolist()]
                    shared = np.unique(np.concatenate([t[mine[t]] for t in near])).tolist() if near else []
                    mine[terms] = False
                    scored[text] = (value, [model.ids[e] for e in examples[:shown].tolist()], [model.words[t] for t in shared])
                rows.append(scored[text])
            cols = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "score", "neighbours", "shared_words"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, score double, neighbours array<long>, shared_words array<string>")
