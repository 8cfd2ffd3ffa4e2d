"""Near copies by the Jaccard similarity of five-word shingles, for the stage that keeps one document of each group.

Two bits of 64 meet nearly all copies that differ in a word or two, but few at a similarity of 0.8. Here no pair is left
out: the shingles of every distinct sequence of words are put in one order that all share, and a pair of similarity s and
more has its first common shingle among the first n - s * n + 1 of both (prefix filtering). All that share such a shingle
meet, unless their sizes or its places rule out the similarity; a pair counts only if the exact similarity of its shingle
sets reaches LEAST. Any order gives the same pairs. Shingles that a share of the documents has often come last, as a
frequent one makes many pairs; a shingle of more than TILE documents is dealt over tiles, none of its pairs is left out.

Defined results: A-Z in lower case, words split at ASCII white space; a text of fewer words than a shingle is one shingle; a
null or blank text has no near copy; repeated rows are one text; rows without doc_id are left out; a text of any length is
read whole; an empty table gives no pairs; other columns are not read.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, stored, texts_as_bytes

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Documents that one tile of a shingle has; one of so many documents counts for the order; shingles that come last, at most.
TILE, SHARE, COMMON = 1024, 16, 65_536
#: Turns of pivots before all that is left is compared; pairs whose texts are held at once.
TURNS, SLICE = 2, 256
PARITY = tuple(f"odd{k}" for k in range(8))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    size = len(words) - width + 1
    grams = np.zeros(size, dtype=np.uint64)
    for k in range(width):
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX + hashes[k : k + size]
    return np.unique(grams)


def prefix(grams: np.ndarray, least: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a text, one of which every near copy has: the common ones (ascending, with their rank) last."""
    length = len(grams) - math.ceil(least * len(grams) - 1e-9) + 1
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1) if len(common) else np.zeros(0, dtype=int)
    if not len(at) or not (often := common[at] == grams).any():
        return grams[:length]
    rare = grams[~often]
    return rare[:length] if len(rare) >= length else np.concatenate([rare, grams[often][np.argsort(rank[at[often]])]])[:length]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of one in SHARE documents have, ascending, and their rank, the rarest first. This decides on
    the order alone, and so on the work, never on a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in texts_as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64))], names=["gram"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0).select("doc_id", "text")
    top = some.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "gram").limit(COMMON)
    grams = np.array([r["gram"] for r in top.select("gram").collect()][::-1], dtype=np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.arange(len(grams))[order]


def prefixes(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, words (a digest of the sequence of words), size and the first shingles of every document with a word."""
    common, rank = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch, "text"), strict=True):
                if len(grams := shingles(text)):
                    # 48 bits: what meets by chance is told apart by the exact similarity
                    first = (prefix(grams, least, common, rank) >> np.uint64(16)).astype(np.int64)
                    rows.append((doc_id, xxhash.xxh3_128_digest(b" ".join(text.lower().split())), len(grams), first))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "words", "size", "first"])

    return docs.mapInArrow(run, "doc_id long, words binary, size int, first array<long>")


def filed(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """node (the least doc_id of a distinct text), size, rest (shingles from here on) and gram, for first shingles that meet."""
    nodes = prefixes(docs, least).groupBy("words").agg(F.min("doc_id").alias("node"), F.first(F.struct("size", "first")).alias("t"))
    rows = nodes.select("node", "t.size", F.posexplode("t.first").alias("at", "gram"))
    met = rows.withColumn("n", F.count("*").over(W.partitionBy("gram"))).where("n > 1")
    return met.select("node", "size", (F.col("size") - F.col("at")).alias("rest"), "gram", "n")


def _can(x: str, y: str, least: float, parity: bool = False) -> Column:
    """Whether two members of a shingle can have the similarity: by their sizes, as the first common shingle leaves enough
    of both for all that they must have in common, and as no more bits of parity differ than shingles may."""
    one, two = F.col(f"{x}.size"), F.col(f"{y}.size")
    enough = (one + two) * (least / (1 + least)) - 1e-6
    can = (F.least(one, two) >= F.greatest(one, two) * least - 1e-6) & (F.least(F.col(f"{x}.rest"), F.col(f"{y}.rest")) >= enough)
    if not parity:
        return can
    differ = reduce(operator.add, (F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in PARITY))
    return can & (differ <= (one + two) * ((1 - least) / (1 + least)) + 1e-6)


def parities(docs: DataFrame) -> DataFrame:
    """Whether an odd number of a text's shingles has each value of nine bits, as longs: texts that differ in d shingles
    differ in d of these bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = np.zeros((len(batch), 64 * len(PARITY)), dtype=np.uint8)
            for k, text in enumerate(texts_as_bytes(batch, "text")):
                odd[k] = np.bincount((shingles(text) >> np.uint64(55)).astype(np.int64), minlength=odd.shape[1]) % 2
            longs = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(longs[:, k].copy()) for k in range(len(PARITY)))], names=["node", *PARITY])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["node long", *(f"{b} long" for b in PARITY)]))


def _tiled(met: DataFrame, n: Column, by: Column) -> tuple[DataFrame, DataFrame]:
    """met as both sides of a join on gram, p and q, in which a frequent shingle is dealt over tiles."""
    parts = F.ceil(n / TILE)
    other, part = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)), F.pmod(F.xxhash64(by), parts)
    return met.select("gram", part.alias("p"), other.alias("q"), "x"), met.select("gram", other.alias("p"), part.alias("q"), F.col("x").alias("y"))


def candidates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b), a < b, of the least doc_ids of distinct texts: all that can have the similarity, and others."""
    met = stored(filed(docs, least).select("gram", "n", F.struct("node", "size", "rest").alias("x")), "near-met")
    x, y = _tiled(met, F.col("n"), F.col("x.node"))
    both = x.join(y, ["gram", "p", "q"]).where("(x.size > y.size or x.size = y.size and x.node < y.node) and x.node <> y.node")
    return both.where(_can("x", "y", least)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def similar(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of docs(doc_id, text) that have the similarity."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-wanted")
    # an id that stands on several rows is compared by each of its texts
    texts = stored(docs.join(wanted, "doc_id", "left_semi").where(F.length(F.trim("text")) > 0), "near-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (b"", np.zeros(0, dtype=np.uint64))
        for batch in batches:
            keep = []
            for at in range(0, len(batch), SLICE):  # few whole texts at once
                some = batch.slice(at, SLICE)
                for one, two in zip(texts_as_bytes(some, "one"), texts_as_bytes(some, "two"), strict=True):
                    if known[0] != one:
                        known = (one, shingles(one))
                    other = shingles(two)
                    both = len(np.intersect1d(known[1], other, assume_unique=True))
                    keep.append(both > 0 and both >= least * (len(known[1]) + len(other) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(name)) for k, name in (("a", "one"), ("b", "two")))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two").mapInArrow(run, "a long, b long").distinct()


def _wanted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def near_copies(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between documents whose shingle sets have a Jaccard similarity of at least so much; of repeated texts
    the smallest doc_id stands for all."""
    docs = _wanted(docs, id_col, text_col)
    return similar(stored(candidates(docs, least), "near-pairs"), docs, least)


def _apart(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the shingles that two classes(node, root) have, with their class."""
    marked = met.drop("class").join(classes, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    mixed = marked.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("gram")
    return stored(marked.join(mixed, "gram", "left_semi"), "near-apart")


def _to_pivots(met: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs of each member with one of its shingle, of like size and another class: no more than there are members."""
    like = F.floor(F.log("size") / -math.log(least) + turn / 2).alias("like")  # every second turn cuts between
    met = met.select("gram", like, "class", "shared", F.struct("node", "size", "rest", *PARITY).alias("x"))
    # the same order in all shingles, so that near copies meet the same pivot in most of them; at first the text with the
    # least changes, which has most in common with the others, and is near to more of them than they are to each other
    place = F.xxhash64(F.lit(turn), "x.node")
    pivots = met.groupBy("gram", "like").agg(F.min_by(F.struct("x", "class"), place if turn else F.struct(-F.col("shared"), place)).alias("v"))
    both = met.join(pivots.select("gram", "like", F.col("v.x").alias("y"), F.col("v.class").alias("other")), ["gram", "like"]).where("class <> other")
    return both.where(_can("x", "y", least, parity=True)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _across(met: DataFrame, least: float) -> DataFrame:
    """All pairs that can have the similarity and are of two classes; members of one class are not paired.

    Classes meet by their shingles. One that has a single member there is compared by this where they meet, so that only
    pairs which can be similar are made; the members of others are looked up, first those of the class with fewer.
    """
    member = F.struct("node", "size", "rest", *PARITY)
    groups = met.groupBy("gram", "class").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("rest").alias("rest"), F.count("*").alias("many"), F.first(member).alias("one")
    ).withColumn("n", F.count("*").over(W.partitionBy("gram")))
    groups = groups.withColumn("one", F.when(F.col("many") == 1, F.col("one")))
    groups = stored(groups.select("gram", "n", F.struct("class", "low", "high", "rest", "many", "one").alias("x")), "near-groups")
    x, y = _tiled(groups, F.col("n"), F.col("x.class"))
    fit = (F.col("x.high") >= F.col("y.low") * least - 1e-6) & (F.col("y.high") >= F.col("x.low") * least - 1e-6)
    fit &= F.least("x.rest", "y.rest") >= (F.col("x.low") + F.col("y.low")) * (least / (1 + least)) - 1e-6
    unknown = lambda *c: reduce(operator.or_, (F.col(k).isNull() for k in c))
    two = x.join(y, ["gram", "p", "q"]).where("x.many < y.many or x.many = y.many and x.class < y.class").where("x.class <> y.class")
    two = two.where(fit & (unknown("x.one", "y.one") | _can("x.one", "y.one", least, parity=True)))
    two = stored(two.select("gram", F.col("x.class").alias("c"), F.col("y.class").alias("d"), F.col("x.one").alias("x"), F.col("y.one").alias("y")), "near-two")
    side = lambda c, x: met.select("gram", F.col("class").alias(c), member.alias(x))
    found = two.where("x is null").drop("x").join(side("c", "x"), ["gram", "c"]).where(unknown("y") | _can("x", "y", least, parity=True))
    found = two.where("x is not null").unionByName(found)
    last = found.where("y is null").drop("y").join(side("d", "y"), ["gram", "d"]).where(_can("x", "y", least, parity=True))
    return found.where("y is not null").unionByName(last).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def joining_links(docs: DataFrame, known: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) that reach, together with those known(a, b), all that these and near_copies reach.

    A group of copies is not expanded into its pairs. Members of a shingle are first compared with one pivot of it, twice
    in another order; after that only pairs of two classes are left that no link has joined, and all of these are
    compared, but for those whose parities differ too much for the similarity. So no link between two classes is left
    out, and a group of n copies takes some n comparisons.
    """
    docs = _wanted(docs, id_col, text_col)
    links, tried, met = stored(known, "near-known"), None, stored(filed(docs, least), "near-met")
    for turn in range(TURNS + 1):
        met = _apart(met, connected_components(links))
        if not turn:
            # an id that stands on several rows has the parities of each of its texts
            odd = parities(docs.join(met.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
            met = met.join(odd.distinct(), "node").withColumn("shared", F.sum("n").over(W.partitionBy("node")))
            met = stored(met, "near-parities")
        pairs = _to_pivots(met, turn, least) if turn < TURNS else _across(met, least)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = links.unionByName(stored(similar(pairs, docs, least), "near-joined"))
    return links
