"""SimHash near-duplicates, linked by pigeonring filtering.

Fingerprints within MAX_BITS = 2 bits are linked. The 64 bits form a ring of three segments. By the pigeonring
principle two linked fingerprints have a segment i such that every chain that starts there stays within its
proportional budget floor(length * 2 / 3): segment i is equal, segments i and i+1 differ in at most one bit, and all
three in at most two. A fingerprint is therefore filed under 64 keys: for each segment i, the segment itself and its
successor with one bit j struck out. Two fingerprints meet under a key exactly if their chain of length two stays
within budget; the pair then gets the full Hamming check. The number of keys is linear in the fingerprints, and a key
has 41 bits or more, so that chance meetings stay rare at any size.

Equal fingerprints are one node. A key with two nodes is a candidate pair, read off the aggregate (least and greatest
node) without gathering. A key with more nodes is never expanded into pairs: its nodes are linked through their common
one-bit neighbours (two fingerprints differ in at most two bits exactly if some word is within one bit of both), again
an aggregate, with 65 rows for each node whatever the group's size.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated rows share their
fingerprint and class; a null doc_id gets a fingerprint and the class of its fingerprint, and is never a class id
unless the class has no other id; a text of any length is hashed whole; a bit that half of the hashes have is 0; an empty
table gives no rows; other columns are not read, and keep_one keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored, texts_as_bytes
from .near_copies import joining_links, near_copies

BITS, MAX_BITS, SEED = 64, 2, 42
#: Segments of the ring: first bit and width.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles; A-Z in lower case, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint's bit pattern as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in texts_as_bytes(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, bits long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(segment: tuple[int, int]) -> int:
    return ((1 << segment[1]) - 1) << segment[0]


def chain_keys():
    """The 64 keys of a fingerprint: chain of segments i and i+1 with bit j of i+1 struck out, as struct(slot, chain)."""
    keys = []
    for i, head in enumerate(SEGMENTS):
        after = SEGMENTS[(i + 1) % len(SEGMENTS)]
        chain = _mask(head) | _mask(after)
        for j in range(after[0], after[0] + after[1]):
            keys.append(F.struct(F.lit(len(keys)).cast("tinyint").alias("slot"), F.col("bits").bitwiseAND(F.lit(_signed(chain & ~(1 << j)))).alias("chain")))
    return F.array(*keys)


def neighbours():
    """The fingerprint and its 64 one-bit neighbours."""
    return F.array(F.col("bits"), *(F.col("bits").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(BITS)))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all pairs within MAX_BITS bits."""
    filed = nodes.select("bits", F.explode(chain_keys()).alias("key")).select("bits", "key.slot", "key.chain").repartition("slot", "chain")
    met = filed.groupBy("slot", "chain").agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b")).where("n > 1")
    # both sides read the one exchange: what meets under a key is counted and found again where it lies
    met = stored(filed.join(met.hint("shuffle_hash"), ["slot", "chain"]).select("bits", "a", "b", "n"), "simhash-met")
    pairs = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b").distinct()
    crowded = met.where("n > 2").select("bits").distinct()
    near = crowded.select("bits", F.explode(neighbours()).alias("word"))
    stars = near.groupBy("word").agg(F.min("bits").alias("a"), F.max("bits").alias("b"), F.count("*").alias("n")).where("n > 1")
    linked = near.join(stars.select("word", "a"), "word").where("bits <> a").select("a", F.col("bits").alias("b")).distinct()
    return pairs.unionByName(linked)


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits, component_id (the smallest doc_id that can be reached) for every document."""
    marked = stored(fingerprints(docs, shingle, id_col, text_col), "simhash-bits")
    nodes = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    comps = connected_components(links(nodes))
    rooted = nodes.join(comps, nodes["bits"] == comps["node"], "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(classes, "bits").select("doc_id", "bits", "component_id")


def hex_digits():
    return F.lpad(F.lower(F.hex("bits")), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs without the documents whose class has a smaller doc_id; all columns stay.

    A class is what links of fingerprints and near copies by five-word shingles (see near_copies) reach together: two bits
    alone meet few of the copies whose similarity is near 0.8.
    """
    by_bits = near_duplicates(docs, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    edges = stored(joining_links(docs, by_bits), "near-links")
    extra = connected_components(edges).where("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(extra, "doc_id", "left_anti")
