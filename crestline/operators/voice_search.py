"""Voices at scale: the two best prototypes of each query, and the agreement of a label's samples, without all pairs.

Both use angles: for unit vectors the angle is a metric, so that a group of vectors within an angle r of its centre lies
no nearer to a query than angle(query, centre) - r, and two vectors at angles a and b from one centre are no further apart
than a + b. What bounds leave out cannot change a result; what they leave in is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import stored

#: Prototypes that a task holds at once; more are dealt over several passes. Samples of a tile's side. Bands of angles that are
#: kept apart. Room for rounding.
MOST_PROTOTYPES, TILE, BANDS, SLACK = 10_000, 512, 32, 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; null lists and elements as NaN, as are rows of another length than the first."""
    rows = [np.asarray(v.as_py() if v.is_valid else [], dtype=float) for v in column]
    size = max((len(r) for r in rows), default=0)
    return np.array([r if len(r) == size else np.full(size, np.nan) for r in rows]).reshape(len(rows), size)


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


class Groups:
    """Prototypes around pivots: about the root of their number, spread by farthest choice from the first label on."""

    def __init__(self, labels: list, vectors: np.ndarray):
        order = sorted(range(len(labels)), key=lambda k: labels[k])
        self.labels, self.vectors = [labels[k] for k in order], _unit(vectors[order])
        many = max(1, int(np.sqrt(len(order))))
        pivots, near = [0], self.vectors @ self.vectors[0]
        while len(pivots) < many:
            pivots.append(int(near.argmin()))
            near = np.maximum(near, self.vectors @ self.vectors[pivots[-1]])
        self.centres = self.vectors[pivots]
        own = (self.vectors @ self.centres.T).argmax(axis=1)
        self.members = [np.flatnonzero(own == g) for g in range(many)]
        angle = np.arccos(np.clip((self.vectors * self.centres[own]).sum(axis=1), -1, 1))
        self.radius = np.array([angle[m].max() if len(m) else 0.0 for m in self.members])

    def best_two(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, prototypes) of the best two of each query, by score, then label, and how many were compared."""
        n, q = len(queries), _unit(queries)
        score, found, compared = np.full((n, 2), -1.0), np.full((n, 2), len(self.labels)), np.zeros(n, dtype=np.int64)
        to_centre = np.arccos(np.clip(q @ self.centres.T, -1, 1))
        bound = np.maximum(0.0, np.cos(np.maximum(0.0, to_centre - self.radius))) + SLACK  # scores are 0 at least
        first = np.where(np.isnan(bound), -1.0, bound).argmax(axis=1)
        for only_first in (True, False):
            for g, members in enumerate(self.members):
                rows = np.flatnonzero((first == g) if only_first else (first != g) & (bound[:, g] >= score[:, 1]))
                if len(rows) and len(members):
                    s = np.clip(q[rows] @ self.vectors[members].T, 0, 1)
                    # members are in order of labels, and so are ties
                    both = np.concatenate([score[rows], s], axis=1)
                    names = np.concatenate([found[rows], np.broadcast_to(members, s.shape)], axis=1)
                    top = np.lexsort((names, -both), axis=1)[:, :2]
                    score[rows], found[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
                    compared[rows] += len(members)
        return score, found, compared


def best_two(queries: DataFrame, protos: DataFrame) -> DataFrame:
    """id, label, score, place (1 and 2), compared: the two best prototypes(label, prototype) of each query(id, embedding)
    by cosine, 0 at least, ties by label; ``compared`` counts the prototypes that were measured for the query.

    Prototypes are grouped and sent to the tasks by ``MOST_PROTOTYPES``; each pass gives two rows a query and the best two
    of all passes are kept. Null or zero queries give no rows; an id that repeats is one query for each distinct vector.
    """
    blocks = max(1, -(-protos.count() // MOST_PROTOTYPES))
    id_type, label_type = queries.schema["id"].dataType.simpleString(), protos.schema["label"].dataType.simpleString()

    label_arrow = to_arrow_type(protos.schema["label"].dataType)

    def block(k: int) -> DataFrame:
        own = protos.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k).select("label", "prototype").collect()
        groups = Groups([r["label"] for r in own], np.array([r["prototype"] for r in own], dtype=float)) if own else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or groups is None:
                    continue
                x = _matrix(batch.column(1))
                usable = np.flatnonzero(np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)) if x.shape[1] == groups.vectors.shape[1] else np.array([], dtype=int)
                if not len(usable):
                    continue
                score, found, compared = groups.best_two(x[usable])
                rows, cols = np.nonzero(score >= 0)
                labels = [groups.labels[j] for j in found[rows, cols]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(usable[rows])), pa.array(labels, label_arrow), pa.array(score[rows, cols]), pa.array(compared[rows])], names=["id", "label", "score", "compared"])

        return queries.select("id", F.col("embedding").cast("array<double>").alias("e")).mapInArrow(run, f"id {id_type}, label {label_type}, score double, compared long")

    found = reduce(DataFrame.unionByName, map(block, range(blocks))).distinct()
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "label"))
    return found.withColumn("place", place).where("place <= 2")


def identify(best: DataFrame, least: float = 0.6, margin: float = 0.05) -> DataFrame:
    """The best label of each query of ``best_two``, if it is good enough and far enough from the second."""
    per = best.groupBy("id").agg(F.min_by("label", "place").alias("label"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    verdict = F.when(F.col("score") < least, "unknown").when(F.col("score") - F.coalesce("second", F.lit(0.0)) < margin, "ambiguous").otherwise("identified")
    return per.select("id", "label", "score", "second", verdict.alias("verdict"))


def consistency(samples: DataFrame) -> DataFrame:
    """label, n_pairs, mean_cosine, least_cosine, n_compared over the pairs of each label's samples(label, id, embedding),
    cosines 0 at least.

    Samples are dealt by their angle from the label's mean, and by hash, into blocks of about TILE. A tile of two blocks
    all of whose pairs are surely above 0, and above a pair that is known, adds the product of its sum vectors to the sum;
    only the other tiles are measured. ``n_compared`` counts the pairs in those. Voices of one speaker lie within a right
    angle, so that only tiles of outer samples are left; vectors that point everywhere leave all of them. Zero vectors are left out.
    """
    vectors = samples.select("label", "id", F.col("embedding").cast("array<double>").alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.withColumn("_n", size).where("_n > 0").select("label", "id", F.transform("e", lambda x: F.try_divide(x, F.col("_n"))).alias("u"))
    long = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    mean = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(dot("u", "m"), F.sqrt(dot("m", "m")))))
    angled = stored(unit.join(mean, "label").select("label", "id", "u", F.acos(F.coalesce(cos, F.lit(-1.0))).alias("angle")), "voice-angles")
    widest = angled.groupBy("label").agg(F.max("angle").alias("_w"))
    angled = angled.join(widest, "label").withColumn("band", F.least(F.lit(BANDS - 1), F.floor(F.coalesce(F.try_divide("angle", "_w"), F.lit(0.0)) * BANDS)).cast("int")).drop("_w")
    parts = angled.groupBy("label", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    filed = angled.join(parts, ["label", "band"]).select("label", "id", "u", "angle", (F.col("band") * 1_000_000 + F.pmod(F.xxhash64("id"), "parts")).cast("long").alias("block"))
    sums = filed.select("label", "block", F.posexplode("u").alias("i", "x")).groupBy("label", "block", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("label", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
    ends = filed.groupBy("label", "block").agg(F.count("*").alias("n"), F.max("angle").alias("far"), F.max_by("u", F.struct("angle", "id")).alias("u_far"))
    blocks = sums.join(ends, ["label", "block"])
    # a pair that is there: the farthest samples of the two outermost blocks, or of one block none
    two = F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("o"), "block", "u_far")))
    known = blocks.groupBy("label").agg(two.alias("t")).select("label", F.when(F.size("t") > 1, dot(F.get("t", F.lit(0))["u_far"], F.get("t", F.lit(1))["u_far"])).otherwise(1.0).alias("known"))
    a, b = blocks.select("label", *(F.col(c).alias(f"{c}_a") for c in ("block", "n", "far", "s"))), blocks.select("label", *(F.col(c).alias(f"{c}_b") for c in ("block", "n", "far", "s")))
    same = F.col("block_a") == F.col("block_b")
    tiles = a.join(b, "label").where("block_a <= block_b").join(known, "label")
    pairs = F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    total = F.when(same, (dot("s_a", "s_a") - F.col("n_a")) / 2).otherwise(dot("s_a", "s_b"))
    # the greatest angle in a tile; its cosine is a lower bound
    low = F.cos(F.least(F.lit(np.pi), F.col("far_a") + F.col("far_b"))) - SLACK
    tiles = tiles.select("label", "block_a", "block_b", pairs.alias("pairs"), total.alias("total"), ((low <= 0) | (low <= F.greatest(F.lit(0.0), "known"))).alias("open")).where("pairs > 0")
    shut = tiles.where("not open").select("label", "pairs", "total", F.lit(None).cast("double").alias("least"), F.lit(0).cast("long").alias("compared"))
    wanted = tiles.where("open").select("label", "block_a", "block_b")
    sides = [wanted.join(filed.select("label", F.col("block").alias(c), "id", "u"), ["label", c]).select("label", "block_a", "block_b", F.lit(c == "block_a").alias("row"), "id", "u") for c in ("block_a", "block_b")]

    def measure(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.stack(cell.loc[cell["row"] == side, "u"].to_list()) for side in (True, False))
        c = np.clip(x @ y.T, 0, 1)
        if key[1] == key[2]:  # both sides are the same samples, in whatever order: each pair twice, and each with itself
            ids = [cell.loc[cell["row"] == side, "id"].to_numpy() for side in (True, False)]
            c = (x[np.argsort(ids[0], kind="stable")] @ y[np.argsort(ids[1], kind="stable")].T).clip(0, 1)[np.triu_indices(len(x), 1)]
        return pd.DataFrame({"label": [key[0]], "pairs": [c.size], "total": [float(c.sum())], "least": [float(c.min())], "compared": [c.size]})

    kind = samples.schema["label"].dataType.simpleString()
    measured = reduce(DataFrame.unionByName, sides).groupBy("label", "block_a", "block_b").applyInPandas(measure, f"label {kind}, pairs long, total double, least double, compared long")
    both = shut.unionByName(measured).groupBy("label").agg(F.sum("pairs").alias("n_pairs"), F.sum("total").alias("t"), F.min("least").alias("least_cosine"), F.sum("compared").alias("n_compared"))
    return both.select("label", "n_pairs", (F.col("t") / F.col("n_pairs")).alias("mean_cosine"), "least_cosine", "n_compared")
