"""Centroid clustering in integers, with PCA-rotated filtering.

A vector's components become integers floor(scale * x). The covariance of all vectors (a matrix of components squared,
summed in the cluster) gives a rotation; a vector is stored once, with its integers, its LEAD leading rotated coordinates
and the norm of what is left. For a vector v and a centroid c

    |v - c|^2 >= |lead(v) - lead(c)|^2 + (rest(v) - rest(c))^2

by the triangle inequality in the residual space. The centroid of the least bound is measured in integers first; of the
others only those whose bound, less a margin for rounding, is not above that distance are measured too. What decides is
thus exact, whatever the rotation. A round reads the stored vectors, and a task returns for each centroid one row of sums
and a count, so that a cluster with any share of the vectors moves a few rows; the driver sees k rows a round. Centroids
are carried as exact integers; the rounds are jobs on a written table, so that a lost executor repeats its tasks only.

Defined results: vectors that are null, have another number of components or a null or non-finite one are left out;
repeated rows are kept each, with ties of the seeds broken by the components; a null vec_id keeps its row and comes last
among the seeds; fewer vectors than k give fewer centroids; an empty cluster keeps its centroid; an empty table gives no
rows; other columns are not read. Integers beyond LARGEST would give distances that no long holds: they raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rotated coordinates that are stored; the largest integer whose squared distances fit a long for 64 components or fewer.
LEAD, LARGEST = 16, 1 << 27


def whole_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, ints of the vectors that are complete and finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size(v) == size) & finite)
    large = F.exists(v, lambda x: F.abs(F.floor(x * scale)) > LARGEST)
    ints = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    return rows.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}"))).otherwise(ints).alias("ints"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def rotation(ints: DataFrame, size: int, lead: int) -> np.ndarray:
    """The lead axes of greatest variance, (size, lead). Any orthonormal axes give right results, these filter best."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0), size).astype(np.float64)
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        for i in range(size if n else 0):
            yield pa.RecordBatch.from_pydict({"i": [i], "n": [n], "s": [float(total[i])], "row": [square[i].tolist()]}, pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("row", pa.list_(pa.float64()))]))

    rows = ints.select("ints").mapInArrow(moments, "i int, n long, s double, row array<double>")
    rows = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*(F.sum(F.col("row")[j]) for j in range(size))).alias("row")).orderBy("i").collect()
    if not rows:
        return np.eye(size)[:, :lead]
    mean = np.array([r["s"] / r["n"] for r in rows])
    cov = np.array([r["row"] for r in rows]) / rows[0]["n"] - np.outer(mean, mean)
    return np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1][:, :lead]


def rotated(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    lead = x @ axes
    return lead, np.sqrt(np.maximum((x * x).sum(axis=1) - (lead * lead).sum(axis=1), 0))


def with_bounds(ints: DataFrame, axes: np.ndarray) -> DataFrame:
    """vec_id, ints, lead, rest."""
    size, lead = axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords, rest = rotated(_matrix(batch.column(1), size).astype(np.float64), axes)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(coords) + 1, dtype=np.int32) * lead), pa.array(coords.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(rest)], names=["vec_id", "ints", "lead", "rest"])

    return ints.mapInArrow(run, "vec_id long, ints array<int>, lead array<double>, rest double")


class Nearest:
    """Nearest centroid by bounds, then integers; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]], axes: np.ndarray):
        self.exact = np.array(centroids, dtype=np.int64)
        self.lead, self.rest = rotated(self.exact.astype(np.float64), axes)

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, (vectors, centroids), a little less than exact arithmetic would give."""
        low = np.stack([((lead - c) ** 2).sum(axis=1) + (rest - r) ** 2 for c, r in zip(self.lead, self.rest, strict=True)], axis=1)
        size = (lead * lead).sum(axis=1) + rest * rest
        top = (self.lead * self.lead).sum(axis=1).max() + (self.rest * self.rest).max()
        # rest is the root of a difference: an error of 1e-15 times the squared norm can become one of its root
        slack = 1e-6 * (size + top)[:, None] + 1.0
        return low - slack

    def find(self, ints: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each vector, and how many distances were measured."""
        low = self.bounds(lead, rest)
        cluster = low.argmin(axis=1)
        first = cluster.copy()
        best = ((ints - self.exact[cluster]) ** 2).sum(axis=1)
        measured = len(ints)
        for c in range(len(self.exact)):
            left = np.flatnonzero((low[:, c] <= best) & (first != c))
            d = ((ints[left] - self.exact[c]) ** 2).sum(axis=1)
            closer = (d < best[left]) | (d == best[left]) & (c < cluster[left])
            cluster[left[closer]], best[left[closer]] = c, d[closer]
            measured += len(left)
        return cluster, best, measured


def _batches(batches: Iterator[pa.RecordBatch], size: int, lead: int):
    for batch in batches:
        if batch.num_rows:
            yield batch, _matrix(batch.column(1), size).astype(np.int64), _matrix(batch.column(2), lead), batch.column(3).to_numpy()


def recentred(table: DataFrame, centroids: list[list[int]], axes: np.ndarray) -> list[list[int]]:
    """The centroids after one round."""
    size, lead = axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, k = Nearest(centroids, axes), len(centroids)
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for _, ints, coords, rest in _batches(batches, size, lead):
            cluster = nearest.find(ints, coords, rest)[0]
            n += np.bincount(cluster, minlength=k)
            for c in range(k):
                sums[c] += ints[cluster == c].sum(axis=0)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], names=["c", "n", "sums"])

    parts = table.mapInArrow(run, "c long, n long, sums array<long>")
    exact = F.array(*(F.sum(F.col("sums")[j].cast("decimal(20,0)")) for j in range(size)))
    found = {r["c"]: [int(s) // r["n"] for s in r["sums"]] for r in parts.groupBy("c").agg(F.sum("n").alias("n"), exact.alias("sums")).collect()}
    return [found.get(c, old) for c, old in enumerate(centroids)]


def seeds(ints: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of least sha256 of salt:vec_id."""
    mark = F.sha2(F.concat_ws(":", F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = ints.select(F.when(F.col("vec_id").isNotNull(), mark).alias("mark"), "ints").orderBy(F.col("mark").asc_nulls_last(), "ints").limit(k)
    return [r["ints"] for r in rows.collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3", lead: int = LEAD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, measured (distances of its batch that were measured, a vector), cluster_inertia, inertia,
    centroid (integers) for every whole vector. ``size`` is 64 at most."""
    ints = stored(whole_vectors(vectors, size, scale, id_col, vector_col), "centroids-ints")
    centroids = seeds(ints, k, salt)
    if not centroids:
        return ints.select("vec_id", *(F.lit(0).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("measured", "double"), ("cluster_inertia", "long"), ("inertia", "long"))), F.col("ints").alias("centroid"))
    axes = rotation(ints, size, lead)
    table = stored(with_bounds(ints, axes), "centroids-rotated")
    for _ in range(rounds):
        centroids, before = recentred(table, centroids, axes), centroids
        if centroids == before:  # every further round would give the same
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, axes)
        for batch, ints, coords, rest in _batches(batches, size, lead):
            found, distance, measured = nearest.find(ints, coords, rest)
            share = np.full(len(found), measured / len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32)), pa.array(distance), pa.array(share)], names=["vec_id", "cluster", "distance", "measured"])

    rows = stored(table.mapInArrow(run, "vec_id long, cluster int, distance long, measured double"), "centroids-assigned")
    sums = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    # k rows: the centroids, which the driver holds anyway
    of = rows.sparkSession.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), centroid) for c, centroid in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "measured", "cluster_inertia", "inertia", "centroid")


def digest():
    """sha256 of a centroid's integers, joined by commas."""
    return F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)


def oracle_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """The same in SQL, without bounds: a statement for each round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) <= {k})",
    ]
    square = "list_sum(list_transform(list_zip(kept.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT kept.vec_id, kept.v, m.c, CAST({square} AS BIGINT) AS d FROM kept CROSS JOIN c{i} m QUALIFY row_number() OVER (PARTITION BY kept.vec_id ORDER BY d, m.c) = 1)")
        if i < rounds:
            mean = "(s - ((s % n) + n) % n) // n"  # floor, also below zero
            steps.append(f"s{i} AS (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {size + 1})) AS j) GROUP BY c, j)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(CAST({mean} AS BIGINT) ORDER BY j) AS v FROM s{i} GROUP BY c) m ON o.c = m.c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c"""
