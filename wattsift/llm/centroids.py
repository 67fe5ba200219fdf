"""K-means rounds over integer vectors with annulus search, exact in every step.

Vectors are scaled and rounded down to integers; centroids are integer vectors.
In a round each task sorts the centroids by norm and looks for the one whose norm
is nearest to the vector's; the distance to it is an upper bound of the least
distance.  By the triangle inequality only centroids whose norms lie within that
bound of the vector's (its annulus) can be as near, so a binary search of both
ends gives a range of candidates, and only these are compared, exactly and with
ties on the boundary included.

Tasks send sums and counts for each centroid (combined by Spark), never vectors;
what reaches the driver are the centroids of a round.  Vectors are written once.

Defined results: vectors of another length, null ones and those with a null or
non-finite component, or with a component beyond 2**27 after scaling (squared
distances would pass 64 bits), are left out; among vectors of one vec_id the least
components come first as starting centroids, a null vec_id comes last; with fewer
vectors than centroids there are as many centroids as vectors; equal centroids
leave all but the first of them empty, and empty ones stay where they are;
repeated rows come out as often as they come in; an empty table gives an empty
result; an inertia beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components as large as this or larger in magnitude are left out.
LARGEST = 1 << 27
#: Up to this magnitude, products of 64 components are whole numbers below 2**53, so that floating point is exact.
EXACT_FLOAT = 1 << 22


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that are kept, written to the shared folder."""
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(scaled(x)) & (F.abs(scaled(x)) < F.lit(float(LARGEST))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("x"))
    kept = rows.filter((F.size("x") == dimensions) & F.coalesce(usable, F.lit(False)))
    return materialize(kept.select("vec_id", F.transform("x", lambda x: F.floor(scaled(x)).cast("int")).alias("v")), "vectors")


def starting_centroids(rows: DataFrame, centroids: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(centroids).collect()
    return np.array([r["v"] for r in first], np.int64)


class Annulus:
    """Nearest centroids by norm: ``assign`` gives (number, squared distance) of each vector, the smaller number on ties."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids.astype(np.int64) ** 2).sum(axis=1)
        self.order = np.argsort(squares, kind="stable")
        self.sorted, self.squares = centroids[self.order].astype(np.int64), squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.compared = 0

    def _products(self, x: np.ndarray, at: int) -> np.ndarray:
        c = self.sorted[at]
        if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_FLOAT:
            return (x.astype(np.float64) @ c.astype(np.float64)).astype(np.int64)
        return (x * c).sum(axis=1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (x * x).sum(axis=1)
        norm = np.sqrt(own.astype(np.float64))
        # the centroid with the nearest norm bounds the distance from above
        right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
        left = right - 1
        right = np.minimum(right, len(self.norms) - 1)
        near = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        bound = np.empty(len(x), np.int64)
        for at in np.unique(near):
            i = np.flatnonzero(near == at)
            bound[i] = own[i] - 2 * self._products(x[i], at) + self.squares[at]
        # the margin covers the rounding of the roots, so that no centroid on the boundary is lost
        reach = np.sqrt(bound.astype(np.float64)) * (1 + 1e-12) + norm * 1e-12 + 1e-6
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.order), np.int64)
        for at in range(len(self.order)):
            i = np.flatnonzero((low <= at) & (at < high))
            if not len(i):
                continue
            self.compared += len(i)
            d = own[i] - 2 * self._products(x[i], at) + self.squares[at]
            wins = (d < best[i]) | ((d == best[i]) & (self.order[at] < number[i]))
            best[i[wins]], number[i[wins]] = d[wins], self.order[at]
        return number, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _sums(centroids: np.ndarray):
    def of(batches):
        ring, n, sums = Annulus(centroids), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in slices(batches, 4096):
            if batch.num_rows:
                x = _matrix(batch)
                number, _ = ring.assign(x)
                n += np.bincount(number, minlength=len(n))
                order = np.argsort(number, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])
                sums[number[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        k, dims = np.flatnonzero(n), centroids.shape[1]
        for i in k:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims + 1, i, np.int32)), pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(np.r_[n[i], sums[i]])], ["cluster", "dim", "total"])

    return of


def _assigned(centroids: np.ndarray):
    def of(batches):
        ring = Annulus(centroids)
        for batch in slices(batches, 4096):
            if batch.num_rows:
                number, distance = ring.assign(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return of


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the exact floor of each cluster's mean; empty clusters stay."""
    sums = rows.mapInArrow(_sums(centroids), "cluster int, dim int, total long")
    totals = sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # centroids times dimensions
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in totals}
    return np.array([[found[i, d] // found[i, -1] for d in range(centroids.shape[1])] if (i, -1) in found else own for i, own in enumerate(centroids)], np.int64)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row for each kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, dimensions, scale)
    at = starting_centroids(rows, centroids, seed)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        at = next_centroids(rows, at)
    found = materialize(rows.mapInArrow(_assigned(at), "vec_id long, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each centroid at most
    whole = sum(int(r["d"]) for r in sums)
    long = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    known = spark.createDataFrame([(r["cluster"], long(int(r["d"])), long(whole), digest[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """SQL for the rows of ``cluster_vectors`` on ``embeddings``."""
    usable = f"len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE * {SCALE}) < {LARGEST})) = {DIMENSIONS}"
    steps = []
    for k in range(ROUNDS + 1):
        pairs = f"SELECT x.r, x.vec_id, c.k, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i])))::BIGINT AS d FROM x, c{k} c"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, min((d, k)) AS m FROM ({pairs}) GROUP BY r)")
        if k < ROUNDS:
            means = "SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, CAST(floor(sum(e)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT a.m[2] AS k, unnest(x.v) AS e, unnest(range(1, 65)) AS i FROM a{0} a JOIN x USING (r)) GROUP BY k, i) GROUP BY k"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN ({means.format(k)}) n ON n.k = o.k)")
    final = f"a{ROUNDS}"
    return f"""
    WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(e::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings WHERE {usable}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM x ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v LIMIT {CENTROIDS}),
    {", ".join(steps)}
    SELECT vec_id, m[2]::INTEGER AS cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
    FROM {final} JOIN c{ROUNDS} c ON c.k = m[2]"""


SQL = _sql()
