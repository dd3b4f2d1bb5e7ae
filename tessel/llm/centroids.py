"""Centroid clustering in integers, each vector placed by a tournament of bisectors.

Components become integers, floor(scale * x). Of two centroids a < b, b is nearer to x exactly where
x . 2(b - a) > |b|^2 - |a|^2: an integer normal and an integer threshold, made once a round for each
pair. A vector meets the centroids in order of their numbers: what has won so far against the next,
k - 1 sign tests of one product each; zero keeps the smaller number. Nearness is transitive, so the last
winner is the nearest centroid with the smallest number, and its distance is computed exactly.

Each round is one pass over the vectors in Arrow batches: a task adds its vectors up by cluster and
emits its sums, k * (dims + 2) rows at most; Spark adds those up, and k centroids come to the driver, whatever the input's size.
Tasks take the largest cluster like any other, since nothing is dealt by cluster. A round that moves no
centroid ends the rounds, as all further ones would give the same.

Exactness: with components of up to M, a test is below 384 * dims / 64 * M^2; where that is under 2^53
products run in doubles without rounding, else in 64-bit integers, up to M = REACH (for 64 components).
A vector beyond it has no distance that a long holds in general: the job stops with a ValueError.

Defined results: vectors that are null, of another length, or have a null or non-finite component aren't
kept; repeated rows count each; a null id is as good as any, but starts no cluster while others are
there; equal ids start in order of their components; fewer vectors than k give as many centroids; no
vectors give no rows; only the id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3"
MOST_K = 256  # normals of all pairs are held by every task: 256 * 255 / 2 * 64 * 8 bytes = 17 MB
REACH = 1 << 27  # 256 * REACH^2 < 2^63
AT_ONCE = 4096


def kept_integers(column: pa.Array, dims: int = DIMS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept vectors in a list column, and their components as integers (int64, a row for each)."""
    column = column.cast(pa.list_(pa.float64()))
    starts = np.asarray(column.offsets, dtype=np.int64)
    full = (np.diff(starts) == dims) & np.asarray(column.is_valid())
    at = np.flatnonzero(full)
    if not len(at):
        return at, np.zeros((0, dims), np.int64)
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    x = values[starts[at][:, None] + np.arange(dims)]
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[fine])
    if x.size and np.abs(x).max() > REACH:
        raise ValueError(f"a component is beyond {REACH} / {scale}: distances would leave the range of a long")
    return at[fine], x.astype(np.int64)


class Bisectors:
    """Normals and thresholds of all pairs of centroids (k, dims; int64)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        a, b = np.triu_indices(k, 1)
        self.place = np.zeros((k, k), np.int64)
        self.place[a, b] = np.arange(len(a))
        self.normals = 2 * (centroids[b] - centroids[a])
        squares = (centroids * centroids).sum(axis=1)
        self.thresholds = squares[b] - squares[a]
        self.exact_in_doubles = lambda most: 6 * centroids.shape[1] * max(most, 1) ** 2 < 1 << 53

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's nearest centroid."""
        best = np.zeros(len(x), np.int64)
        if not len(x):
            return best
        most = max(int(np.abs(x).max()), int(np.abs(self.centroids).max()))
        kind = np.float64 if self.exact_in_doubles(most) else np.int64
        x, normals, thresholds = x.astype(kind), self.normals.astype(kind), self.thresholds.astype(kind)
        for rival in range(1, len(self.centroids)):
            pair = self.place[best, rival]
            best[np.einsum("nd,nd->n", x, normals[pair]) > thresholds[pair]] = rival
        return best

    def distances(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[best]
        return np.einsum("nd,nd->n", gap, gap)


def _integers(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            places, x = kept_integers(pa.concat_arrays([part.column("v")]), dims, scale)  # a copy has offsets from 0
            if len(places):
                yield part, places, x


def _first(vectors: DataFrame, k: int, dims: int, scale: int, seed: str) -> np.ndarray:
    """The k kept vectors of least hash: a row limit that each task applies first, k rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, places, x in _integers(batches, dims, scale):
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(places)), pa.array(list(x), pa.list_(pa.int64()))], ["id", "x"])

    # hashes of all ids, integers of the k chosen alone: vectors are read once for `finite`, and no wide row is sorted
    fits = (F.size("v") == dims) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = vectors.where(fits).withColumn("h", hashed).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    rows = chosen.select("h", "id", "v").mapInArrow(run, "id long, x array<long>").collect()
    order = lambda r: (r["id"] is None, hashlib.sha256(f"{seed}:{r['id']}".encode()).hexdigest(), r["x"])
    return np.array([r["x"] for r in sorted(rows, key=order)], np.int64).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that isn't empty: vectors, summed distance, summed components. k * (dims + 2) rows at most come to the driver."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        count, spread, total = np.zeros(k, object), np.zeros(k, object), np.zeros((k, dims), object)
        for _, _, x in _integers(batches, dims, scale):
            best = bisectors.nearest(x)
            far = bisectors.distances(x, best)
            for c in np.unique(best):
                mine = best == c
                count[c] += int(mine.sum())
                spread[c] += sum(far[mine].tolist())
                total[c] += x[mine].sum(axis=0).astype(object)  # AT_ONCE * REACH fits a long
        whole = np.column_stack([count, spread, total])
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_pydict({"cluster": np.repeat(full, dims + 2), "place": np.tile(np.arange(dims + 2), len(full)), "added": [Decimal(v) for v in whole[full].ravel()]}, schema=kinds)

    schema = "cluster int, place int, added decimal(38,0)"  # a task's sums may pass a long
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    found: dict[int, list[int]] = {}
    for r in vectors.select("v").mapInArrow(run, schema).groupBy("cluster", "place").agg(F.sum("added").alias("added")).collect():
        found.setdefault(r["cluster"], [0] * (dims + 2))[r["place"]] = int(r["added"])
    return {c: (v[0], v[1], v[2:]) for c, v in found.items()}


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> np.ndarray:
    """The centroids (k or fewer; dims) after `rounds` rounds over vectors(id, v)."""
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be from 1 to {MOST_K}")
    centroids = _first(vectors, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (n, _, total) in _sums(vectors, centroids, scale).items():
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance (squared) of every kept vector of vectors(id, v)."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        for part, places, x in _integers(batches, dims, scale) if len(centroids) else ():
            best = bisectors.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(places)), pa.array(best, pa.int32()), pa.array(bisectors.distances(x, best), pa.int64())], ["id", "cluster", "distance"])

    return vectors.select("id", "v").mapInArrow(run, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid (array) of every kept vector of vectors(id, v)."""
    centroids = fit(vectors, k, rounds, dims, scale, seed)
    spread = {c: s for c, (_, s, _) in _sums(vectors, centroids, scale).items()} if len(centroids) else {}
    rows = [(c, spread[c], sum(spread.values()), centroids[c].tolist()) for c in sorted(spread)]
    known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assign(vectors, centroids, scale).join(F.broadcast(known), "cluster")  # k rows at most


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = cluster(vectors)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = lambda n: f"""a{n} AS MATERIALIZED (SELECT vec_id, row_, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT vec_id, row_, v, cluster, CAST({far} AS BIGINT) AS d FROM kept, c{n}) GROUP BY ALL)"""  # noqa: E731
    mean = lambda n: f"""s{n} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS i FROM a{n - 1}) GROUP BY ALL),
c{n} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{n - 1} o LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY 1) m USING (cluster))"""  # noqa: E731
    steps = ",\n".join(f"{mean(n)},\n{near(n)}" for n in range(1, rounds + 1))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS cluster, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{near(0)},
{steps}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = _oracle()
