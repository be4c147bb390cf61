"""Centroid clustering: rounds of exact integer means, vectors assigned by Orchard's search.

A round reads the kept vectors once; tasks send one row of sums a cluster, so that only clusters times
components numbers are shuffled and reach the driver. All arithmetic is on integers, so the result does
not depend on how rows lie in partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, prepare

CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
LARGEST = 1 << 27  # squared distances of WIDTH components up to this fit in 63 bits


class Orchard:
    """Nearest of some centroids, by walking lists of each centroid's neighbours from near to far."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        between = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], dtype=np.int64).reshape(len(centroids), -1)
        np.fill_diagonal(between, -1)
        self.lists = np.argsort(between, axis=1, kind="stable")[:, 1:]
        # beyond twice the distance: four times its square is exceeded strictly, written so that nothing overflows
        self.quarter = (between + 3) // 4

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, ties to the smaller number.

        All rows start at centroid 0 and walk their centroid's list; where a centroid is closer, its own
        list is next, from the start. A row is done where the list ends or goes strictly beyond twice the
        distance found: no centroid as close as the best lies there, by the triangle inequality.
        """
        n, k = len(x), len(self.centroids)
        best, number, at = ((x - self.centroids[0]) ** 2).sum(axis=1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        rows = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        while len(rows):
            other = self.lists[number[rows], at[rows]]
            near = self.quarter[number[rows], other] <= best[rows]
            rows, other = rows[near], other[near]
            at[rows] += 1
            new = ~visited[rows, other]
            seen, other = rows[new], other[new]
            visited[seen, other] = True
            distance = ((x[seen] - self.centroids[other]) ** 2).sum(axis=1)
            closer = (distance < best[seen]) | ((distance == best[seen]) & (other < number[seen]))
            moved = seen[closer]
            best[moved], number[moved], at[moved] = distance[closer], other[closer], 0
            rows = rows[at[rows] < k - 1]
        return number, best


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, width)


def _sums(centroids: np.ndarray):
    """One row of sums a cluster and task: number of vectors, sum of distances, sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard, (k, width) = Orchard(centroids), centroids.shape
        total = np.zeros((k, width + 2), np.int64)
        for batch in batches:
            x = _vectors(batch, width)
            number, distance = orchard.nearest(x)
            np.add.at(total, number, np.column_stack([np.ones(len(x), np.int64), distance, x]))
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    return run


def _totals(rows: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    parts = rows.mapInArrow(_sums(centroids), "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("at", "v"))
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum("v").alias("v")).orderBy("cluster", "at").collect():
        out.setdefault(r["cluster"], []).append(r["v"])
    return out


def _assigned(centroids: np.ndarray, totals: dict[int, list[int]]):
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = [totals[c][1] if c in totals else 0 for c in range(len(centroids))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard, of_cluster, digest = Orchard(centroids), np.array(inertia, dtype=np.int64), np.array(digests, dtype=object)
        for batch in batches:
            number, distance = orchard.nearest(_vectors(batch, centroids.shape[1]))
            columns = [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance), pa.array(of_cluster[number]), pa.array(np.full(len(number), sum(inertia))), pa.array(digest[number], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def whole(v: Column, width: int) -> Column:
    """Whether a vector has exactly that many components, none null or not finite."""
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return F.coalesce((F.size(v) == width) & ~bad, F.lit(False))


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of the given width.

    vectors: vec_id and embedding; other columns are ignored. Components become floor(scale * x); vectors
    of other widths, null ones and those with null or non-finite components are left out. The first
    centroids are the k vectors with the least sha256 of seed:vec_id; rows that repeat a vec_id go by
    their components, null ids come last. With fewer than k vectors there are as many centroids. A
    cluster without vectors keeps its centroid. Repeated rows count each time. No vectors, no rows.
    A component beyond 2**27 after scaling raises an error, as squared distances would not fit in 63
    bits. Each task holds the k * k distances between centroids, so k is meant to stay below some thousands.
    """
    scratch = Scratch(prepare(vectors.sparkSession), "clusters")
    scaled = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("bigint"))
    fits = F.when(F.exists("x", lambda e: (e > LARGEST) | (e < -LARGEST)), F.raise_error(F.lit("a scaled component is beyond 2**27"))).otherwise(F.col("x"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(whole(F.col("embedding"), width)).select("vec_id", scaled.alias("x"))
    rows = scratch.keep(rows.select("vec_id", fits.alias("x")))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("x", named.alias("name")).orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return rows.mapInArrow(lambda batches: iter(()), _OUT)
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, _, *sums) in _totals(rows, centroids).items():
            moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    return rows.mapInArrow(_assigned(centroids, _totals(rows, centroids)), _OUT)


_OUT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """clusters of embeddings: 8 centroids, 10 rounds, 64 components. Nulls, ties, repeats and empty tables as there."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int, rounds: int, width: int, scale: int, seed: str) -> str:
    """Every vector against every centroid, a round after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT v.n, min({{'d': CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c.c}}) AS m FROM v, c{i} c GROUP BY v.n)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, list(CAST((s - (s % k + k) % k) // k AS BIGINT) ORDER BY p) AS x
  FROM (SELECT d.m.c AS c, p, sum(v.x[p]) AS s, count(*) AS k FROM d{i} d JOIN v USING (n), generate_series(1, {width}) g(p) GROUP BY ALL) GROUP BY c
  UNION ALL SELECT c, x FROM c{i} WHERE c NOT IN (SELECT m.c FROM d{i}))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k})),
{", ".join(steps[:-1])}
SELECT v.vec_id, CAST(d.m.c AS INT) AS cluster, d.m.d AS distance, CAST(sum(d.m.d) OVER (PARTITION BY d.m.c) AS BIGINT) AS cluster_inertia, CAST(sum(d.m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN d{rounds} d USING (n) JOIN c{rounds} c ON c.c = d.m.c
"""


OP11_SQL = _sql(CLUSTERS, ROUNDS, WIDTH, SCALE, "3")
