"""Operator 11: centroid clustering by a bisector tournament.

Vectors become integers, floor(scale * x), and so are the centroids, so every comparison is exact.
For centroids a < b the plane between them is 2 x.(b - a) = |b|^2 - |a|^2; normals and thresholds of all
pairs are laid out once a round. A vector's champion meets the next centroid in k - 1 sign tests: a
positive side takes the later one, zero leaves the smaller number. Only the last champion's distance
is worked out. A task hands on sums by cluster and component, so a round shuffles k x components rows a task
and the driver holds the k centroids alone.

A batch is computed in doubles where the bounds of its products prove them exact (below 2^53), in 64-bit
integers where these hold, and in Python's integers beyond.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

LONG = 1 << 63


def grid(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: as doubles that hold integers, or Python's integers beyond 2^53."""
    with np.errstate(over="ignore"):
        low = np.floor(values * scale)
    if not low.size or np.abs(low).max() < 2.0**53:
        return low
    whole = [math.floor(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


class Bisectors:
    """The centroids (lists of integers) with the normals and thresholds of their pairs."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=object)
        self.largest = max((abs(x) for row in centroids for x in row), default=0)
        self._as: dict = {}

    def planes(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids, normals[a, b] = 2 (b - a) and thresholds[a, b] = |b|^2 - |a|^2 in numbers of a kind."""
        if kind not in self._as:
            c = self.centroids.astype(kind)
            square = (c * c).sum(axis=1)
            self._as[kind] = (c, 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None])
        return self._as[kind]

    def kind(self, largest: int, width: int):
        """The cheapest numbers in which sign tests and distances of such components are exact."""
        bound = 4 * width * max(largest, self.largest, 1) ** 2 * 4
        return np.float64 if bound < 1 << 53 else np.int64 if bound < LONG else object

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid and its squared distance."""
        largest = int(np.abs(rows).max()) if rows.size else 0
        kind = self.kind(largest, rows.shape[1])
        rows = rows.astype(kind)
        c, normals, thresholds = self.planes(kind)
        champion = np.zeros(len(rows), np.int64)
        dot = (lambda a, b: (a * b).sum(axis=1)) if kind is object else (lambda a, b: np.einsum("ij,ij->i", a, b))
        for challenger in range(1, len(c)):
            side = dot(rows, normals[champion, challenger]) - thresholds[champion, challenger]
            champion[(side > 0).astype(bool)] = challenger
        apart = rows - c[champion]
        return champion, dot(apart, apart)


def _batches(batches: Iterator[pa.RecordBatch], scale: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield batch, grid(values.reshape(-1, width), scale)


def usable(vectors: DataFrame, width: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``width`` components, none null or non-finite."""
    finite = f"size(v) = {width} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(finite)


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    seed: int = 2,
    width: int = 64,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable vector, and the final centroids.

    Centroids start as the k vectors with the least sha256 of ``seed:id``; of equal hashes (an id that is
    repeated) the lesser vector comes first. Each round assigns all vectors, ties to the smaller number, and
    replaces every centroid that has vectors by floor(sum / count); then vectors are assigned once more.
    Fewer vectors than k make as many centroids; none give an empty table. A null id starts no cluster but
    is assigned. Repeated rows count as often as they stand. Other columns are left out. A squared
    distance that no long holds is null; sums beyond 38 digits raise.
    """
    spark = vectors.sparkSession
    kept = staged(usable(vectors, width, id_col, vec_col), "cluster-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(order, "v").limit(k).select("v").collect()
    centroids = [[int(x) for x in grid(np.array(r.v, dtype=float), scale)] for r in first]
    out = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], out), centroids
    for _ in range(rounds):
        centroids = _moved(kept, Bisectors(centroids), scale, width)
    last = Bisectors(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _batches(batches, scale, width):
            won, far = last.assign(rows)
            far = [d if d < LONG else None for d in map(int, far.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(won, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, out), centroids


def _moved(kept: DataFrame, planes: Bisectors, scale: int, width: int) -> list[list[int]]:
    """The centroids after one round."""
    k = len(planes.centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), dtype=object), np.zeros(k, np.int64)
        for _, rows in _batches(batches, scale, width):
            won, _ = planes.assign(rows)
            order = np.argsort(won, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(won[order]) != 0))
            # a batch has fewer than 2^20 rows: below 2^33 its sums are exact integers of 64 bits
            whole = rows.astype(np.int64) if rows.dtype != object and np.abs(rows).max() < 2.0**33 else np.vectorize(int, otypes=[object])(rows)
            sums[won[order[starts]]] += np.add.reduceat(whole[order], starts, axis=0).astype(object)
            counts += np.bincount(won, minlength=k)
        used = np.flatnonzero(counts)
        where = np.repeat(used, width), np.tile(np.arange(width), len(used))
        total = pa.array([Decimal(int(x)) for x in sums[where]], pa.decimal128(38, 0))
        columns = [pa.array(where[0], pa.int32()), pa.array(where[1], pa.int32()), total, pa.array(counts[where[0]], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "at", "total", "n"])

    sums = kept.mapInArrow(partial, "cluster int, at int, total decimal(38,0), n long").groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = [[int(x) for x in row] for row in planes.centroids]
    for r in sums.collect():  # k x width numbers
        moved[r.cluster][r.at] = int(r.total) // r.n
    return moved


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    assigned, centroids = cluster(vectors)
    assigned = staged(assigned, "clusters")
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia")).collect()  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(int(r.cluster_inertia or 0) for r in each)
    fits = lambda x: x if x < LONG else None
    rows = [(r.cluster, fits(int(r.cluster_inertia or 0)), fits(whole), digest[r.cluster]) for r in each]
    by_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """The same by plain distances: every round is a pair of named tables."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        "x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v "
        "FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM x WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), v LIMIT {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT x.r, min({{'d': {apart}, 'c': c.c}}) AS best FROM x CROSS JOIN c{n} c GROUP BY x.r)")
        if n < rounds:
            steps.append(
                f"s{n} AS MATERIALIZED (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT a.best.c AS c, unnest(range(1, 65)) AS i, unnest(x.v) AS e FROM x JOIN a{n} a ON x.r = a.r) GROUP BY c, i), "
                f"m{n} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c), "
                f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON c.c = m.c)"
            )
    return f"""WITH {", ".join(steps)}
SELECT x.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
  CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM x JOIN a{rounds} a ON x.r = a.r JOIN c{rounds} c ON c.c = a.best.c"""


OP11_SQL = _op11_sql()
