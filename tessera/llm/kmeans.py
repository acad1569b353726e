"""Lloyd's algorithm in whole numbers over distinct quantised vectors, each weighted by how many rows bear it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SCALE = 1024
#: Components below it in size have products of 64 components that are exact in doubles; larger ones are taken exactly, slower.
EXACT = 1 << 21
#: A vector that more than 1 in HEAVY of all rows bear is heavy: there are fewer than HEAVY of them, so they are broadcast.
HEAVY = 1000


def quantised(vectors: DataFrame, width: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q) of the vectors of exactly `width` components, none null or non-finite: q is floor(SCALE * x), x as double."""
    x = F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fits = F.coalesce((F.size("x") == width) & ~F.exists("x", bad), F.lit(False))
    # a component whose whole number is no 64-bit integer fails the job: no distance to it could be told
    whole = F.transform("x", lambda v: F.when(F.abs(v) >= float(1 << 52), F.raise_error(F.lit("a component is too large for whole distances"))).otherwise(F.floor(v * SCALE)).cast("bigint"))
    return vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x")).where(fits).select("vec_id", whole.alias("q"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and its squared distance, both exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        far = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    else:
        a, c = x.astype(object), centroids.astype(object)
        far = np.stack([((a - one) ** 2).sum(axis=1) for one in c], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, n, cluster, distance) of distinct vectors (q, n)."""
    width = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = nearest(_matrix(batch, width), centroids)
            found = [pa.array(best, pa.int32()), pa.array([int(d) for d in far], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), *found], names=["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "q array<bigint>, n bigint, cluster int, distance bigint")


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every partition sums its vectors by cluster, times their multiplicities, and Spark adds the sums up.

    At most clusters * (width + 1) numbers come back to the driver.
    """
    clusters, width = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, width + 1), object)  # integers of any size
        for batch in batches:
            x, n = _matrix(batch, width), batch.column("n").to_numpy()
            best, _ = nearest(x, centroids)
            small = np.abs(x).max(initial=0) * float(n.sum()) < 1 << 62
            weighted = np.column_stack((x, np.ones(len(x), np.int64))).astype(np.int64 if small else object) * n[:, None]
            for c in np.unique(best):
                sums[c] += weighted[best == c].sum(axis=0)
        c, d = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array([str(s) for s in sums[c, d]], pa.string())], names=["c", "d", "s"])

    total = np.zeros((clusters, width + 1), object)
    parts = distinct.mapInArrow(run, "c int, d int, s string")
    for r in parts.groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        total[r.c, r.d] = int(r.s)
    moved = centroids.copy()
    for c in range(clusters):
        if total[c, width]:
            moved[c] = [s // total[c, width] for s in total[c, :width]]
    return moved


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors are those of quantised(). Centroids start as the vectors of the least sha256 of `seed:vec_id`, ties by the
    vector; with fewer vectors there are fewer clusters. Each round assigns the distinct vectors and moves every
    non-empty centroid to the floor of its mean; it ends early once nothing moves. Assignments are joined back to the
    rows, repeated ones included. A row without a vec_id takes part, but is no start. Other columns are not read, so
    their names cannot clash. An empty table gives no rows. Distances and sums that are no long fail the job. The
    rounds run while this is called.

    Equal vectors are counted before they are shuffled, so a vector of many rows is one row of every round; it is
    joined back by a broadcast, and the others, none of which is hot, by a shuffle.
    """
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, width, vec_id, embedding))
    distinct = cut(rows.groupBy("q").agg(F.count("*").alias("n")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(hashed.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()
    shape = "vec_id " + rows.schema["vec_id"].dataType.simpleString() + ", cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], shape)
    centroids = np.array([r.q for r in first], np.int64)
    for _ in range(rounds):
        moved = _moved(distinct, centroids)
        if (moved == centroids).all():
            break
        centroids = moved

    found = cut(assigned(distinct, centroids))
    exact = (F.col("n").cast("decimal(38,0)") * F.col("distance")).cast("decimal(38,0)")
    inertia = {r.cluster: r for r in found.groupBy("cluster").agg(F.sum(exact).alias("s"), F.sum("n").alias("n")).collect()}
    total, count = sum(int(r.s) for r in inertia.values()), sum(r.n for r in inertia.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, int(r.s), total, sha[c]) for c, r in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")

    heavy = F.broadcast(found.where(F.col("n") > count / HEAVY).drop("n"))
    light = found.where(F.col("n") <= count / HEAVY).drop("n")
    joined = rows.join(heavy, "q").union(rows.join(heavy, "q", "left_anti").join(light, "q"))
    return joined.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
