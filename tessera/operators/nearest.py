"""Exact nearest neighbours of many queries: blocks of rows around centres, and bounds that spare most of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut
from tessera.operators.rows import first_per_key

#: Centres, chosen by hash; rows of a block, and queries that meet a block at once.
CENTRES, ROWS, QUERIES = 64, 4096, 1024
#: Scores are told apart to six decimals, so bounds give way by this much.
SLACK = 2e-6


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, or 0 where they have none."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _far(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of units to centres."""
    gap = (units * units).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * units @ centres.T
    return np.sqrt(np.maximum(gap, 0.0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _blocks(rows: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """Blocks of at most ROWS rows of one partition and one centre: cell, lo and hi (their distances to it), keys and vectors."""
    width = centres.shape[1]
    kind = rows.schema[key].dataType.simpleString()

    def block(cell: int, held: list) -> pa.RecordBatch:
        keys, vectors, far = (np.concatenate(x) for x in zip(*held, strict=True))
        columns = [pa.array([cell], pa.int32()), pa.array([far.min()]), pa.array([far.max()]), pa.array([keys.tolist()]), pa.array([vectors.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "lo", "hi", "keys", "vectors"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            keys = np.empty(len(vectors), object)
            keys[:] = batch.column(0).to_pylist()
            far = _far(_units(vectors), centres)
            home = far.argmin(axis=1)
            for cell in np.unique(home).tolist():
                at = np.flatnonzero(home == cell)
                for lo in range(0, len(at), ROWS):
                    part = at[lo : lo + ROWS]
                    if size.get(cell, 0) + len(part) > ROWS:
                        yield block(cell, held.pop(cell))
                        size[cell] = 0
                    held.setdefault(cell, []).append((keys[part], vectors[part], far[part, cell]))
                    size[cell] = size.get(cell, 0) + len(part)
        for cell, parts in held.items():
            yield block(cell, parts)

    chosen = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("v"))
    return chosen.mapInArrow(run, f"cell int, lo double, hi double, keys array<{kind}>, vectors binary")


def _scored(work: DataFrame, width: int, k: int, kind: str, asked: str) -> DataFrame:
    """(query_id, k, s) of rows (keys, vectors, qids, qvecs): of each query the k best rows of the block, itself left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, ids = batch.column("keys")[r].as_py(), batch.column("qids")[r].as_py()
                rows = np.frombuffer(batch.column("vectors")[r].as_py(), np.float64).reshape(-1, width)
                queries = _matrix(batch.column("qvecs")[r].values, width)
                lengths = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)
                scores = np.divide(rows @ queries.T, lengths, out=np.zeros((len(rows), len(queries))), where=lengths > 0)
                out: list[tuple] = []
                for q, own in enumerate(ids):
                    s = scores[:, q]
                    least = np.partition(s, -k - 1)[-k - 1] - SLACK if len(s) > k + 1 else -np.inf
                    best = sorted((-round(float(s[i]), 6), keys[i], float(s[i])) for i in np.flatnonzero(s >= least) if keys[i] != own)[:k]
                    out += [(own, key, value) for _, key, value in best]
                if out:
                    found = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(next(found), batch.schema.field("qids").type.value_type), pa.array(next(found), batch.schema.field("keys").type.value_type), pa.array(next(found), pa.float64())], names=["query_id", "k", "s"])

    return work.select("keys", "vectors", "qids", "qvecs").mapInArrow(run, f"query_id {asked}, k {kind}, s double")


def _met(pairs: DataFrame, blocks: DataFrame, queries: DataFrame, slots: int) -> DataFrame:
    """Pairs (block, query_id) as rows of _scored(): the queries of a block in groups of about QUERIES."""
    slot = F.pmod(F.xxhash64("query_id"), F.lit(slots))
    grouped = pairs.join(queries, "query_id").groupBy("block", slot.alias("slot")).agg(F.sort_array(F.collect_list(F.struct("query_id", "u"))).alias("qs"))
    return grouped.select("block", F.col("qs.query_id").alias("qids"), F.col("qs.u").alias("qvecs")).join(blocks.select("block", "keys", "vectors"), "block")


def reached(cells: DataFrame, edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """(block, query_id) that may hold one of a query's k best, its own cell left out.

    cells: (query_id, cell, d), the distances to all centres; edges: (block, cell, lo, hi); bounds: (query_id, home, s), the k-th
    score so far, null if there are fewer. A row of the block is at least max(d - hi, lo - d) away, and a cosine is at
    most 1 less half of the squared distance.
    """
    away = F.greatest(F.lit(0.0), F.col("d") - F.col("hi"), F.col("lo") - F.col("d"))
    may = F.col("s").isNull() | (1 - away * away / 2 >= F.col("s") - SLACK)
    return cells.join(bounds, "query_id").where("cell <> home").join(edges, "cell").where(may).select("block", "query_id")


def nearest_many(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query_id, key, score): for every query (query_id, vector) its k nearest rows by cosine, itself left out.

    Exact. Null vectors take no part, vectors without length score 0; ties at six decimals go to the smaller key. All
    vectors must be of one width. Rows lie in blocks around CENTRES vectors. A query first meets the blocks of its own centre; the k-th
    score found there and the triangle inequality then rule out most others. No pair of a row and a query is a row of
    any table: a block and a group of queries meet as matrices, and give k rows a query. Jobs run while this is called.
    """
    spark = rows.sparkSession
    held, wanted = rows.where(F.col(vector).isNotNull()).select(key, vector), queries.where(F.col(vector).isNotNull()).select("query_id", vector)
    kind, asked = rows.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    picked = held.select(F.col(f"`{vector}`").cast("array<double>").alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(CENTRES).collect()  # bounded
    if not picked:
        return spark.createDataFrame([], f"query_id {asked}, `{key}` {kind}, score double")
    centres = np.unique(_units(np.array([r.v for r in picked])), axis=0)
    width = centres.shape[1]
    blocks = cut(_blocks(held, key, vector, centres)).withColumn("block", F.monotonically_increasing_id())
    edges = cut(blocks.select("block", "cell", "lo", "hi"))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            far = _far(_units(vectors), centres)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, len(centres)), pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(far.argmin(axis=1), pa.int32()), lists], names=["query_id", "u", "home", "far"])

    placed = cut(wanted.select("query_id", F.col(f"`{vector}`").alias("v")).mapInArrow(told, f"query_id {asked}, u binary, home int, far array<double>"))
    vectors = placed.select("query_id", "u")
    slots = max(1, -(-placed.count() // QUERIES))
    own = placed.select("query_id", F.col("home").alias("cell")).join(edges, "cell").select("block", "query_id")
    order = [F.desc(F.round("s", 6)), F.col("k")]
    first = cut(first_per_key(_scored(_met(own, blocks, vectors, slots), width, k, kind, asked), ["query_id"], order, k))
    worst = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("s")).alias("s"))
    bounds = placed.select("query_id", "home").join(worst, "query_id", "left")
    cells = placed.select("query_id", F.posexplode("far").alias("cell", "d"))
    more = _scored(_met(reached(cells, edges, bounds), blocks, vectors, slots), width, k, kind, asked)
    best = first_per_key(first.union(more), ["query_id"], order, k)
    return best.select("query_id", F.col("k").alias(key), F.round("s", 6).alias("score"))
