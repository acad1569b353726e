"""Exact top-k inner products by a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

SCALE = 1024
#: Rows in a block of the index, and the most queries in a block of queries: a task works on one of each (26 MB at a
#: width of 64). The index is sent once for every QUERIES queries, the queries once for every ROWS rows.
ROWS, QUERIES = 32_768, 16_384
#: Slices kept of the attributes, from the most significant; the rest of the bits decides only near the boundary.
SLICES = 6
#: Scores and components must be longs; sums that might be larger are worked out in integers of any size.
LONG = 1 << 63


def quantise(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices of the vectors that take part, and their components as floor(SCALE * x).

    A finite component whose quantised value is no long fails the job: it can't be scored, and it must not be lost.
    """
    kept, out = [], []
    for i, v in enumerate(vectors):
        if v is None or len(v) == 0 or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if not np.isfinite(x).all():
            continue
        with np.errstate(over="ignore"):
            x = np.floor(x * SCALE)
        if (np.abs(x) >= float(LONG)).any():
            raise OverflowError(f"a component of {np.abs(x).max() / SCALE:g} is too large for an integer score")
        kept.append(i)
        out.append(x.astype(np.int64))
    return np.array(kept, np.int64), out


def _by_width(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    kept, values = quantise(batch.column(1).to_pylist())
    ids = np.array(batch.column(0).to_pylist(), object)
    widths = np.array([len(v) for v in values])
    return {int(w): (ids[kept[widths == w]].astype(np.int64), np.array([v for v in values if len(v) == w])) for w in np.unique(widths)}


def build_index(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """Blocks of at most `rows` vectors of one width: width, n, ids, values (exact) and slices.

    In a block, component d of a row is stored as its offset from the least value of that component, cut to the
    SLICES most significant of `bits` bits; slices hold, for each component and bit, a bitmap over the rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for width, found in _by_width(batch).items():
                held.setdefault(width, []).append(found)
                while sum(len(f[0]) for f in held[width]) >= rows:
                    ids, values = (np.concatenate(x) for x in zip(*held[width], strict=True))
                    yield _block(ids[:rows], values[:rows])
                    held[width] = [(ids[rows:], values[rows:])]
        for found in held.values():
            ids, values = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(ids):
                yield _block(ids, values)

    chosen = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return chosen.mapInArrow(run, "width int, n int, bits int, ids binary, low binary, vals binary, slices binary")


def _block(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    low = values.min(axis=0)
    offsets = (values - low).astype(np.uint64)
    bits = max(1, int(offsets.max()).bit_length())
    words = -(-len(ids) // 64)
    kept = min(SLICES, bits)
    slices = np.zeros((values.shape[1], kept, words * 8), np.uint8)
    for s in range(kept):
        bit = ((offsets >> np.uint64(bits - kept + s)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(bit, axis=0, bitorder="little")
        slices[:, s, : packed.shape[0]] = packed.T
    columns = [[values.shape[1]], [len(ids)], [bits], [ids.tobytes()], [low.tobytes()], [values.tobytes()], [slices.tobytes()]]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["width", "n", "bits", "ids", "low", "vals", "slices"])


def _query_blocks(vectors: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, (ids, values) in _by_width(batch).items():
                for at in range(0, len(ids), size):
                    part = slice(at, at + size)
                    columns = [[width], [ids[part].tobytes()], [values[part].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["qwidth", "qids", "qvals"])

    return vectors.mapInArrow(run, "qwidth int, qids binary, qvals binary")


def add_slices(planes: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum, per row, of planes[i] << weights[i]: full adders on whole bitmaps, three planes into two."""
    by_weight: dict[int, list[np.ndarray]] = {}
    for w in np.unique(weights):
        by_weight[int(w)] = [planes[weights == w]]
    out, w, top = [], 0, int(weights.max(initial=-1))
    while w <= top or by_weight:
        stack = by_weight.pop(w, [])
        x = np.concatenate(stack) if stack else planes[:0]
        carries = []
        while len(x) > 1:
            n = len(x) // 3
            if n:
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                x = np.concatenate((odd ^ c, x[3 * n :]))
            else:
                carries.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
        out.append(x[0] if len(x) else np.zeros(planes.shape[1], np.uint64))
        if carries:
            by_weight[w + 1] = by_weight.pop(w + 1, []) + carries
        w += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_largest(total: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th largest sum (at least k rows are among), from the most significant slice downward."""
    above, level, value = np.zeros_like(among), among, 0
    for s in range(len(total) - 1, -1, -1):
        ones = level & total[s]
        if _count(above | ones) >= k:
            value |= 1 << s
            level = ones
        else:
            above, level = above | ones, level & ~total[s]
    return value


def at_least(total: list[np.ndarray], among: np.ndarray, value: int) -> np.ndarray:
    """Rows with a sum of at least value."""
    if value <= 0:
        return among
    if value >= 1 << len(total):
        return np.zeros_like(among)
    above, level = np.zeros_like(among), among
    for s in range(len(total) - 1, -1, -1):
        if value >> s & 1:
            level = level & total[s]
        else:
            above, level = above | (level & total[s]), level & ~total[s]
    return above | level


def search_block(ids, low, values, slices, bits: int, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's k best rows for a query: ids and scores, best first, ties to the smaller id.

    A negative weight is turned into a positive one on the complement of its component's slices. What the slices
    leave out of a score is between 0 and `rest`; all rows that may reach the k-th are then scored exactly.
    """
    size = [abs(x) for x in query.tolist()]
    reach = [max(abs(a), abs(b)) for a, b in zip(values.min(axis=0).tolist(), values.max(axis=0).tolist(), strict=True)]
    if sum(a * b for a, b in zip(size, reach, strict=True)) >= LONG or sum(size) >= LONG >> 1:
        return _search_large(ids, values, query_id, query, k)
    n, words = len(ids), slices.shape[2]
    among = np.zeros(words * 64, np.uint8)
    among[:n] = ids != query_id
    among = np.packbits(among, bitorder="little").view(np.uint64)
    rows = _count(among)
    if rows > k:
        kept = slices.shape[1]
        size = np.abs(query)
        height = max(1, int(size.max()).bit_length())
        has = (size[:, None] >> np.arange(height)) & 1
        d, j = np.nonzero(has)
        planes = slices[d]
        planes = np.where((query[d] < 0)[:, None, None], ~planes, planes)
        weights = (j[:, None] + np.arange(kept)).ravel()
        total = add_slices(planes.reshape(-1, words), weights) if len(d) else [np.zeros(words, np.uint64)]
        cut_bits = bits - kept
        rest = ((1 << cut_bits) - 1) * int(size.sum())
        least = kth_largest(total, among, k) - -(-rest >> cut_bits)
        among = at_least(total, among, least)
    at = np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little")[:n])
    scores = values[at] @ query
    best = np.lexsort((ids[at], -scores))[:k]
    return ids[at][best], scores[best]


def _search_large(ids, values, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As search_block, in integers of any size; a score among the best that is no long fails the job."""
    wide = query.tolist()
    scored = sorted((-sum(a * b for a, b in zip(row, wide, strict=True)), i) for i, row in zip(ids.tolist(), values.tolist(), strict=True) if i != query_id)[:k]
    if any(not -LONG <= -s < LONG for s, _ in scored):
        raise OverflowError(f"a score of query {query_id} is no 64-bit integer")
    return np.array([i for _, i in scored], np.int64), np.array([-s for s, _ in scored], np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, rows: int = ROWS, query_rows: int | None = None) -> DataFrame:
    """Per query the k rows of vectors with the highest inner product of components floor(1024 * x).

    Both have vec_id and embedding; a row is no candidate for queries of its own vec_id. Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id, and repeated rows stand as often as they occur. Vectors
    that are null or empty, hold null or non-finite components or lack a vec_id take no part; vectors of another
    width are no candidates. Every row of queries is a query of its own, so a repeated one has its ranks twice. Every
    block of the index meets every block of queries in a task of its own, which returns at most k rows a query. Jobs
    run while this is called: the index is written, and the queries are counted to deal them to the cores.
    """
    spark = vectors.sparkSession
    index = cut(build_index(vectors, rows)).withColumn("block", F.monotonically_increasing_id())
    wanted = queries.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n = wanted.count()
    if query_rows is None:
        # as few blocks as keep all cores busy
        query_rows = min(QUERIES, max(256, -(-n * max(1, index.count()) // (2 * spark.sparkContext.defaultParallelism))))
    asked = cut(_query_blocks(wanted.repartition(max(1, -(-n // query_rows)), "vec_id"), query_rows)).withColumn("qblock", F.monotonically_increasing_id())
    sizes = index.groupBy("width").agg(F.collect_list("block").alias("blocks"))  # a number per block
    pairs = asked.select("qblock", F.col("qwidth").alias("width")).join(sizes, "width").select("qblock", F.explode("blocks").alias("block"))
    work = pairs.join(asked.drop("qwidth"), "qblock").join(index, "block").repartition(F.col("block"), F.col("qblock"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, bits = batch.column("width")[r].as_py(), batch.column("bits")[r].as_py()
                of = lambda c, kind=np.int64: np.frombuffer(batch.column(c)[r].as_py(), kind)  # noqa: B023, E731
                ids, low, values = of("ids"), of("low"), of("vals").reshape(-1, width)
                slices = of("slices", np.uint64).reshape(width, min(SLICES, bits), -1)
                qblock = batch.column("qblock")[r].as_py()
                for at, (query_id, query) in enumerate(zip(of("qids").tolist(), of("qvals").reshape(-1, width), strict=True)):
                    best, scores = search_block(ids, low, values, slices, bits, query_id, query, k)
                    same = [np.full(len(best), x, np.int64) for x in (qblock, at, query_id)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*same, best, scores)], names=["qblock", "at", "query_id", "vec_id", "score"])

    found = work.select("width", "bits", "ids", "low", "vals", "slices", "qids", "qvals", "qblock").mapInArrow(run, "qblock bigint, at bigint, query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("qblock", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
