"""Merkle manifest of a dataset: digest matrices of aligned blocks, hashed level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Bytes of a digest, as lowercase hex.
HEX = 64
FANOUT = 2
#: Levels of a block: it holds FANOUT ** HEIGHT nodes, and so does the path from a leaf grow by one block at a time.
HEIGHT = 10
#: Offsets of sorted runs (a row for each partition and tree) are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Row numbers within a partition in what monotonically_increasing_id() gives.
_ROW_BITS = 33


def encoded(value: Column) -> Column:
    """A field in a leaf: `-` for null, else its count of UTF-8 bytes, `:` and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(encoded, fields)), "UTF-8"), 256)


def digest_rows(matrix: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """The next level of a matrix of digests (n rows of HEX bytes): `fanout` rows laid end to end are hashed as one."""
    whole = len(matrix) // fanout
    wide = matrix[: whole * fanout].reshape(whole, fanout * HEX)
    found = [hashlib.sha256(row).hexdigest().encode() for row in wide]
    if whole * fanout < len(matrix):
        found.append(hashlib.sha256(matrix[whole * fanout :].tobytes()).hexdigest().encode())
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, HEX)


def levels_of(matrix: np.ndarray, nodes: int, height: int = HEIGHT, fanout: int = FANOUT) -> list[np.ndarray]:
    """All levels of a block, its own nodes first, its one root last.

    nodes is the count of the whole tree on the block's level: a tree of more than one block climbs `height` levels
    even where its last block is down to one node, a tree of one block ends at its root.
    """
    levels = [matrix]
    for _ in range(height):
        if len(levels[-1]) == 1 and nodes <= fanout**height:
            break
        levels.append(digest_rows(levels[-1], fanout))
    return levels


def siblings(levels: list[np.ndarray], at: np.ndarray, fanout: int = FANOUT) -> list[list[tuple[bytes, bytes]]]:
    """For each node `at` of the first level, level by level, the digests before and after it in its run."""
    out: list[list[tuple[bytes, bytes]]] = [[] for _ in at]
    for level in levels[:-1]:
        start = at // fanout * fanout
        end = np.minimum(start + fanout, len(level))
        flat = level.tobytes()
        for path, s, i, e in zip(out, (start * HEX).tolist(), (at * HEX).tolist(), (end * HEX).tolist(), strict=True):
            path.append((flat[s:i], flat[i + HEX : e]))
        at = at // fanout
    return out


def fold(digest: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and its siblings give."""
    for before, after in path:
        digest = hashlib.sha256(before + digest + after).hexdigest().encode()
    return digest


def _packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: for each level the counts of digests before and after, then these."""
    return b"".join(bytes((len(a) // HEX, len(b) // HEX)) + a + b for a, b in path)


def _unpacked(packed: bytes) -> list[tuple[bytes, bytes]]:
    path, at = [], 0
    while at < len(packed):
        a = at + 2 + packed[at] * HEX
        b = a + packed[at + 1] * HEX
        path.append((packed[at + 2 : a], packed[a:b]))
        at = b
    return path


def numbered(rows: DataFrame, tree: list[str], order: list[Column]) -> DataFrame:
    """rows with pos, their number from 0 within a tree (all rows, if `tree` names no columns), and nodes, its count.

    Rows are dealt by ranges of (tree, order) and sorted there, so no task needs a whole tree. Rows equal in all of
    that are still dealt apart, by where they come from.
    """
    spread = cut(rows).withColumn("spread_", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in tree] + order + [F.col("spread_").asc()]
    held = cut(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread_")).withColumn("id_", F.monotonically_increasing_id())
    held = held.withColumn("run_", F.shiftright("id_", _ROW_BITS))
    runs = held.groupBy("run_", *tree).agg(F.count("*").alias("n_"), F.min("id_").alias("first_"))
    before = W.partitionBy(*tree).orderBy("run_")  # a row for each partition, at most
    runs = cut(
        runs.select(
            F.col("run_").alias("of_"),
            *[F.col(c).alias(f"{c}_of") for c in tree],
            (F.coalesce(F.sum("n_").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("first_")).alias("start_"),
            F.sum("n_").over(W.partitionBy(*tree)).alias("nodes"),
        )
    )
    same = F.col("run_") == F.col("of_")
    for c in tree:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_of"))
    small = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    return held.join(small, same).withColumn("pos", F.col("id_") + F.col("start_")).drop("id_", "run_", "of_", "start_", *[f"{c}_of" for c in tree])


def _blocks(nodes: DataFrame, height: int, fanout: int, kept: str = "") -> DataFrame:
    """(tree, pos, nodes, digest, ...) to one row a block: tree, block, nodes, root, digests, and the ids and second digests of leaves."""
    leaves = bool(kept)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        digests = "".join(part["digest"].to_pylist()).encode()
        total = part["nodes"][0].as_py()
        root = levels_of(np.frombuffer(digests, np.uint8).reshape(-1, HEX), total, height, fanout)[-1].tobytes()
        columns = {"tree": part["tree"][:1], "block": part["block"][:1], "nodes": pa.array([total], pa.int64()), "root": pa.array([root.decode()]), "digests": pa.array([digests], pa.binary())}
        if leaves:
            offsets = pa.array([0, part.num_rows], pa.int32())
            columns["ids"] = pa.ListArray.from_arrays(offsets, part["id"].combine_chunks())
            columns["altered"] = pa.array(["".join(part["altered"].to_pylist()).encode()], pa.binary())
        return pa.table(columns)

    shape = "tree bigint, block bigint, nodes bigint, root string, digests binary" + f", ids array<{kept}>, altered binary" * leaves
    columns = ["tree", "block", "pos", "nodes", "digest", *(["id", "altered"] if leaves else [])]
    return cut(nodes.withColumn("block", F.floor(F.col("pos") / fanout**height)).select(*columns).groupBy("tree", "block").applyInArrow(run, shape))


def _climb(leaves: DataFrame, height: int, fanout: int) -> list[DataFrame]:
    """Blocks of leaves and of every layer above, until each tree has come down to one block."""
    layers = [leaves]
    while True:
        many = layers[-1].where(F.col("nodes") > fanout**height)
        if many.isEmpty():
            return layers
        up = many.select("tree", F.col("block").alias("pos"), F.ceil(F.col("nodes") / fanout**height).cast("bigint").alias("nodes"), F.col("root").alias("digest"))
        layers.append(_blocks(up, height, fanout))


def _tops(layers: list[DataFrame], height: int, fanout: int) -> DataFrame:
    """(tree, root) of every tree: the root of the layer that is one block."""
    tops = [x.where(F.col("nodes") <= fanout**height).select("tree", "root") for x in layers]
    found = tops[0]
    for more in tops[1:]:
        found = found.union(more)
    return found


def _members(blocks: DataFrame, heads: DataFrame, height: int, fanout: int) -> DataFrame:
    """(tree, pos, path) of the nodes of blocks: their siblings in the block, then the path of its root, from heads (tree, block, path)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = levels_of(np.frombuffer(r["digests"], np.uint8).reshape(-1, HEX), r["nodes"], height, fanout)
                at = np.arange(len(levels[0]))
                packed = [_packed(p) + r["path"] for p in siblings(levels, at, fanout)]
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(at), pa.int64()), pa.array(at + r["block"] * fanout**height, pa.int64()), pa.array(packed, pa.binary())], names=["tree", "pos", "path"])

    return blocks.select("tree", "block", "nodes", "digests").join(heads, ["tree", "block"]).mapInArrow(run, "tree bigint, pos bigint, path binary")


def _descend(layers: list[DataFrame], above: DataFrame, height: int, fanout: int) -> DataFrame:
    """(tree, block, path) of the blocks of the lowest layer: the path from a block's root to the root of all.

    above: (tree, path) of the trees' own roots.
    """
    known = None
    for k in range(len(layers) - 1, -1, -1):
        own = layers[k].where(F.col("nodes") <= fanout**height).select("tree", "block").join(above, "tree").select("tree", "block", "path")
        known = own if known is None else known.union(own)
        if k:
            known = _members(layers[k], known, height, fanout).withColumnRenamed("pos", "block")
    return cut(known)


def manifest(leaves: DataFrame, group: str, key: str, height: int = HEIGHT, fanout: int = FANOUT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of leaves.

    leaves has group, key, leaf and altered (lowercase hex digests). The leaves of a group ascend by key (null first),
    then leaf; while a level has several nodes, every `fanout` consecutive ones become the digest of their hex texts laid end to
    end, and fewer, even one, at the end of the level. The groups' roots, by group (null first, bytewise), make a tree
    likewise. proof_sha256 is the digest of all siblings on the way up; folded_root is what `altered` and these
    siblings come to, and verified tells whether that is the root. Repeated rows are leaves of their own. An empty
    table gives no rows. Jobs run while this is called.

    Blocks are aligned runs of fanout ** height nodes, whose levels are matrices in one task; their roots are the
    nodes of the next layer. Paths come down the same layers, so a task holds one block and the path above it.
    """
    kind = leaves.schema[key].dataType.simpleString()
    renamed = leaves.select(F.col(f"`{group}`").alias("lang"), F.col(f"`{key}`").alias("id"), F.col("leaf").alias("digest"), "altered")
    placed = cut(numbered(renamed, ["lang"], [F.col("id").asc_nulls_first(), F.col("digest").asc()]))
    trees = cut(numbered(placed.select("lang").distinct(), [], [F.col("lang").asc_nulls_first()]).select(F.col("lang").alias("of"), F.col("pos").alias("tree"), F.col("nodes").alias("trees")))
    few = F.broadcast(trees) if trees.count() <= BROADCAST_ROWS else trees
    layers = _climb(_blocks(placed.join(few.drop("trees"), F.col("lang").eqNullSafe(F.col("of"))), height, fanout, kind), height, fanout)

    subroots = cut(_tops(layers, height, fanout))
    crown = subroots.join(trees.drop("of"), "tree").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("nodes"), F.col("root").alias("digest"))
    over = _climb(_blocks(crown, height, fanout), height, fanout)
    root = _tops(over, height, fanout).select(F.col("root").alias("whole"))  # one row
    # from the crown's leaves, the subroots, to the root
    heads = _descend(over, leaves.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit(b"").alias("path")), height, fanout)
    above = cut(_members(over[0], heads, height, fanout).select(F.col("pos").alias("tree"), "path"))
    paths = _descend(layers, above, height, fanout)
    # in as many tasks as a shuffle has, which adaptive execution does not put together: folding is what takes the time
    slices = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = layers[0].drop("root").repartition(slices, "tree", "block")
    work = dealt.join(paths, ["tree", "block"]).join(subroots.withColumnRenamed("root", "subroot"), "tree").join(F.broadcast(root))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                digests, altered, whole = (batch.column(c)[i].as_py() for c in ("digests", "altered", "whole"))
                above = _unpacked(batch.column("path")[i].as_py())
                levels = levels_of(np.frombuffer(digests, np.uint8).reshape(-1, HEX), batch.column("nodes")[i].as_py(), height, fanout)
                n = len(levels[0])
                paths = [p + above for p in siblings(levels, np.arange(n), fanout)]
                leaf = [digests[at : at + HEX].decode() for at in range(0, n * HEX, HEX)]
                proof = [hashlib.sha256(b"".join(a + b for a, b in p)).hexdigest() for p in paths]
                folded = [fold(altered[k * HEX : (k + 1) * HEX], p).decode() for k, p in enumerate(paths)]
                same = lambda x: pa.array([x] * n, pa.string())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(leaf), same(batch.column("subroot")[i].as_py()), same(whole), pa.array(proof), pa.array(folded), pa.array([f == whole for f in folded])],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    shape = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return work.select("ids", "digests", "altered", "nodes", "path", "subroot", "whole").mapInArrow(run, shape).withColumnRenamed("id", key)


def document_leaves(docs: DataFrame, altered: Callable[[Column], Column] | None = None) -> DataFrame:
    """(lang, doc_id, leaf, altered) of documents; altered is the leaf with 1 added to n_chars where `altered(doc_id)` holds.

    Fields are doc_id, source, lang, n_chars and text; any may be null, and other columns are not read.
    """
    of = lambda n: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    n = F.col("n_chars").cast("decimal(38,0)")
    leaf = docs.select("lang", "doc_id", of(n).alias("leaf"), *([F.when(altered(F.col("doc_id")), of(n + 1)).alias("other")] if altered else []))
    return leaf.select("lang", "doc_id", "leaf", F.coalesce("other", "leaf").alias("altered") if altered else F.col("leaf").alias("altered"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = lambda key: F.crc32(key.cast("string").cast("binary")) % 7 == 0
    return manifest(document_leaves(table(spark, sf_dir, "documents"), tampered), "lang", "doc_id")
