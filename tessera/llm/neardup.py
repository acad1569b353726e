"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fields_of, table, whole_row

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares a band of 6 of 216 registers with probability 0.99998, at 0.3 with 0.026.
BANDS, ROWS = 36, 6
#: Members of a star compared with each other at once.
BLOCK = 256
#: Parts in which a star's members are numbered: steps of similarity, and slices of each by hash.
STEPS, SALTS = 128, 64
#: Key lists of at most this many rows (24 bytes each) are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles in memory at once while signatures are made, and remembered words.
CHUNK, MEMORY = 1_000_000, 400_000

_GOLDEN_INT = 0x9E3779B97F4A7C15
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """64-bit hashes of the word windows of texts; words are split at ASCII white space, as bytes.split does."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.memory: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        """All windows in order; a text of fewer words is one window, a text without words has none."""
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.memory
        try:
            ids = [known[w] for w in words]
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        h = np.array(ids, np.uint64)
        n = max(1, len(h) - self.size + 1)
        width = min(self.size, len(h))
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = out * _FOLD + h[k : k + n]
        return _mix(out)


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures of weighted sets: equal registers of two sets estimate their probability Jaccard similarity.

    The elements of a set (doc, element, weight in parallel arrays) each emit a Poisson process of rate weight,
    seeded by the element alone. An arrival falls into a uniformly drawn register, and a register keeps the
    element of its earliest arrival. A process stops as soon as it is later than the latest register of its set,
    so most elements of a long text emit one arrival. Round t draws the t-th arrival of all that still run.
    """
    first = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    run, now = np.arange(len(element)), np.zeros(len(element))
    turn = 0
    while len(run):
        turn += 1
        e, d = element[run], doc[run]
        draw = _mix(e + np.uint64(_GOLDEN_INT * turn & (1 << 64) - 1))
        now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight[run]
        inside = now < latest[d]
        run, now, e, d, draw = run[inside], now[inside], e[inside], d[inside], draw[inside]
        register = d * registers + ((_mix(draw + _FOLD) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, register, now)
        won = first[register] == now
        winner[register[won]] = e[won]
        seen = np.unique(d)
        latest[seen] = first.reshape(n_docs, registers)[seen].max(axis=1)
        go = now < latest[d]
        run, now = run[go], now[go]
    return winner.reshape(n_docs, registers)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    s = signatures.reshape(len(signatures), bands, rows)
    for k in range(rows):
        out = _mix(out * _FOLD + s[:, :, k])
    return out.view(np.int64)


def _banded(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, key, text) to (id, key, bands)."""
    kind = texts.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            found = batch.column(2).to_pylist()
            at = 0
            while at < len(found):
                sets, size, end = [], 0, at
                while end < len(found) and size < CHUNK:
                    sets.append(np.unique(shingles(found[end] or ""), return_counts=True))
                    size += len(sets[-1][0])
                    end += 1
                doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
                sig = probminhash(doc, np.concatenate([s for s, _ in sets]), weight_of(np.concatenate([n for _, n in sets])), len(sets), bands * rows)
                hashes = band_hashes(sig, bands, rows)
                full = np.array([len(s) > 0 for s, _ in sets])
                offsets = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[full].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), lists], names=["id", "key", "bands"])
                at = end

    return texts.mapInArrow(run, f"id {kind}, key binary, bands array<bigint>")


def weight_of(count: np.ndarray) -> np.ndarray:
    """The weight of a shingle that occurs so often in its text; 0 for none."""
    return np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0.0)


def _sets(texts: DataFrame) -> DataFrame:
    """(rid, text) to (rid, shingles, counts): the sorted distinct shingle hashes as 8-byte integers, their occurrences as 4-byte ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sets = [np.unique(shingles(t or ""), return_counts=True) for t in batch.column(1).to_pylist()]
            columns = [pa.array([s.tobytes() for s, _ in sets], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["rid", "shingles", "counts"])

    return texts.mapInArrow(run, "rid bigint, shingles binary, counts binary")


def probability_jaccard(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets, given by sorted elements and their occurrences.

    The sum, over common elements i of weights x and y, of 1 / sum over all j of max(x_j / x_i, y_j / y_i). Elements of
    equal occurrences on both sides are one term, so there are few; with weights of 1 it is the Jaccard similarity.
    """
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if na.max() == 1 and nb.max() == 1:
        return len(ia) / (len(a) + len(b) - len(ia))
    pairs = (na[ia].astype(np.uint64) << np.uint64(32)) | nb[ib].astype(np.uint64)
    both, n = np.unique(pairs, return_counts=True)
    x, y = weight_of((both >> np.uint64(32)).astype(np.int64)), weight_of((both & np.uint64(0xFFFFFFFF)).astype(np.int64))
    only = [np.unique(np.delete(c, i), return_counts=True) for c, i in ((na, ia), (nb, ib))]
    none = [np.zeros(len(v)) for v, _ in only]
    all_x = np.concatenate((x, weight_of(only[0][0]), none[1]))
    all_y = np.concatenate((y, none[0], weight_of(only[1][0])))
    all_n = np.concatenate((n, only[0][1], only[1][1]))
    return float((n / (np.maximum(all_x / x[:, None], all_y / y[:, None]) @ all_n)).sum())


def _read(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingles, np.uint64), np.frombuffer(counts, "<u4")


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series([probability_jaccard(*_read(x, n), *_read(y, m)) for x, n, y, m in zip(a, na, b, nb, strict=True)], dtype="float64")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected component, for all nodes of the edges (a, b).

    Large-star and small-star steps alternate until no edge changes; each keeps the number of edges and halves
    paths, so rounds grow with the logarithm of the longest one. Every round is written to the shared folder.
    """
    star = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = cut(small)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def _links_within(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between members of different components in one pair of blocks of a star.

    Products of matrices over slices of the shingles give, for every pair, the common count and either text's weight
    in common elements. The share of that weight in a text bounds the similarity from above, and where no shingle is
    repeated the counts give it exactly; pairs within the bound are worked out exactly, unless links already join them.
    """
    out: list[tuple[int, int]] = []
    for (_, i, j), part in pdf.groupby(["lead", "i", "j"], sort=False):
        sets = [_read(s, n) for s, n in zip(part["shingles"], part["counts"], strict=True)]
        rid, comp, block = part["rid"].to_numpy(), part["comp"].to_numpy(), part["block"].to_numpy()
        size = np.array([len(s) for s, _ in sets])
        rows = np.repeat(np.arange(len(sets)), size)
        names, column = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
        weight = weight_of(np.concatenate([n for _, n in sets])).astype(np.float32)
        repeated = np.array([n.max(initial=0) > 1 for _, n in sets])
        total = np.bincount(rows, weight, len(sets))
        order = np.argsort(column, kind="stable")
        rows, column, weight = rows[order], column[order], weight[order]
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common, mine, theirs = (np.zeros((len(one), len(two)), np.float32) for _ in range(3))
        for at in range(0, len(names), 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            x = np.zeros((len(sets), min(4096, len(names) - at)), np.float32)
            x[rows[lo:hi], column[lo:hi] - at] = 1
            common += x[one] @ x[two].T
            if repeated.any():
                w = np.zeros_like(x)
                w[rows[lo:hi], column[lo:hi] - at] = weight[lo:hi]
                mine += w[one] @ x[two].T
                theirs += x[one] @ w[two].T
        apart = comp[one][:, None] != comp[two][None, :]
        plain = ~repeated[one][:, None] & ~repeated[two][None, :]
        either = size[one][:, None] + size[two][None, :] - common
        hit = apart & plain & (common >= similarity * either - 1e-6)
        out += [(int(rid[one[p]]), int(rid[two[q]])) for p, q in zip(*np.nonzero(hit), strict=True)]
        maybe = apart & ~plain & (mine >= (similarity - 1e-4) * total[one][:, None]) & (theirs >= (similarity - 1e-4) * total[two][None, :])
        joined = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while joined[c] != c:  # noqa: B023
                joined[c] = c = joined[joined[c]]  # noqa: B023
            return c

        for p, q in zip(*np.nonzero(hit), strict=True):
            joined[root(int(comp[one[p]]))] = root(int(comp[two[q]]))
        for p, q in zip(*np.nonzero(maybe), strict=True):
            a, b = one[p], two[q]
            if root(int(comp[a])) != root(int(comp[b])) and probability_jaccard(*sets[a], *sets[b]) >= similarity - 1e-9:
                joined[root(int(comp[a]))] = root(int(comp[b]))
                out.append((int(rid[a]), int(rid[b])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicate_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(key, class_id) of every row: class_id is the least key among the texts of its class.

    Classes are the connected components of the links between texts whose weighted sets of five-word shingles have a
    probability Jaccard similarity of at least `similarity`; a shingle that occurs n times weighs 1 + ln n. Equal texts
    are one text from the start. Links are sought among texts that share a band of their ProbMinHash signatures, and
    every link is verified exactly on the whole sets, by the same weights and measure that the signatures estimate. Texts without words are near to equal texts only; a null text is near to
    none and is a class of its own (class_id = key). Null keys follow their text; a class with no key but null
    has a null class_id. Other columns are not read.

    In each bucket all texts are compared with one, the leader, which joins most. Then the stars of a leader
    that still hold several components are compared within, block by block, so that no link is lost; pairs of
    blocks that the triangle inequality rules out (1 less the similarity is a metric, as signatures collide with it), or of a single component, are left out.
    """
    alone = docs.where(F.col(f"`{text}`").isNull()).select(F.col(f"`{key}`").alias("id"), F.col(f"`{key}`").alias("class_id"))
    return _labelled(docs, key, text, similarity, bands, rows).select("id", "class_id").union(alone).toDF(key, "class_id")


def _hash(text: str) -> Column:
    return F.unhex(F.md5(F.encode(F.col(f"`{text}`"), "UTF-8")))


def _labelled(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, key, label, class_id) of every row with a text: its key, the text's hash, its class and that class's least key."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").alias("id"), _hash(text).alias("key"), F.col(f"`{text}`").alias("text"))
    given = source.where(F.col("text").isNotNull())
    banded = cut(_banded(given, bands, rows))
    reps = cut(banded.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))).withColumn("rid", F.monotonically_increasing_id())

    # candidate stars: every text of a bucket with the bucket's least
    spread = reps.select("rid", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("rid").alias("lead"), F.max("rid").alias("last")).where("lead < last").select("bucket", "lead")
    stars = cut(spread.join(buckets, "bucket").where("rid <> lead").select("lead", "rid").distinct())

    # their shingle sets
    nodes = stars.select("rid").union(stars.select("lead")).distinct()
    wanted = cut(nodes.join(reps.select("rid", "key", "id"), "rid"))
    small = wanted.count() <= BROADCAST_ROWS
    keys = wanted.select("rid", F.col("key").alias("k"), F.col("id").alias("i"))
    met = given.join(F.broadcast(keys) if small else keys, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
    sets = cut(_sets(met.select("rid", "text")).dropDuplicates(["rid"]))

    measured = cut(
        stars.join(sets.select("rid", F.col("shingles").alias("y"), F.col("counts").alias("ny")), "rid")
        .join(sets.select(F.col("rid").alias("lead"), F.col("shingles").alias("x"), F.col("counts").alias("nx")), "lead")
        .select("lead", "rid", _similarity("x", "nx", "y", "ny").alias("j"))
    )
    linked = measured.where(F.col("j") >= similarity - 1e-9).select(F.col("lead").alias("a"), F.col("rid").alias("b"))
    labels = components(linked)

    # stars of several components, compared within
    label = labels.select(F.col("node").alias("rid"), "label")
    members = measured.select("lead", "rid", "j").join(label, "rid", "left").select("lead", "rid", "j", F.coalesce("label", "rid").alias("comp"))
    open_stars = members.groupBy("lead").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("n > 1 and lo <> hi")
    # places by j, in STEPS * SALTS parts of a star, so that no task numbers all members of a large one
    opened = members.join(open_stars.select("lead"), "lead").withColumn("part", F.floor(F.col("j") * STEPS).cast("int") * SALTS + F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    opened = cut(opened)
    before = W.partitionBy("lead").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = opened.groupBy("lead", "part").agg(F.count("*").alias("n")).select("lead", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(W.partitionBy("lead", "part").orderBy("j", "rid")) - 1
    blocked = cut(opened.join(starts, ["lead", "part"]).select("lead", "rid", "j", "comp", F.floor(place / BLOCK).cast("int").alias("block")))
    stats = blocked.groupBy("lead", "block").agg(F.min("j").alias("jlo"), F.max("j").alias("jhi"), F.min("comp").alias("clo"), F.max("comp").alias("chi"))
    other = stats.select("lead", *[F.col(c).alias(f"{c}2") for c in ("block", "jlo", "jhi", "clo", "chi")])
    apart = (F.col("clo") != F.col("chi")) | (F.col("clo") != F.col("clo2")) | (F.col("clo2") != F.col("chi2"))
    pairs = (
        stats.join(other, "lead")
        .where((F.col("block") <= F.col("block2")) & apart & (F.col("jlo2") - F.col("jhi") <= 1 - similarity + 1e-9))
        .select("lead", F.col("block").alias("i"), F.col("block2").alias("j2"))
    )
    sides = pairs.select("lead", "i", "j2", F.explode(F.array_distinct(F.array("i", "j2"))).alias("block"))
    work = (
        blocked.select("lead", "block", "rid", "comp")
        .join(sides, ["lead", "block"])
        .join(sets, "rid")
        .select("lead", "i", F.col("j2").alias("j"), "block", "rid", "comp", "shingles", "counts")
    )
    slot = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("lead"), F.lit(_slots(spark)))).otherwise(F.xxhash64("lead", "i", "j"))
    more = work.groupBy(slot.alias("slot")).applyInPandas(lambda pdf: _links_within(pdf, similarity), "a bigint, b bigint")
    # all links of the first round are within a component, so its least node stands for each
    renamed = label.select(F.col("rid").alias("n"), "label")
    late = (
        more.join(renamed.select(F.col("n").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(renamed.select(F.col("n").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        .distinct()
    )
    found = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(late))

    classed = reps.select("rid", "key", "id").join(found.select(F.col("node").alias("rid"), "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    least = classed.groupBy("label").agg(F.min("id").alias("class_id"))
    by_key = classed.join(least, "label").select("key", "label", "class_id")
    return banded.select("id", "key").join(by_key, "key").select("id", "key", "label", "class_id")


def _slots(spark: SparkSession) -> int:
    """Groups into which small stars are thrown together, so that a call of Python handles many."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class one, that with the least key, then the least hash of the text.

    Rows are told apart by key and text, so a repeated key costs no other text. A null key comes last in its class.
    Of rows alike in key and text the one with the least hash of all columns stays. Null texts stay.
    """
    found = _labelled(docs, key, text).groupBy("label", "id", "key").agg(F.count("*").alias("n"))
    found = cut(found.select("label", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("at"), "n"))
    # keepers are brought back by (id, key), which no class makes hot, and not by label
    kept = found.groupBy("label").agg(F.min("at").alias("at")).select(F.col("at.id").alias("ki"), F.col("at.key").alias("kk"))
    told = found.select(F.col("at.id").alias("i"), F.col("at.key").alias("k"), "n").join(kept, F.col("i").eqNullSafe(F.col("ki")) & (F.col("k") == F.col("kk")), "left")
    told = cut(told.select("i", "k", F.col("kk").isNotNull().alias("stays"), "n"))
    held = docs.select(whole_row(docs).alias("row"), F.col(f"`{key}`").alias("id"), _hash(text).alias("key"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    gone, twice = told.where("not stays or n > 1").select("i", "k"), told.where("stays and n > 1").select("i", "k")
    small = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    kept_rows = held.join(small(gone), same, "left_anti").select("row")
    if not twice.isEmpty():
        many = held.join(small(twice), same).groupBy("i", "k").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
        kept_rows = kept_rows.union(many.select("row"))
    return kept_rows.select(*fields_of("row", docs.columns))


def op9_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
