"""Fingerprints of whole texts by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Samples of a fingerprint, and hexadecimal digits of each; the likeness of two has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES, DIGITS = 64, 4
#: Distinct terms of texts that are sampled together, and weighted terms that are drawn at once.
CHUNK, BLOCK = 65_536, 256
#: Code points of text that are held at once, and bytes that are split into words at once.
HELD, SLICE = 4_000_000, 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gamma(levels: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, in the middle of each of so many levels: (1 + x) exp(-x) is 1 less the level."""
    rest = 1 - (np.arange(levels) + 0.5) / levels
    low, high = np.zeros(levels), np.full(levels, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = (1 + x) * np.exp(-x) > rest
        low, high = np.where(below, x, low), np.where(below, high, x)
    return low


_R = _gamma().astype(np.float32)
_LOG_C = np.log(_gamma()).astype(np.float32)


def draws(term: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For terms (hashes) and samples that broadcast: r and log c, where r and c follow the gamma distribution of shape 2, and b, uniform on [0, 1).

    Each is drawn among 65,536 levels by 16 bits of a hash of both.
    """
    bits = _mix(term + _GOLDEN * (sample.astype(np.uint64) + np.uint64(1)))
    level = lambda shift: ((bits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
    return _R.take(level(0)), _LOG_C.take(level(16)), (level(32).astype(np.float32) + np.float32(0.5)) * np.float32(2**-16)


def log_a(term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """For each weighted term and sample the log of its a; of a text's terms the one with the least wins the sample.

    With t = floor(log weight / r + b), the level y = exp(r (t - b)) stays the same while the weight lies between y and
    y exp(r), and a = c / (y exp(r)). So two texts draw the same (term, t) with the probability of their generalised
    Jaccard similarity: the sum of the lesser weights over the sum of the greater ones.
    """
    out = np.empty((len(term), samples), np.float32)
    column = np.arange(samples)[None, :]
    for at in range(0, len(term), BLOCK):
        r, c, b = draws(term[at : at + BLOCK, None], column)
        w = weight[at : at + BLOCK]
        out[at : at + BLOCK] = c + r * (b - 1)  # t is 0 at a weight of 1
        many = np.flatnonzero(w > 1)
        if len(many):
            out[at + many] -= r[many] * level_of(w[many, None], r[many], b[many])
    return out


def level_of(weight: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """t, the level of a weight."""
    return np.floor(np.log(weight).astype(np.float32) / r + b)


def marks_of(term: np.ndarray, weight: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """What stands in a fingerprint for the (term, t) that won a sample; 0 is left to texts without terms."""
    r, _, b = draws(term, sample)
    t = level_of(weight, r, b).astype(np.int64).astype(np.uint64)
    return (_mix(term ^ _mix(t + np.uint64(1))) % np.uint64((1 << 4 * DIGITS) - 1) + np.uint64(1)).astype(np.uint16)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BASE = np.uint64(0x2545F4914F6CDD1D)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, which ASCII white space splits: polynomials of the bytes, mixed."""
    data = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[data]
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = data[inside].astype(np.uint64)
    value += np.uint64(1)
    value *= powers[place]
    return _mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, rising, and their counts; a long text is split slice by slice, at white space."""
    data = text.encode("utf-8", "surrogatepass")
    found, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        found.append(word_hashes(data[at:end]))
        at = end
    hashes = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)
    starts = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)))
    return hashes[starts], np.diff(starts, append=len(hashes))


class Sketcher:
    """Fingerprints of texts; terms are the words (split at ASCII white space), their weights the occurrences."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of samples for each text. A weighted term that several of the texts hold is drawn once."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        at = 0
        while at < len(texts):
            held, size, first = [], 0, at
            while at < len(texts) and (size < CHUNK or at == first):
                held.append(terms(texts[at]))
                size += len(held[-1][0])
                at += 1
            self._sample(held, out[first:at])
        return out

    def _sample(self, held: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray) -> None:
        term, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(term):
            return
        offsets = np.concatenate(([0], np.cumsum([len(t) for t, _ in held])))
        _, one, which = np.unique(term + _GOLDEN * (weight - 1).astype(np.uint64), return_index=True, return_inverse=True)
        # distinct weighted terms by rising hash, so that equal values of a go to the least hash in whatever company
        order = np.argsort(term[one], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which, term, weight = place[which], term[one[order]], weight[one[order]]
        least = np.full((len(held), self.samples), np.inf, np.float32)
        winner = np.zeros((len(held), self.samples), np.int64)
        # a slice at a time, for one very long text; nearly always there is one slice
        for lo in range(0, len(term), 2 * CHUNK):
            a = log_a(term[lo : lo + 2 * CHUNK], weight[lo : lo + 2 * CHUNK], self.samples)
            inside, ends = which, offsets
            if len(a) < len(term):
                chosen = (which >= lo) & (which < lo + len(a))
                inside, ends = which[chosen] - lo, np.concatenate(([0], np.cumsum(chosen)))[offsets]
            for d in range(len(held)):
                mine = inside[ends[d] : ends[d + 1]]
                if len(mine):
                    own = a[mine]
                    low = own.min(axis=0)
                    better = low < least[d]
                    least[d][better] = low[better]
                    winner[d][better] = (mine[(own == low).argmax(axis=0)] + lo)[better]
        full = np.flatnonzero(np.diff(offsets))
        best = winner[full]
        out[full] = marks_of(term[best], weight[best], np.arange(self.samples)[None, :])


def text_of(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints: an estimate of the texts' generalised Jaccard similarity, null where one is null."""
    at = lambda x, i: F.substr(x, i * DIGITS + 1, F.lit(DIGITS))
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: at(a, i) == at(b, i))
    return F.when(a.isNotNull() & b.isNotNull(), F.size(same) / F.lit(float(samples)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, fingerprint) of every row: SAMPLES samples of its whole text in hexadecimal digits.

    Equal texts have equal fingerprints, wherever and with whichever others they are worked out. A null text is
    empty; texts without words have the fingerprint of zeros alone. Texts stay in their partitions; no shuffle. Only
    key and text are read, so other columns cannot clash; repeated rows are fingerprinted as often as they occur.
    A task holds HELD code points of text, or one text, at once, and draws for 2 * CHUNK terms.
    """
    chosen = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = chosen.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(samples)
        for rows in _chunks(batches):
            marks = sketch([t for _, t in rows])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], chosen_type), pa.array(map(text_of, marks), pa.string())], names=["id", "fingerprint"])

    chosen_type = _arrow(chosen, "id")
    return chosen.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", key)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, text) rows in their order, HELD code points at a time."""
    rows, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
            size += len(rows[-1][1])
            if size >= HELD:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def edited(text: str, other: str) -> str:
    """text with its last third (of code points, rounded down) replaced by the first as many of other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


SHAPE = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def robustness(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints against an edit: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents follow one another by descending key (null last), ties by the text's MD5 hash; after the last comes the
    first. edited() takes the start of the next one's text. near_edited and near_next are the likeness of a
    document's fingerprint to that of its edited text and of the next document. A null text is empty, an only
    document is its own next, an empty table gives no rows; repeated rows follow one another. Only key and text are read.

    Texts are dealt once, by ranges of the key, and walked through in order; a task holds HELD code points at once.
    The last document of each partition is compared with the first of the next in a second step, over two texts a
    partition. Jobs run while this is called.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{key}`").alias("id"), body.alias("text"), F.md5(F.encode(body, "UTF-8")).alias("tie"), F.monotonically_increasing_id().alias("from"))
    kind, id_type = given.schema[0].dataType.simpleString(), _arrow(given, "id")
    order = [F.col("id").desc_nulls_last(), F.col("tie").asc(), F.col("from").asc()]
    dealt = given.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(keys: list, texts: list[str], changed: list[str], own: np.ndarray, now: np.ndarray, following: np.ndarray) -> list[pa.Array]:
        """The columns of names, for documents, their edited texts, and the samples of both and of the next documents."""
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        shown = [pa.array(map(text_of, x), pa.string()) for x in (own, now)]
        return [pa.array(keys, id_type), pa.array(map(len, texts), pa.int64()), pa.array(sha), *shown, pa.array((own == now).mean(axis=1)), pa.array((own == following).mean(axis=1))]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of all documents but a partition's last; then that one's text (an odd edge) and the first's (an even one)."""
        sketch, part = Sketcher(samples), TaskContext.get().partitionId()
        first = last = None  # id, text, samples
        for rows in _chunks(batches):
            if last is None:
                first = last = (*rows[0], sketch([rows[0][1]])[0])
                rows = rows[1:]
            if rows:
                line = [last[:2], *rows]
                changed = [edited(a, b) for (_, a), (_, b) in pairwise(line)]
                # a text beside the edited one, which shares terms with it
                marks = sketch([t for both in zip(changed, (t for _, t in rows), strict=True) for t in both])
                own = np.vstack((last[2], marks[1::2]))
                keys, texts = zip(*line[:-1], strict=True)
                none = [pa.nulls(len(rows), kind) for kind in (pa.int64(), pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*result(keys, texts, changed, own[:-1], marks[0::2], own[1:]), *none], names=[*names, "edge", "text", "marks"])
                last = (*rows[-1], marks[-1])
        if last is not None:
            keys, texts, marks = zip(first, last, strict=True)
            none = [pa.nulls(2, kind) for kind in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            edges = [pa.array([2 * part, 2 * part + 1], pa.int64()), pa.array(texts, pa.string()), pa.array([m.tobytes() for m in marks], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, id_type), *none, *edges], names=[*names, "edge", "text", "marks"])

    walked = cut(dealt.mapInArrow(walk, f"id {kind}, {SHAPE}, edge bigint, text string, marks binary"))
    edges = walked.where("edge is not null").select("id", "edge", "text", "marks")
    # a number for each partition that holds rows
    parts = sorted(r.p for r in edges.where("edge % 2 = 0").select(F.expr("edge div 2").alias("p")).collect())
    follows = spark.createDataFrame([(2 * p + 1, 2 * parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "of bigint, then bigint")
    heads = edges.select(F.col("edge").alias("then"), F.col("text").alias("other"), F.col("marks").alias("following"))
    met = edges.join(F.broadcast(follows), F.col("edge") == F.col("of")).join(heads, "then").select("id", "text", "marks", "other", "following")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(samples)
        for batch in batches:
            for r in batch.to_pylist():
                own, following = (np.frombuffer(r[c], np.uint16)[None, :] for c in ("marks", "following"))
                changed = edited(r["text"], r["other"])
                yield pa.RecordBatch.from_arrays(result([r["id"]], [r["text"]], [changed], own, sketch([changed]), following), names=names)

    inner = walked.where("edge is null").select(*names)
    return inner.union(met.mapInArrow(meet, f"id {kind}, {SHAPE}")).withColumnRenamed("id", key)


def op13_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness(table(spark, sf_dir, "documents"))
