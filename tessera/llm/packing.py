"""Order-preserving packing: dynamic programming over window cuts with a monotone queue."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPLIT, Codec, small, vocabulary_path
from .common import table

WINDOW = 1024
#: Cost, in tokens of padding, of a cut at the end of a document, of a sentence, of a clause, and anywhere else.
PENALTIES = (0, 1, 2, 8)
#: In sentences longer than LONG tokens (tables, lists, text without stops) the ends of clauses count as ends, too. Only
#: what still exceeds a window, so that no window holds it, may be cut elsewhere, at multiples of GRAIN tokens.
LONG, GRAIN = 32, 16
SENTENCE, CLAUSE = 1, 2
#: Tokens of one optimisation; its last window is left open and carried into the next.
BLOCK = 1 << 17


def best_cuts(ends: list[int], costs: list[int], window: int = WINDOW) -> list[int]:
    """Indices of the chosen cuts among `ends` (rising token positions; gaps of at most `window`), the last included.

    Minimises, over all ways to cut the stream at some of the ends into windows of at most `window` tokens, the
    padding of all windows plus the costs of the cuts; the last window's padding counts as that of others. With
    f(i) = cost(i) + window - end(i) + min over j of f(j) + end(j), the minimum runs over a sliding range of j
    and is kept in a queue of rising values. Of equal choices, the later j.
    """
    value = [0]  # f(j) + end(j), of the start and then of each end
    place = [0]
    back: list[int] = []
    queue: deque[int] = deque([0])
    for i, end in enumerate(ends):
        low = end - window
        while place[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        back.append(j)
        v = value[j] + costs[i] + window
        value.append(v)
        place.append(end)
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(i + 1)
    cuts = []
    i = len(ends)
    while i:
        cuts.append(i - 1)
        i = back[i - 1]
    return cuts[::-1]


def _within(marks: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches between marks that are longer than `most`."""
    starts, stops = np.concatenate(([0], marks)), np.concatenate((marks, [size]))
    long = stops - starts > most
    return starts[long], stops[long]


def offered_cuts(ids: np.ndarray, kinds: np.ndarray, doc_ends: np.ndarray, penalties=PENALTIES, grain: int = GRAIN, long: int = LONG, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Token positions at which a stream may be cut, rising, and the cost of each.

    kinds tells for every vocabulary id whether a SENTENCE or a CLAUSE ends with it; doc_ends are the positions after
    each document. Gaps are at most `window`: a sentence of more than `long` tokens may be cut where its clauses end,
    and what is longer than a window without any such place at multiples of `grain`.
    """
    size, found = len(ids), kinds[ids]
    sentence, clause = np.flatnonzero(found == SENTENCE) + 1, np.flatnonzero(found == CLAUSE) + 1
    offered = np.zeros(size + 1, bool)
    offered[sentence] = offered[doc_ends] = True
    starts, stops = _within(np.flatnonzero(offered), size, long)
    k = np.searchsorted(starts, clause, side="right") - 1
    inside = clause[(k >= 0) & (clause < stops[np.maximum(k, 0)])] if len(starts) else clause[:0]
    offered[inside] = True
    starts, stops = _within(np.flatnonzero(offered), size, window)
    counts = (stops - starts - 1) // grain
    inner = np.repeat(starts, counts) + grain * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
    offered[inner] = True
    offered[size] = size > 0
    cost = np.full(size + 1, penalties[3])
    for at, p in ((inside, penalties[2]), (sentence, penalties[1]), (doc_ends, penalties[0])):
        cost[at] = p
    ends = np.flatnonzero(offered)
    return ends, cost[ends]


class LibraryCodec(Codec):
    """The same ids, but words not met before go through a tokenizer library, many in a call.

    What packing chooses is the cuts; ids are its input, and a compiled library gives them in less than half the time
    of the codec of op10 (256 CPU seconds a GB against 555).

    Every run begins with a blank and holds no other white space, so no word of the joined text crosses runs, and
    the byte lengths of the tokens tell where each run ends.
    """

    def __init__(self, path: str):
        super().__init__(path)
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in self.special.values()}
        self.library = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.array([len(b) for b in self.bytes])

    def _learn(self, runs: list[str]) -> None:
        super()._learn([r for r in runs if r[0] == "\n"])
        plain = [r for r in runs if r[0] != "\n"]
        ids = np.asarray(self.library.encode_to_numpy(" " + " ".join(plain), disallowed_special=()) if plain else [], "<u4")
        ends = np.cumsum([len(r.encode()) + 1 for r in plain])
        stops = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * 4
        spelled, memory, at = ids.tobytes(), self.memory, 0
        for run, stop in zip(plain, stops.tolist(), strict=True):
            memory[run] = spelled[at:stop]
            at = stop


_library: dict[str, LibraryCodec] = {}


def library_codec(path: str) -> LibraryCodec:
    """One per Python worker."""
    if path not in _library:
        _library[path] = LibraryCodec(path)
    return _library[path]


class Packer:
    """Packs the documents of one stream in their order; sequence numbers begin at `first`."""

    def __init__(self, kinds: np.ndarray, first: int = 0, window: int = WINDOW, block: int = BLOCK, penalties=PENALTIES):
        self.kinds, self.next, self.window, self.block, self.penalties = kinds, first, window, block, penalties
        self.docs: deque = deque()  # [key, ids, tokens of it already packed]
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([key, ids, 0])
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(final=False)

    def flush(self, final: bool = True) -> Iterator[tuple]:
        """Pieces (key, start, ids, doc_tokens, sequence, offset). If more is to come, what may still change is kept."""
        while self.held and (final or self.held >= self.block):
            # a stream longer than a block, as of one very long document, is solved block by block
            parts, ends, got = [], [], 0
            for _, ids, done in self.docs:
                part = ids[done : done + 2 * self.block - got]
                parts.append(part)
                got += len(part)
                if done + len(part) == len(ids):
                    ends.append(got)
                if got >= 2 * self.block:
                    break
            stream = np.concatenate(parts)
            places, costs = offered_cuts(stream, self.kinds, np.array(ends, np.int64), self.penalties, min(GRAIN, self.window), LONG, self.window)
            cuts = [int(places[i]) for i in best_cuts(places.tolist(), costs.tolist(), self.window)]
            if not final or got < self.held:
                cuts = cuts[:-2] or cuts
            at = 0
            for cut in cuts:
                yield from self._window(cut - at)
                at = cut

    def _window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc = self.docs[0]
            key, ids, done = doc
            take = min(len(ids) - done, length - offset)
            yield key, done, ids[done : done + take], len(ids), self.next, offset
            offset += take
            self.held -= take
            doc[2] += take
            if doc[2] == len(ids):
                self.docs.popleft()
        self.next += 1


def end_kinds(path: str) -> np.ndarray:
    """For every id: SENTENCE if its bytes end in a full stop, question or exclamation mark or hold a line feed, CLAUSE if in , ; : | or a bracket."""
    kind = lambda b: SENTENCE if b[-1:] in (b".", b"?", b"!") or b"\n" in b else CLAUSE if b[-1:] in (b",", b";", b":", b"|", b")", b"]") else 0
    return np.array([kind(b) for b in library_codec(path).bytes], np.uint8)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, each document's ids followed by end_id, in the order in which the table holds them.

    Windows are optimal within blocks of about BLOCK tokens of a partition; no shuffle, and a task holds one block
    and one Arrow batch. A null text is empty and gives the end id alone. sequence_id is unique and rises in the
    order of the stream within a partition; each partition's last sequence may be short, so small partitions cost padding. Repeated rows are packed
    as often as they occur; only key and text are read. The key may be of any type.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = library_codec(path)
        end = np.array([end_id], "<u4")
        packer = Packer(end_kinds(path), TaskContext.get().partitionId() << 40, window)
        key_type = None
        for batch in small(batches):
            made, key_type = [], batch.column(0).type
            for k, ids in zip(batch.column(0), c.encode_batch(t or "" for t in batch.column(1).to_pylist()), strict=True):
                made += packer.add(k.as_py(), np.concatenate((np.frombuffer(ids, "<u4"), end)))
            if made:
                yield table_of(made, key_type)
        if made := list(packer.flush()):
            yield table_of(made, key_type)

    def table_of(made: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        keys, starts, ids, totals, sequences, offsets = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, key_type),
                pa.array(starts, pa.int64()),
                pa.array(map(len, ids), pa.int64()),
                pa.array([zlib.crc32(x.data if x.flags.c_contiguous else x.tobytes()) for x in ids], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array(sequences, pa.int64()),
                pa.array(offsets, pa.int64()),
                *([pa.array([x.tobytes() for x in ids], pa.binary())] if with_ids else []),
            ],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])],
        )

    chosen = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(
        run,
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids,
    ).withColumnRenamed("id", key)


def op5_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
