"""Byte-level BPE encoding by speculation and verification, and its decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words kept between batches in a task; beyond that the memory is emptied and filled anew.
MEMORY = 250_000
#: Rows of a batch that is handed on.
ROWS = 512

#: How byte-level BPE splits a text into the words that merges never leave (fixed by the public vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with its merges, as the public JSON format has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        spelled = lambda s: bytes(letters[c] for c in s)
        self.ids = {spelled(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(self.ids[spelled(a)], self.ids[spelled(b)]) for a, b in merges]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.made = [self.ids[self.bytes[a] + self.bytes[b]] for a, b in pairs]
        # the first merge that makes a token is the only one by which merging can come to it
        self.left, self.right, self.birth = (np.full(size, -1, np.int64) for _ in range(3))
        for r in range(len(pairs) - 1, -1, -1):
            t = self.made[r]
            self.left[t], self.right[t], self.birth[t] = *pairs[r], r
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], order
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        # tokens that merging their own bytes does not give; greedy proposals with one are merged exactly
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self._grow_trie()
        self.spelled = [np.array([i], "<u4").tobytes() for i in range(size)]
        self.sound = np.zeros(size, bool)
        for b, i in self.ids.items():
            self.sound[i] = self.merge(b) == [i]
        self.memory: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: again and again the pair of least rank, leftmost first."""
        ids = [*map(self.single.__getitem__, word)]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, made, none = self.rank.get, self.made, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        rank = self.rank
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (s := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _grow_trie(self) -> None:
        """step: (state, next byte) -> state; token: the id that ends in a state, or -1."""
        self.step: dict[int, int] = {}
        self.token = [-1]
        for word, i in self.ids.items():
            state = 0
            for b in word:
                key = state << 8 | b
                state = self.step.get(key, 0)
                if not state:
                    state = self.step[key] = len(self.token)
                    self.token.append(-1)
            self.token[state] = i

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        ids, step, token, at, end = [], self.step.get, self.token, 0, len(word)
        while at < end:
            state, k = 0, at
            while k < end and (state := step(state << 8 | word[k])):
                k += 1
                if (t := token[state]) >= 0:
                    best, stop = t, k
            ids.append(best)
            at = stop
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens: whether merging the bytes of both leaves exactly these two.

        Both tokens are unwound along the border, the one that was merged last first. At every point of time
        the pieces that then face each other must have no merge that would have come before the next step of
        either side; on equal ranks the left pair comes first.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        late = np.full(len(a), np.iinfo(np.int64).max)  # the rank at which this border ended; beyond it merges can't come
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)
            bad = rank < late[todo]
            good[todo[bad]] = False
            bx, by = self.birth[x], self.birth[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            # of the two, the later merge is undone; of equal ones (the same token twice) the right, made after the left
            left = bx > by
            at_x, at_y = todo[go & left], todo[go & ~left]
            late[at_x] = bx[go & left]
            a[at_x] = self.right[x[go & left]]
            # a border merge of the rank of the right token's own merge lies left of it and would have come first
            late[at_y] = by[go & ~left] + 1
            b[at_y] = self.left[y[go & ~left]]
            todo = todo[go]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Proposals for all words, one vectorised test of all adjacent pairs, exact merging where one fails."""
        ids = [[i] if (i := self.ids.get(w)) is not None else self.propose(w) for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for w in ids for i in w), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(ids)), counts)
        failed = np.zeros(len(ids), bool)
        failed[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(keys // self.size, keys % self.size)
        failed[owner[inner[~fits[back]]]] = True
        for k in np.flatnonzero(failed):
            ids[k] = self.merge(words[k])
        return ids

    def _learn(self, runs: list[str]) -> None:
        """Remembers the ids of runs: of a blank and the run, or of what follows a line feed at its beginning."""
        words, counts = [], []
        for run in runs:
            found = self.split.findall(run[1:] if run[0] == "\n" else " " + run)
            counts.append(len(found))
            words += found
        distinct = list(dict.fromkeys(words))
        spell = self.spelled.__getitem__
        ids = {w: b"".join(map(spell, i)) for w, i in zip(distinct, self.encode_words([w.encode() for w in distinct]), strict=True)}
        at = 0
        for run, n in zip(runs, counts, strict=True):
            self.memory[run] = ids[words[at]] if n == 1 else b"".join([ids[w] for w in words[at : at + n]])
            at += n

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        Where single blanks and line feeds are a text's only white space, the split at blanks never crosses a
        word, so each run of other characters is looked up as a whole; the words of other texts are found one by one.
        """
        plans = []
        for text in texts:
            parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
            plan: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    plan.append(np.array([self.special[part]], "<u4").tobytes())
                elif part:
                    plan.append(self._runs(part))
            plans.append(plan)
            if len(plans) >= 256:
                yield from self._spell(plans)
                plans = []
        yield from self._spell(plans)

    def _runs(self, text: str) -> list[str]:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text.endswith(" ") or ODD_SPACE.search(text):
            return ["\n" + w for w in self.split.findall(text)]
        runs: list[str] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                runs.append("\n\n")
            if line:
                words = line.split(" ")
                first = words[0]
                if first:
                    words[0] = "\n" + first
                    runs += words
                else:
                    runs += words[1:]
        return runs

    def _spell(self, plans: list[list]) -> Iterator[bytes]:
        runs: set[str] = set()
        for plan in plans:
            for part in plan:
                if not isinstance(part, bytes):
                    runs.update(part)
        new = runs.difference(self.memory)
        if new:
            if len(self.memory) + len(new) > MEMORY:
                self.memory.clear()
                new = runs
            self._learn(list(new))
        look = self.memory.__getitem__
        for plan in plans:
            yield b"".join([x if isinstance(x, bytes) else b"".join(map(look, x)) for x in plan])

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: White space other than line feeds and blanks.
ODD_SPACE = re.compile(r"[^\S\n ]")

_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids (little-endian unsigned 32-bit integers) of every whole text; null texts are empty.

    Texts stay in their partitions and are read in Arrow batches; no shuffle. Only key and text are read. Repeated rows
    are encoded as often as they occur; a text of any length is one row, held whole by its task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in small(batches):
            ids = list(c.encode_batch(t or "" for t in batch.column(1).to_pylist()))
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    chosen = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary").withColumnRenamed("id", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """encoded with the column decoded: the text of its ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in small(batches):
            texts = pa.array([c.decode(i) for i in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    chosen = encoded.select(F.col(f"`{key}`").alias("id"), "n_tokens", "ids")
    return chosen.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string").withColumnRenamed("id", key)


def op10_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
