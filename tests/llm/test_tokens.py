"""BPE and packing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(bpe.vocabulary_path())


ODD = ["", " ", "  a  b ", "\n\n a\tb \n", "<|endoftext|>x<|endoftext|>", "a<|endoftext", "don't I'll  we've x　y", "日本語 中文", "😀😀 👨‍👩‍👧", "\x00\x01 \x7f", "a\r\nb", "aaaa" * 300, " " * 50 + "x", "x \n y", "x\n\ny", "١٢٣ ½ ²", "trail ", "trail\n", "\x85 \x1c x", "z" * 5000]


def samples():
    rng = random.Random(1)
    letters = "ab e't s\n\t .,!12é日 😀<|>THEing"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]


@pytest.mark.parametrize("kind", [bpe.Codec, packing.LibraryCodec])
def test_codecs_equal_the_library(tok, kind):
    c, texts = kind(bpe.vocabulary_path()), samples()
    for text, ids in zip(texts, c.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)
        assert c.decode(ids) == tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    assert c.decode(np.array([np.argmax([b == b"\xff" for b in c.bytes])], "<u4").tobytes()) == "�"


def test_compatibility_is_exact():
    c, rng = bpe.codec(bpe.vocabulary_path()), random.Random(2)
    a = np.array([rng.randrange(50_000) for _ in range(4000)])
    b = np.array([rng.choice([rng.randrange(50_000), rng.randrange(600)]) for _ in range(4000)])
    sound = c.sound[a] & c.sound[b]
    wanted = [c.merge(c.bytes[x] + c.bytes[y]) == [x, y] for x, y in zip(a, b)]
    assert (c.compatible(a, b)[sound] == np.array(wanted)[sound]).all()


def test_op10(spark, sf, tok):
    got = {r.doc_id: r for r in bpe.op10_bpe_speculate_verify(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nulls_and_empty_tables(spark):
    path = bpe.vocabulary_path()
    df = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "x", 5), (2, "x", 5)], "doc_id long, text string, ids int")
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.encode(df, path).collect()) == [("1", 0), ("2", 1), ("2", 1), ("None", 0)]
    assert bpe.decode(bpe.encode(df.limit(0), path), path).count() == 0
    assert packing.pack(df.limit(0), path).count() == 0
    assert packing.pack(df, path).count() >= 4
    assert packing.pack(df.withColumn("doc_id", F.struct("doc_id")), path).count() >= 4
    odd = df.withColumnRenamed("doc_id", "a.b")
    assert bpe.decode(bpe.encode(odd, path, "a.b"), path, "a.b").columns == ["a.b", "n_tokens", "ids", "decoded"]


def brute(ends, costs, window):
    places, f = [0, *ends], [0]
    for i in range(1, len(places)):
        f.append(min(f[j] + window - (places[i] - places[j]) + costs[i - 1] for j in range(i) if places[i] - places[j] <= window))
    return f[-1]


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(300):
        window, ends, costs = rng.choice([8, 16, 64]), [], []
        for _ in range(rng.randint(1, 60)):
            ends.append((ends[-1] if ends else 0) + rng.randint(1, window))
            costs.append(rng.choice([0, 2, 8]))
        at = total = 0
        for i in packing.best_cuts(ends, costs, window):
            total += window - (ends[i] - at) + costs[i]
            assert 0 < ends[i] - at <= window
            at = ends[i]
        assert at == ends[-1] and total == brute(ends, costs, window)


def test_offered_cuts_cover_the_stream():
    rng = np.random.default_rng(0)
    kinds = np.zeros(100, np.uint8)
    kinds[7], kinds[8] = packing.SENTENCE, packing.CLAUSE
    for n in (1, 5, 400, 3000):
        ids = rng.integers(0, 100, n)
        ids[n // 2 : n // 2 + 200][ids[n // 2 : n // 2 + 200] < 9] = 50
        ends, costs = packing.offered_cuts(ids, kinds, np.array([n]), long=32, window=64)
        gaps = np.diff(np.concatenate(([0], ends)))
        assert ends[-1] == n and costs[-1] == 0 and (gaps <= 64).all()
        around = lambda e, marks: min(m for m in marks if m > e) - max(m for m in marks if m < e)
        sentences = {0, n, *(np.flatnonzero(ids == 7) + 1).tolist()}
        clauses = sentences | {e for e in ends.tolist() if ids[e - 1] == 8}
        for e, cost in zip(ends[:-1].tolist(), costs.tolist()):
            if ids[e - 1] == 7:
                assert cost == packing.PENALTIES[1]
            elif ids[e - 1] == 8 and cost == packing.PENALTIES[2]:
                assert around(e, sentences) > 32
            else:  # elsewhere only where no window holds the sentence or its clauses
                assert cost == packing.PENALTIES[3] and around(e, clauses - {e}) > 64
        # every end of a clause in a long sentence is offered
        assert all(e in set(ends.tolist()) for e in (np.flatnonzero(ids == 8) + 1).tolist() if e not in sentences and around(e, sentences) > 32)


def test_op5(spark, sf, tok):
    rows = packing.op5_order_preserving_packing(spark, sf).toPandas()
    docs = {d.doc_id: [*tok.encode(d.text or "", add_special_tokens=False).ids, 0] for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for key, part in rows.sort_values("start").groupby("doc_id"):
        at = 0
        for r in part.itertuples():
            assert r.start == at and r.doc_tokens == len(docs[key])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(docs[key][r.start : at], "<u4").tobytes())
        assert at == len(docs.pop(key))
    assert not docs
    sizes = []
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in part.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 1024
        sizes.append(at)
    assert sum(sizes) / (1024 * len(sizes)) > 0.97


def test_blocks_keep_order():
    ends_sentence = np.zeros(50, np.uint8)
    ends_sentence[3] = packing.SENTENCE
    rng, docs = np.random.default_rng(1), []
    p, out = packing.Packer(ends_sentence, 100, 64, 256), []
    for k in range(60):
        docs.append(rng.integers(0, 50, int(rng.integers(1, 900 if k == 7 else 40))).astype("<u4"))
        out += p.add(k, docs[-1])
    out += p.flush()
    assert np.array_equal(np.concatenate([x[2] for x in out]), np.concatenate(docs))
    assert [x[4] for x in out] == sorted(x[4] for x in out)
