"""Weighted clustering, Merkle manifests and document fingerprints, against plain versions and on odd tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprint, kmeans, merkle

# ---- clustering ------------------------------------------------------------------------------------------------


def brute_lloyd(rows, clusters, rounds):
    kept = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows]
    first = sorted((hashlib.sha256(f"3:{k}".encode()).hexdigest(), q) for k, q in kept if k is not None)[:clusters]
    centroids = [q for _, q in first]
    best = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(best(q)[1], []).append(q)
        centroids = [[sum(x) // len(x) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    return sorted(((k, best(q)[1], best(q)[0]) for k, q in kept), key=str), centroids


@pytest.mark.parametrize("scale", [1.0, 5000.0])
def test_clusters_equal_brute_force(spark, scale):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1, 3]) * scale + rng.random() for _ in range(4)]) for i in range(120)]
    rows += [(500 + i, rows[7][1]) for i in range(300)] + [(7, rows[7][1]), (9, rows[3][1]), (None, [0.0] * 4)]
    odd = [(1000, None), (1001, [1.0] * 3), (1002, []), (1003, [1.0, None, 1.0, 1.0]), (1004, [float("nan"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(k, v, 7, 7) for k, v in rows + odd], "vec_id long, embedding array<double>, q int, n int").repartition(5)
    got = kmeans.cluster(df, 5, 6, 4)
    wanted, centroids = brute_lloyd(rows, 5, 6)
    found = got.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=str) == wanted
    assert {r.inertia for r in found} == {sum(d for _, _, d in wanted)}
    for r in found:
        assert r.cluster_inertia == sum(d for _, c, d in wanted if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_vectors_none_and_too_large(spark):
    shape = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 2.0])], shape)
    assert sorted((r.vec_id, r.distance) for r in kmeans.cluster(df, 8, 3, 2).collect()) == [(1, 0), (2, 0), (3, 0)]
    for nothing in (df.limit(0), df.where("vec_id > 5"), spark.createDataFrame([(None, [1.0, 2.0])], shape)):
        assert kmeans.cluster(nothing, 8, 3, 2).collect() == []
    with pytest.raises(Exception, match="too large"):
        kmeans.cluster(spark.createDataFrame([(1, [1e30, 2.0])], shape), 8, 3, 2).collect()


def test_exact_distances_of_large_components():
    x, c = np.array([[1 << 40, 3]]), np.array([[0, 0], [(1 << 40) - 5, 1]])
    best, far = kmeans.nearest(x, c)
    assert best.tolist() == [1] and int(far[0]) == 29


# ---- manifest --------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(level, fanout):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_path(levels, i, fanout):
    path = []
    for level in levels[:-1]:
        start = i // fanout * fanout
        path.append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
        i //= fanout
    return path


def plain_manifest(rows, fanout=2):
    """rows of (group, key, leaf, altered)"""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([r[2] for r in groups[g]], fanout) for g in names]
    over = plain_tree([t[-1][0] for t in trees], fanout)
    out = []
    for k, (g, tree) in enumerate(zip(names, trees)):
        for i, (_, key, leaf, altered) in enumerate(groups[g]):
            path = plain_path(tree, i, fanout) + plain_path(over, k, fanout)
            folded = altered
            for before, after in path:
                folded = H(before, folded, after)
            out.append((key, leaf, tree[-1][0], over[-1][0], H(*[a + b for a, b in path]), folded, folded == over[-1][0]))
    return sorted(out, key=str)


def leaves_frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "lang string, doc_id long, leaf string, altered string, pos int, digest string")


@pytest.mark.parametrize(("height", "fanout"), [(1, 2), (2, 2), (10, 2), (2, 3)])
def test_manifest_equals_plain_tree(spark, height, fanout):
    rng = random.Random(height)
    rows = []
    for lang, n in ((None, 1), ("", 2), ("de", 8), ("en", 70), ("fr", 5), ("é", 9), ("z", 16)):
        rows += [(lang, i, H(lang or "", str(i)), H(lang or "", str(i), *"!" * (i % 3 == 0))) for i in range(n)]
    rows += [rows[20]] * 6 + [("en", None, H("none"), H("none")), ("en", 3, H("again"), H("other"))]
    rng.shuffle(rows)
    got = merkle.manifest(leaves_frame(spark, rows).repartition(5), "lang", "doc_id", height, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows, fanout)
    assert {r.verified for r in got.collect()} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    rows = [("en", 4, H("a"), H("b"))]
    got = merkle.manifest(leaves_frame(spark, rows), "lang", "doc_id").collect()
    assert [tuple(r) for r in got] == [(4, H("a"), H("a"), H("a"), H(""), H("b"), False)]
    assert merkle.manifest(leaves_frame(spark, rows).limit(0), "lang", "doc_id").count() == 0


def test_leaves_of_documents(spark):
    rows = [(1, None, "en", 3, "é:1"), (None, "s", None, None, None), (7, "", "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    got = merkle.document_leaves(df, lambda k: k == 1).collect()
    wanted = {(r[2], r[0], H(*map(field, r)), H(*[field(v) for v in (*r[:3], r[3] + 1 if r[0] == 1 else r[3], r[4])])) for r in rows}
    assert {tuple(r) for r in got} == wanted


# ---- fingerprints ----------------------------------------------------------------------------------------------


def generalised_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / sum((a | b).values())


def prose(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))


def test_collisions_estimate_generalised_jaccard():
    rng = random.Random(2)
    sketch, errors = fingerprint.Sketcher(1024), []
    for n in (5, 40, 300, 3000):
        for share in (0.1, 0.5, 0.9):
            a = prose(rng, n)
            b = " ".join(a.split()[: int(n * share)]) + " " + prose(rng, n - int(n * share))
            x, y = sketch([a, b])
            errors.append(float((x == y).mean()) - generalised_jaccard(a, b))
    assert max(map(abs, errors)) < 0.06 and abs(sum(errors) / len(errors)) < 0.02


def test_samples_do_not_depend_on_the_company(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 50, 4000, 0, 700, 4000)]
    alone = [fingerprint.Sketcher()([t])[0].tolist() for t in texts]
    assert fingerprint.Sketcher()(texts).tolist() == alone
    monkeypatch.setattr(fingerprint, "CHUNK", 40)
    monkeypatch.setattr(fingerprint, "SLICE", 100)
    assert fingerprint.Sketcher()(texts).tolist() == alone
    assert alone[3] == [0] * fingerprint.SAMPLES


def test_words_and_counts():
    text = "a b\x0bA  a\na\té x " + "long" * 50
    hashes, counts = fingerprint.terms(text)
    assert sorted(counts.tolist()) == sorted(Counter(text.encode().split()).values())
    assert len(hashes) == len(set(hashes.tolist())) == 5
    assert [len(x) for x in fingerprint.terms(" \n")] == [0, 0] == [len(x) for x in fingerprint.terms("")]


def check_robustness(rows, got):
    sketch = fingerprint.Sketcher()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    wanted = []
    for i, (key, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + other[:k]
        a, b, c = sketch([text, changed, other])
        sha = hashlib.sha256(changed.encode()).hexdigest()
        wanted.append((key, len(text), sha, fingerprint.text_of(a), fingerprint.text_of(b), float((a == b).mean()), float((a == c).mean())))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_edits_equal_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    check_robustness([(r.doc_id, r.text) for r in docs.collect()], fingerprint.robustness(docs))


def test_edits_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "HELD", 50)
    rows = [(1, "one two three"), (2, None), (2, ""), (5, "x y"), (5, "x y"), (5, "😀 é 😀"), (None, "none here"), (None, "none too"), (9, "word " * 400)]
    shape = "doc_id long, text string, tie string, edge int, `a.b` int"
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], shape)
    for n in (1, 7):
        check_robustness(rows, fingerprint.robustness(df.repartition(n)))
    check_robustness(rows[:1], fingerprint.robustness(df.limit(1)))
    assert fingerprint.robustness(df.limit(0)).collect() == []
    odd = fingerprint.fingerprints(df.withColumnRenamed("doc_id", "x.y"), "x.y")
    assert odd.columns == ["x.y", "fingerprint"] and odd.count() == len(rows)


def test_likeness_of_columns(spark):
    a, b = fingerprint.Sketcher()(["a b c d e f", "a b c d x y"])
    df = spark.createDataFrame([(fingerprint.text_of(a), fingerprint.text_of(b)), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [float((a == b).mean()), None]
