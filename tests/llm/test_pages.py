"""HTML extraction and WARC archives."""

import base64
import hashlib
import re
import time
from html import unescape

import pytest
import zstandard

from tessera.llm import html, warc


@pytest.fixture(scope="module")
def model():
    return html.default_model()


def test_held_out_pages(model):
    pages = html.sample_pages(300, seed=99)
    got = html.main_texts([p for p, _ in pages], model)
    assert sum(g == t for g, (_, t) in zip(got, pages)) / len(pages) > 0.95


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    parents, kinds, depths = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 0, 1, 1, 1, 1]), np.array([0, 1, 1, 2, 2, 2])
    unary, pair = rng.normal(size=6), rng.normal(size=(2, 2, 2))
    p, both, log_z = html.propagate(unary, pair, parents, kinds, depths)
    weights = {y: np.exp(sum(unary[i] * y[i] for i in range(6)) + sum(pair[kinds[i], y[parents[i]], y[i]] for i in range(1, 6))) for y in itertools.product((0, 1), repeat=6)}
    z = sum(weights.values())
    assert np.isclose(np.log(z), log_z)
    for i in range(6):
        assert np.isclose(p[i], sum(w for y, w in weights.items() if y[i]) / z)
    assert np.isclose(both[3, 1, 0], sum(w for y, w in weights.items() if y[1] and not y[3]) / z)


def test_driver_pages_are_exact(spark, sf):
    got = {r.page_id: r for r in html.op1_dom_tree_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", "\n", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_odd_html(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain <words & more"), (4, "u", "<div><p title=it's>a<p>b<!-- x"), (5, "u", "<article><p>x</p>" * 3000), (None, "u", "<script>never closed <p>x"), (1, "u", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    got = html.extract(df, model).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert html.extract(df.limit(0), model).collect() == []
    text = html.main_texts(["<body><nav><a href=x>Home</a></nav><article><h1>A&amp;B&nbsp; c</h1><p>Caf&eacute;\n is  here, quite <b>so</b>.</p></article><footer>z</footer></body>"], model)[0]
    assert text == "A&B c\nCafé is here, quite so."


def test_unclosed_elements_cost_no_text(model):
    said = "Here is a sentence of some length, which belongs to the article and ends here."
    for tag in "button select object svg audio video canvas datalist math".split():
        page = f"<html><body><article><h1>Head</h1><p>{said}</p><{tag}>x<p>{said} Two.</p><p>{said} Three.</p></article></body></html>"
        dom = html.Dom(page)
        assert [t for t in dom.texts if t] == ["Head", said, said + " Two.", said + " Three."], tag
    assert [t for t in html.Dom("<head><title>t<body><p>a").texts if t] == ["a"]
    assert [t for t in html.Dom("<p>a<select><option>x</select><p>b<button>y</button>c<style>z").texts if t] == ["a", "bc"]


def test_hostile_pages_are_read_in_linear_time(model):
    n = 20_000
    pages = ["<title>" * n, "<head>" * n, "<ul>" * n, "<a " * n, "<a<" * n, "<a " * n + '">"', "<!" * n, "<!--" * n, "</p>" * n, "<li>" * n, "<p><ul>" * n, "<button>" * n, "</title" * n, "<script>" * n, "<a '\"" * n + ">", "<td><table>" * n, "<p class=" * n, "&amp" * n]
    for page in pages:
        start = time.monotonic()
        html.main_texts([page], model)
        assert time.monotonic() - start < 5, page[:20]


def test_archives_round_trip(spark, sf, tmp_path):
    pages = spark.createDataFrame(
        [(5, "http://a/ b\r\n", "same é"), (3, None, "same é"), (9, "u", "same é"), (9, "u", "same é"), (4, "u", None), (2, "u", ""), (8, "u", "x" * 300_000), (None, "u", "same é")], "page_id long, url string, html string"
    )
    folder = str(tmp_path / "warc")
    warc.write_archives(pages, folder, archive_bytes=200)
    got = warc.read_archives(spark, folder).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("5", "revisit", 3), ("3", "response", None), ("9", "revisit", 3), ("9", "revisit", 3), ("4", "revisit", 2), ("2", "response", None), ("8", "response", None), ("None", "revisit", 3)])
    for r in got:
        if r.page_id == 5:
            assert r.payload_bytes == 7 and r.payload_digest == base64.b32encode(hashlib.sha1("same é".encode()).digest()).decode() and "\r" not in r.url
    assert len(list((tmp_path / "warc").glob("part-*"))) > 1
    payloads = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert payloads[8] == b"x" * 300_000
    pages.limit(0).write.parquet(str(tmp_path / "none"))
    warc.write_archives(spark.read.parquet(str(tmp_path / "none")), str(tmp_path / "empty"))
    assert warc.read_archives(spark, str(tmp_path / "empty")).count() == 0


def test_min_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), min_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def archive(*frames):
    words = b"words of a dictionary that is long enough"
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    return warc.skippable(warc.DICTIONARY, words) + b"".join(c.compress(f) for f in frames)


def test_damaged_archives():
    good = warc.record(1, "http://x/", b"hello", base64.b32encode(hashlib.sha1(b"hello").digest()).decode(), False, None)
    data = archive(good, good)
    assert [warc.parse(r)["payload"] for r in warc.read_archive(data)] == [b"hello"] * 2
    for bad in (data[:-3], data[8:], data + b"junk", b""):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))
    for bad in (good.replace(b"hello", b"hellO"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), good[:-1], good.replace(b"WARC/1.1", b"WARC"), good.replace(b"response\r\nWARC-Rec", b"request\r\nWARC-Rec")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_query_equals_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for p in pages:
        first[p.html] = min(first.get(p.html, p.page_id), p.page_id)
    got = {r.page_id: r for r in warc.op3_warc_zstd(spark, sf).collect()}
    for p in pages:
        r, body = got[p.page_id], (p.html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))
