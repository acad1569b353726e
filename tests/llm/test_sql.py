"""The queries that SQL can express against their SQL, run by DuckDB on the same files and on odd rows."""

import duckdb
import pytest

from tessera.llm import registry


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in "documents embeddings pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'" if folder.endswith("odd") else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = registry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    wanted = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == wanted
    return len(wanted)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, name) > 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables") / "odd")
    line = "Some words of a line that comes again and again in this text.\n"
    prose = " ".join(f"w{i}" for i in range(50))
    texts = [None, "", " \n", line * 4, "a b c d e f g h " * 9, "É! É! " * 30, "<|[\\]|>" * 9, prose, prose, prose + " x", prose + " y z", "one two", "one  two", "😀 " * 25]
    docs = [(i, t, [None, "en", "é", ""][i % 3 if i < 12 else 3], None if i % 5 == 0 else "s:1", None if t is None or i == 4 else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [float((i * k) % 17 - 8) / 3 for k in range(4)]) for i in range(0, 260, 4)] + [(1, None), (200_000, [1.0, None, 2.0, 3.0]), (300_000, [float("nan")] * 4), (3, [1.0])]
    vectors += [(i, [float((i % 40 * k) % 23 - 11) / 3 for k in range(64)]) for i in range(1_000_001, 1_000_101)] + [(None, [0.5] * 64), (2_000_001, [1e4] * 63 + [-1e4]), (2_000_003, [1.0] * 63 + [float("-inf")]), (2_000_005, [1.0] * 63 + [None])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, "u", t) for i, t in enumerate([None, "", "same", "same", "é" * 9, "same", "x" * 5000])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a\\<[b"), (1, 2, "user", "[["), (2, 0, None, "x"), (2, None, "assistant", "é😀"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_odd_rows_equal_sql(spark, odd, name):
    assert compare(spark, odd, name) > 0
