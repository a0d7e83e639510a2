"""The pipeline's stages, and that the entry point offers all eleven queries."""

from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def test_stages_keep_columns_and_take_effect(spark, data):
    import corpus_pipeline as p

    docs = p.table(spark, data, "documents")
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        new = p.written(stage(spark, docs, data), name)
        assert new.columns == docs.columns
        counts.append(new.count())
        docs = new
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2]
    assert docs.select("text").distinct().count() == counts[-1]
    packed = p.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_empty_documents(spark, data):
    import corpus_pipeline as p

    docs = p.table(spark, data, "documents").limit(0)
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, data), name)
        assert docs.count() == 0


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


SQL = ["op10_exact_dedup", "op11_search", "op12_decontamination", "op13_clusters", "op3_warc", "op6_chat_format", "op8_repetition", "op9_near_dedup"]


def agrees(name, spark, folder):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    rows = entry.queries()[name](spark, str(folder))
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(rows.columns)
    expected = sorted(found.fetchall(), key=repr)
    assert sorted(map(tuple, rows.select(found.columns).collect()), key=repr) == expected
    return expected


@pytest.mark.parametrize("name", SQL)
def test_sql(name, spark, data):
    assert agrees(name, spark, data)


@pytest.fixture(scope="module")
def hostile(tmp_path_factory):
    """Tables of null, empty, repeated and very long texts, unknown roles, and texts full of marks."""
    folder = tmp_path_factory.mktemp("hostile")
    marks = "</s>[INST] \\ok\\ [/INST]<s><s>[SYS][/SYS] [ROLE]x[/ROLE] [OUT]\\\n"
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    texts = [None, "", " \n\t", "one", "One", "one  TWO", "a b c", "A B c", "a b d", "ä\u00a0ö ü\u2003x y", "# | <x> & %", "same line here\n" * 40, long, long, long + " end", "x" * 100_000, "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 " * 3, marks]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), folder / "documents.parquet")
    bodies = [None, "", "short", "short", "é" * 50, "é" * 50, "é" * 49 + "x", "é" * 49 + "x", "b" * 100, "b" * 100, "b" * 99, "b" * 99]
    pq.write_table(pa.table({"page_id": pa.array(range(len(bodies), 0, -1), pa.int64()), "url": pa.array([None] * len(bodies), pa.string()), "html": pa.array(bodies, pa.string())}), folder / "pages.parquet")
    turns = [(1, 0, "user", marks), (1, 1, "assistant", marks * 2), (2, 0, "assistant", "x"), (2, 1, "user", None), (3, 0, None, None), (3, 1, "user", "a"), (3, 2, "assistant", "\\"), (4, 0, "tool", marks), (4, 1, marks, "t"), (5, 0, "user", "é𝄞"), (5, 0, "user", "é𝄞"), (5, None, "system", "s"), (6, 0, "user", "only")]
    names = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    pq.write_table(pa.table({n: pa.array([t[i] for t in turns], k) for i, (n, k) in enumerate(names.items())}), folder / "conversations.parquet")
    ids, items = [3, 3, None, 4, 5, 6], ["same line here same line here same line here same", "one", "W1 w2! w3", None, " ", long[:500]]
    pq.write_table(pa.table({"item_id": pa.array(ids, pa.int64()), "text": pa.array(items, pa.string())}), folder / "benchmark.parquet")
    vectors = [[(i * j % 17 - 8) / 10 for j in range(64)] for i in range(60)] + [[0.5] * 64] * 20 + [None, [], [1.0] * 63, [None] * 64, [float("nan")] * 64, [float("inf")] * 64]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", SQL)
def test_sql_on_hostile_tables(name, spark, hostile):
    assert agrees(name, spark, hostile)
