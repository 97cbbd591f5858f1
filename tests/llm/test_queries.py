"""The registered queries: their SQL twins, their contract columns, and every row of their tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from pagemill.llm import queries

DATA = "/root/testdata/sf0.001"
FIRST_COLUMNS = {
    "op1_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_vectors": ["vec_id", "n_links", "component_id", "kept"],
    "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_html_text": ["page_id", "url", "text", "n_chars"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_passages": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}
TABLE = {"op3_vectors": "embeddings", "op6_warc": "pages", "op7_html_text": "pages"}


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}{'/part-*' if os.path.isdir(f'{folder}/{name}') else ''}')")
    return con


def agree(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = connect(folder).execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert got == want
    return want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert agree(spark, DATA, name)


def planted():
    """Texts that share passages of words and of bytes, repeated in one document and across documents, null and empty."""
    run = " ".join(f"wörd{k}" for k in range(20))
    long_word = "é" * 40
    return [
        (0, f"start {run} end"), (1, f"{run}\tother tail"), (2, f"no {run} yes {run}"), (3, None), (4, ""), (5, " \n "),
        (6, long_word), (7, "x" + long_word + "y"), (8, "ab" * 60), (9, "ab" * 30 + "c" + "ba" * 30), (10, run[:-1] + "!"),
        (11, " ".join(["same"] * 30)), (12, " ".join(["same"] * 13)), (13, run.replace(" ", " ")), (14, "z" * 50), (15, "z" * 49),
    ]


def test_twins_on_planted_rows(spark, tmp_path):
    """Cases that the small tables lack; every twin must see removed, linked or revisited rows in them."""
    folder = str(tmp_path)
    spark.createDataFrame(planted(), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    pages = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (7, "u", None), (5, "u", ""), (9, "u", "é" * 20000), (8, "u", "é" * 20000), (3, "u", "b")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    axis = [1.0] + [0.0] * 7
    tilted = [0.95, 0.3] + [0.0] * 6
    vectors = [(1, axis), (2, tilted), (3, [0.8, 0.58] + [0.0] * 6), (4, [0.0] * 8), (5, None), (6, [float("nan")] + [0.0] * 7), (7, axis), (8, [-1.0] + [0.0] * 7), (9, [None] + [1.0] * 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    for name in queries.oracle_sql():
        assert len(set(agree(spark, folder, name))) > 5, name


@pytest.mark.parametrize("name", sorted(FIRST_COLUMNS))
def test_contract_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns[: len(FIRST_COLUMNS[name])] == FIRST_COLUMNS[name]
    key = FIRST_COLUMNS[name][0]
    rows = spark.read.parquet(f"{DATA}/{TABLE.get(name, 'documents')}.parquet").select(key)
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in rows.collect())


def test_pipeline_has_no_twin():
    assert corpus_pipeline.ORACLE_SQL is None
