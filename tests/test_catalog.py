"""Every registered query against its SQL on the smallest tables, value by value."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    return "" if v is None else ("nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v))


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    res = duck.execute(ORACLES[name])
    have = [c[0] for c in res.description]
    assert sorted(have) == columns
    assert got == sorted(tuple(shown(r[have.index(c)]) for c in columns) for r in res.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"quote_location"}))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_quotes_with_a_few_words_changed_are_located(spark, tmp_path):
    quote = "the quick brown fox jumps over the lazy dog while seven old men watch from the long stone wall"
    near = quote.replace("lazy", "sleepy").replace("seven", "nine")
    docs = [(1, f"before it all {near} and after", "en", "s", 1), (2, "nothing of the kind", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, quote)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.asDict() for r in QUERIES["quote_location"](spark, str(tmp_path)).collect()]
    assert [(r["row"], r["response_id"], r["mode"]) for r in got] == [(7, 1, "fuzzy")]


@needs_data
def test_embedding_and_loop_read_documents(spark):
    documents = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in QUERIES["lexical_embedding"](spark, DATA).collect()} == documents
    created = QUERIES["coding_loop"](spark, DATA).collect()
    assert created and {r["response_id"] for r in created} <= documents
