"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    relation = duck.sql(SQL[name])
    assert columns == sorted(relation.columns)
    place = [list(relation.columns).index(c) for c in columns]
    assert sorted(rows, key=str) == sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "n_sources", "context_chars", "context_sha256"]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("absent", ["public_tokenizers", "lexquarry.llm", "corpus_pipeline"])
def test_entry_without_the_optional_part(absent):
    """The library's own queries stay where the training-data part, or what it needs, can't be imported."""
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; names = set(e.queries()); assert 'bm25_topk' in names and 'op4_bpe' not in names and set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__)))
