"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# fits whose checks run above, and long ones
SLOW = {"lda_search", "full_analysis", "comparison_report", "paragraph_word_vectors", "kmeans_search"}
SLOW |= {"topic_terms", "doc_topics", "paragraph_svd"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sql = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    order = [sql.columns.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in sql.fetchall())
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_fits_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and list(rows[0].asDict()) == ["ticker", "jsd"]
