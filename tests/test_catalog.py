"""Every registered query over the star schema gives the rows of its SQL."""

import pytest
from vicinage.plans import catalog


def rows_of(columns, rows):
    return sorted(tuple(x if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = rows_of(columns, (tuple(r[c] for c in columns) for r in df.collect()))
    expected = rows_of(columns, (tuple(r[i] for i in at) for r in want.fetchall()))
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert [x for x in a if isinstance(x, str)] == [x for x in b if isinstance(x, str)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], abs=2e-6)


def test_queries_without_sql_take_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 700").count()
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", "embedding").union(spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id + 10000", "reverse(embedding)"))
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    points.write.parquet(f"{folder}/embeddings.parquet")
    found = catalog.QUERIES["louvain_clusters"](spark, folder)
    assert found.filter("view = 'a'").select("node").distinct().count() == 2 * n
    assert catalog.QUERIES["snf_full"](spark, folder).select("src").distinct().count() == 2 * n


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).take(1)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
