"""Every query that SQL can express equals its SQL on the smallest tables; the others run."""

import duckdb
import pytest

from tessera import queries as engine

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(None if v is None else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = engine.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in engine.ORACLE:
        assert rows
        return
    found = duck.sql(engine.ORACLE[name])
    assert sorted(found.columns) == columns
    assert plain(rows) == plain(found.select(*[f'"{c}"' for c in columns]).fetchall())


#: Blank lines at the start, between long ones and alone, other white space, a null.
TEXTS = [
    "", " ", "\n", "\na", "a\n ", "w " * 150 + "\n\n" + "v " * 150, None, "\n\n" + "w " * 150 + "\n\n", "\tx\t\n\th\r\nb\u00a0c", "\fa\u2028b\v\n\u00a0h\u2003\n#\n  # no",
]


@pytest.mark.parametrize("name", ["line_chunks", "markdown_sections"])
def test_odd_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = engine.QUERIES[name](spark, str(tmp_path))
    assert plain(df.collect()) == plain(c.sql(engine.ORACLE[name]).select(*df.columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["vec_id", "label", "similarity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
