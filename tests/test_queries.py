"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from siltstone.queries import core


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or isinstance(v, float) and v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{small_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, small_dir, duck, name):
    got = core.QUERIES[name](spark, small_dir).toPandas()
    assert name in core.SQL
    want = duck.execute(core.SQL[name]).fetch_df()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


#: Few files and questions, most with numbers that a cut by remainder would leave out.
FEW = {
    "search_hits": "select * from (values (1, 'red blue'), (1, 'red blue'), (7, 'green'), (8, 'red green'), (19, 'blue red'), (20, 'blue red'), (21, null), (23, 'nowhere')) t(query_id, query_text)",
    "catalog_records": "select i::bigint as id, i || '.md' as relative_path, '/' || i || '.md' as absolute_path, 'extracted' as status from range(1, 9) t(i)",
    "catalog_chunks": """select n::bigint as id, e::bigint as entry_id, k::int as chunk_index, case when k = 0 then e || '.md' end as relative_path, content, null::varchar as ngrams
      from (values (1, 1, 0, 'red blue'), (2, 2, 0, 'red'), (3, 2, 1, 'blue'), (4, 3, 0, 'green red'), (4, 3, 0, 'green red')) t(n, e, k, content)
      union all select i, i, 0, i || '.md', 'other words', null from range(5, 9) t(i)""",
}


@pytest.mark.parametrize("name, want", [("best_chunk_per_file", {(1, 1), (7, 3), (8, 3), (19, 1), (20, 1)}), ("cross_chunk_intersect", {(1, 1), (1, 2), (8, 3), (19, 1), (19, 2), (20, 1), (20, 2)})])
def test_all_questions_are_asked(spark, tmp_path, name, want):
    con = duckdb.connect()
    for table, rows in FEW.items():
        con.execute(f"copy ({rows}) to '{tmp_path}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet')")
    got = core.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert set(zip(got.query_id, got.entry_id)) == want and len(got) == len(want)
    pd.testing.assert_frame_equal(normal(got), normal(con.execute(core.SQL[name]).fetch_df()), check_dtype=False)


def test_entry_runs(spark, small_dir):
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
