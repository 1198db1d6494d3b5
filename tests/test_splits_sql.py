"""Negatives of graphs beyond 3,000 nodes against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_module


@pytest.mark.parametrize("name", ["negative_sample", "labeled_pairs", "split_counts"])
def test_drawn_negatives_are_those_of_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT i // 2 AS l_orderkey, i + 1 AS l_suppkey, 'R' AS l_returnflag, 50.0 AS l_quantity FROM range(3202) t(i)
        UNION ALL SELECT 5000 + i // 2, CASE WHEN i % 2 = 0 THEN 1 ELSE 3 + i // 2 END, 'R', 50.0 FROM range(80) t(i)""")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = entry_module.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
