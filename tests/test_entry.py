import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SAMPLE = ["edge_scan", "common_neighbors", "degree_distribution", "emb_cosine_sim", "recommend_topk"]


def test_names():
    names = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(names)
    assert set(SAMPLE) <= set(names)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "embeddings", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    expected = sorted((str(r) for r in want.fetchall()))
    got = entry_module.queries()[name](spark, SF).select(*columns)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
