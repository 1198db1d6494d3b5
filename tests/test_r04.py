"""What the fourth look asked for: pairs of all nodes that never move, exact closeness by bitmaps, customers paired once, bounded draws."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from weft.operators import allpairs as P
from weft.operators import features as X
from weft.operators import graph as G
from weft.operators import serve as R
from weft.sources.scratch import materialize


def save(df):
    return materialize(df, "test")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_all_nodes_never_move(spark, graph, monkeypatch):
    monkeypatch.setattr(P, "PART", 3)
    edges = save(graph([(0, k) for k in range(1, 9)] + [(1, 2), (2, 3), (20, 21), (21, 22)]))
    ids = sorted(r["id"] for r in G.nodes(edges).collect())
    pairs = save(graph([(a, b) for a in ids for b in ids if a < b]))
    score = lambda df: df.withColumn("probability", df.resource_allocation)
    for got, want in (
        (P.has_edge(edges, save), G.has_edge(edges, pairs)),
        (P.local_features(edges, save), X.local_features(edges, pairs)),
        (P.mutual_friends(edges, save), R.mutual_friends(edges, pairs)),
        (R.analyzed(score(P.linked_features(edges, save, lists=True))), R.analyze_pairs(edges, pairs, score)),
        (R.whole_matrix(edges, score, save), R.pair_matrix(edges, G.nodes(edges), score)),
    ):
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert not re.search(r"hashpartitioning\(u#\d+L?, v#", plan(got))


def test_closeness_is_that_of_all_distances(graph, monkeypatch):
    from weft.operators import analytics as A

    monkeypatch.setattr(A, "WORDS", 1)  # 64 nodes a row: several rows a node
    edges = save(graph([(k, k + 1) for k in range(70)] + [(3, 40), (100, 101), (101, 102)]))
    got = {r["id"]: (r["s"], r["r"]) for r in A.hop_sums(edges, save).collect()}
    want = {r["src"]: (r["s"], r["r"]) for r in A.distances(edges, save).groupBy("src").agg({"dist": "sum", "id": "count"}).toDF("src", "s", "r").collect()}
    assert got == want and len(got) == 74


@pytest.mark.parametrize("part", [2, 1024])
def test_pairs_of_groups_come_once_and_never_move(spark, monkeypatch, part):
    from weft.sources import edges as src

    monkeypatch.setattr(src, "GROUP_PART", part)
    rows = [(g, p) for g, ps in enumerate([[1, 2, 3, 4], [2, 3, 9], [3, 2, 4], [7], [20, 21]]) for p in ps]
    got = src.group_pairs(save(spark.createDataFrame(rows, "g bigint, p bigint")))
    pairs = [tuple(r) for r in got.collect()]
    assert sorted(pairs) == sorted({(a, b) for g, a in rows for h, b in rows if g == h and a < b})
    assert not re.search(r"hashpartitioning\(u#\d+L?, v#", plan(got))


def test_forests_of_the_sql_have_no_depth(spark, tmp_path):
    """A path of 16 suppliers: the SQL's forest ended after 12 levels."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT i // 2 AS l_orderkey, (i + 1) // 2 + 1 AS l_suppkey, 'R' AS l_returnflag, 50.0 AS l_quantity FROM range(30) t(i)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = entry_module.queries()["spanning_forest"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry_module.oracle_sql()['spanning_forest']})").fetchall()
    assert len(want) == 15 and sorted(map(tuple, got.collect())) == sorted(want)


def test_draws_of_users_are_dealt_to_a_number_of_tasks(spark, graph):
    edges = save(graph([(k, k + 1) for k in range(12)] + [(0, k) for k in range(2, 9)]))
    got = R.fill(edges, G.nodes(edges), most=2)
    assert "REPARTITION_BY_NUM" in plan(got)
    assert not re.search(r"hashpartitioning\(user#\d+L?, few", plan(got))
    hub = [r for r in got.collect() if r["user"] == 0]
    assert {r["candidate"] for r in hub} <= set(range(9, 13)) and [r["place"] for r in sorted(hub)] and len(hub) == 2


def test_blocks_and_walks_are_not_broadcast(graph):
    from weft.operators import blocks
    from weft.operators import embeddings as E

    plans = []

    def watched(df):
        plans.append(plan(df))
        return save(df)

    edges = save(graph([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (3, 4), (4, 5)]))
    entries = save(E.laplacian(edges))
    blocks.leading_eigen(entries, 2, 2.0, watched, rounds=1)
    blocks.singular(entries, 2, watched, rounds=1)
    assert len(plans) > 8 and not any("BroadcastHashJoin" in p for p in plans)
    plans.clear()
    E.rejection_walks(edges, watched, 1, 3, p=0.5, q=2.0).collect()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans[2:])
