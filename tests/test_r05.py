"""Loops of many short passes need no plan for each, and co-occurrences are counted once."""

import numpy as np

from weft.functions.treesum import held, held_sum, per_task
from weft.operators import embeddings as E


def test_held_rows_are_summed_in_a_tree(spark):
    def add(total, batch):
        total += np.array([batch.num_rows, sum(batch.column(0).to_pylist())])

    task = per_task(add, lambda: np.zeros(2, np.int64))
    rows = spark.range(1000, numPartitions=70)
    assert held_sum(held(rows), task, (2,), np.int64).tolist() == [1000, 499500]
    assert held_sum(held(rows.where("id < 0")), task, (2,), np.int64).tolist() == [0, 0]


def test_cooccurrence_counts_both_directions(spark):
    lines = [[1, 2, 1, 3, 3], [5], [4, 2, 2, 9, 1, 2]]
    expected: dict = {}
    for line in lines:
        for i, a in enumerate(line):
            for j, b in enumerate(line):
                if i != j and abs(i - j) <= 3:
                    expected[a, b] = expected.get((a, b), 0) + 1
    found = E.together(spark.createDataFrame([(x,) for x in lines], "path array<bigint>")).collect()
    assert {(r["a"], r["b"]): r["n"] for r in found} == expected and len(found) == len(expected)
