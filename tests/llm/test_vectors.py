"""Codebooks and centroids against plain versions; both also have SQL oracles."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import centroids, codebooks, lloyd

SCHEMA = "vec_id bigint, embedding array<double>, label int, x int, code string, row_id bigint, n bigint"


def rows_of(vectors):
    return [(i, v, lab, None, "c", 0, None) for i, v, lab in vectors]


def sample(width, n=300, seed=4):
    """Vectors with clusters, copies, ties, null and repeated ids, and rows that are to be left out."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    out = [(i, [rng.gauss(m, 0.05) for m in rng.choice(middles)], rng.choice([0, 1, None])) for i in range(n)]
    out += [(1000 + k, out[7][1], 1) for k in range(n // 2)]  # a third of all rows
    out += [(5, out[5][1], 2), (5, out[9][1], 0), (None, out[11][1], None)]
    bad = [None, [], [0.1], [None] + [0.1] * (width - 1), [math.nan] * width, [math.inf] + [0.0] * (width - 1), [1e30] * width]
    return out, [(2000 + k, v, 0) for k, v in enumerate(bad)]


def floors(v):
    return tuple(math.floor(256 * x) for x in v)


def plain_lloyd(points, centres, rounds):
    """points: [(tuple, weight)]; all distances, ties to the smaller index."""
    nearest = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        member = [nearest(p)[1] for p in points]
        for k in range(len(centres)):
            mine = [p for p, m in zip(points, member) if m == k]
            if mine:
                centres[k] = tuple(sum(c) // len(mine) for c in zip(*mine))
    return centres, [nearest(p) for p in points]


@pytest.mark.parametrize("rounds", [0, 2, 6])
def test_codebooks_equal_plain_lloyd(spark, rounds):
    good, bad = sample(32)
    df = spark.createDataFrame(rows_of(good + bad), SCHEMA)
    coded, books = codebooks.compress(df, entries=20, rounds=rounds)
    got = {}
    for r in codebooks.with_label_error(coded).collect():
        got.setdefault((r["vec_id"], r["label"]), []).append((bytes(r["code"]), r["error"], r["label_error"]))
    kept = sorted(((i is None, i or 0, floors(v), lab) for i, v, lab in good), key=lambda x: x[:3])
    codes, errors = [[] for _ in kept], [0] * len(kept)
    for p in range(16):
        piece = [x[2][2 * p : 2 * p + 2] for x in kept]
        centres, found = plain_lloyd(piece, list(piece[:20]), rounds)
        assert books[p].tolist() == [list(c) for c in centres]
        for k, (d, e) in enumerate(found):
            codes[k].append(e)
            errors[k] += d
    by_label = {}
    for x, e in zip(kept, errors):
        by_label[x[3]] = by_label.get(x[3], 0) + e
    want = {}
    for x, c, e in zip(kept, codes, errors):
        want.setdefault((None if x[0] else x[1], x[3]), []).append((bytes(c), e, by_label[x[3]]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert codebooks.digest(books) == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_groups_are_skipped_and_ties_are_not():
    """Bounds rule groups out, and a part as near to a lower entry as to its own goes to the lower one."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 4, (400, 4)) + m for m in rng.integers(-200, 200, (30, 4))])
    books = np.stack([x[rng.permutation(len(x))[:60]]])
    groups = [codebooks.grouped(books[0], 6)]
    one = codebooks.Round(books, groups, None, None)
    a, best, low = one.first(0, x)
    stored = one.stored(0, low)
    after = lloyd.moved(books[0], lloyd.sums_of(x, a, 60))[None]
    two = codebooks.Round(after, groups, books, one.step)
    b, near, low, scanned = two.next(0, x, a, stored.astype(float))
    d = lloyd.squared(x, after[0])
    assert (b == d.argmin(1)).all() and (near == d.min(1)).all()
    assert scanned < 0.6 * d.size
    for g in range(two.count):
        others = np.where((groups[0] == g)[None] & (np.arange(60)[None] != b[:, None]), d, np.iinfo(np.int64).max).min(1)
        assert (low[:, g] <= np.sqrt(others.astype(float)) * (1 + 1e-9)).all()
    ties = np.array([[[0, 0], [4, 0], [2, 2], [2, -2]]])
    turn = codebooks.Round(ties, [np.array([0, 1, 2, 3])], ties, np.array([1.0]))
    got = turn.next(0, np.array([[2, 0]] * 2), np.array([3, 1]), np.full((2, 4), 2.0))
    assert got[0].tolist() == [0, 0]


def test_distances_are_exact_for_large_components():
    x, c = np.array([[1 << 29, 3]]), np.array([[-(1 << 29), 1], [(1 << 29) - 1, 3]])
    assert lloyd.squared(x, c).tolist() == [[(1 << 60) + 4, 1]]
    assert lloyd.moved(np.array([[5, 5], [7, 7]]), np.array([[3, -1, 4], [0, 0, 0]])).tolist() == [[-1, 1], [7, 7]]


def test_decoded_vectors_differ_by_the_error(spark):
    good, _ = sample(64)
    df = spark.createDataFrame(rows_of(good), SCHEMA)
    coded, books = codebooks.compress(df, rounds=4)
    given = {i: floors(v) for i, v, _ in good if i not in (None, 5)}
    found = [r for r in codebooks.decode(coded, books).collect() if r["vec_id"] in given]
    assert len(found) == len(good) - 4
    assert all(sum((256 * a - 0.5 - b) ** 2 for a, b in zip(r["decoded"], given[r["vec_id"]])) == r["error"] for r in found)


def test_centroids_equal_plain_lloyd(spark):
    good, bad = sample(64)
    bad += [(3000, [0.1] * 63, 0), (3001, [0.1] * 65, 0)]
    df = spark.createDataFrame(rows_of(good + bad), SCHEMA)
    found, centres = centroids.cluster(df, k=9, rounds=3)
    key = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    kept = sorted((key(i), floors(v), i) for i, v, _ in good)
    want_centres, near = plain_lloyd([x[1] for x in kept], [x[1] for x in kept[:9]], 3)
    assert centres.tolist() == [list(c) for c in want_centres]
    total, by = sum(d for d, _ in near), {}
    for d, k in near:
        by[k] = by.get(k, 0) + d
    want = [(x[2], k, d, by[k], total) for x, (d, k) in zip(kept, near)]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)
    named = centroids.hashes(found, centres).select("cluster", "centroid_sha256").distinct().collect()
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_centres[r["cluster"]])).encode()).hexdigest() for r in named)


def test_vectors_few_or_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    unusable = spark.createDataFrame(rows_of([(1, None, 0), (2, [math.nan] * 64, None)]), SCHEMA)
    for df in (none, unusable):
        coded, books = codebooks.compress(df)
        assert codebooks.with_label_error(coded).collect() == [] and books.size == 0
        assert coded.columns == ["vec_id", "label", "code", "error"]
        found, centres = centroids.cluster(df)
        assert found.collect() == [] and len(centres) == 0
    few = spark.createDataFrame(rows_of([(None, [0.5] * 64, None), (None, [0.5] * 64, None), (3, [-0.5] * 64, 1)]), SCHEMA)
    coded, books = codebooks.compress(few)
    assert books.shape == (16, 3, 4) and sorted(bytes(r["code"]) for r in coded.collect()) == [bytes(16), b"\1" * 16, b"\1" * 16]
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in centroids.cluster(few)[0].collect()} == {(3, 0, 0), (None, 1, 0)}
    with pytest.raises(ValueError):
        codebooks.compress(few, entries=300)


def test_queries_keep_every_usable_row(spark):
    from weft.llm import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").where(F.size("embedding") == 64).count()
    assert queries.op11_codebooks(spark, sf).count() == queries.op13_centroids(spark, sf).count() == n
