import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    letters = {"en": "etaoinshr", "de": "enirsatdu", "fr": "esaitnrul", "es": "eaosrnidl"}
    lexicon = {lang: ["".join(rng.choice(x) for _ in range(rng.randint(2, 7))) for _ in range(300)] for lang, x in letters.items()}
    say = lambda lang, n: " ".join(rng.choice(lexicon[lang]) for _ in range(n))
    items = [(k, say("en", 30)) for k in range(5)]
    rows = []
    for i in range(120):
        lang = ("en", "de", "fr", "es")[i % 4]
        rows.append((i, say(lang, rng.randint(60, 120)), lang if i % 5 else None, f"s{i % 4}" if i % 11 else None))
    rows += [(200 + k, rows[k][1], "en", "s1") for k in range(10)]
    for k in range(10, 20):
        w = rows[k][1].split()
        w[len(w) // 2] = "edit"
        rows.append((210 + k, " ".join(w), "en", "s2"))
    rows += [(300 + k, say("en", 40) + " " + items[k][1] + " " + say("en", 40), "en", "s0") for k in range(5)]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, "123 !?", "en", "s0"), (5, rows[5][1], rows[5][2], rows[5][3])]
    folder = tmp_path_factory.mktemp("sf")
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_pipeline(spark, tables):
    folder, rows, items = tables
    known = {r[0]: r for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    first = {}
    for i in sorted(known):
        first.setdefault(known[i][1], i)
    exact = {i: known[i][1] for i in first.values()}
    near = {i for i, (_, c) in brute.components(list(exact.items()), 5, 80).items() if i == c}
    bad = {i for i, _ in brute.holds([(i, exact[i]) for i in near], items)}
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in got}
    assert len(kept) == len(got)
    expected = near - bad
    assert bad == {300, 301, 302, 303, 304}
    assert kept <= expected
    # The mix leaves out what lies behind a source's cut only.
    target = {r["source"]: r["target"] for r in got}
    for source in {known[i][3] for i in expected}:
        size = sum(len(brute.words(known[i][1])) for i in expected if known[i][3] == source)
        taken = sum(r["taken"] for r in got if r["source"] == source)
        assert abs(taken - target[source]) < 1 and target[source] <= 2 * size + 1e-6
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_stage_columns(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0


def test_null_and_repeated_ids(spark, tables):
    """Stages decide about rows: a null id loses nothing, a repeated one brings nothing back."""
    folder, rows, items = tables
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(n))
    a, b, c, d, e = (say(80) for _ in range(5))
    docs = lambda *x: spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in x], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = lambda stage, *x: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs(*x), folder).collect()), key=str)
    want = lambda *x: sorted(x, key=str)
    # Document 7 has a text of its own, and a copy of document 3's; the rows without id have c and, twice, d.
    given = (3, a), (7, a), (7, b), (None, c), (None, d), (None, d), (None, a)
    assert out(corpus_pipeline.exact, *given) == want((3, a), (7, b), (None, c), (None, d))
    edited = a.split()
    edited[40] = "edit"
    edited = " ".join(edited)
    assert out(corpus_pipeline.near, (3, a), (7, edited), (7, b), (None, c), (None, d)) == want((3, a), (7, b), (None, c), (None, d))
    assert out(corpus_pipeline.near, (None, a), (7, edited)) == want((7, edited))
    held = e + " " + items[0][1] + " " + e
    assert out(corpus_pipeline.decontaminated, (7, held), (7, b), (None, held), (None, c)) == want((7, b), (None, c))
    mixed = corpus_pipeline.mixed(spark, docs((7, b), (7, a), (None, c), (None, d)), folder).collect()
    assert want(*((r["doc_id"], r["text"]) for r in mixed)) == want((7, b), (7, a), (None, c), (None, d))
    assert sum(r["taken"] for r in mixed) == int(mixed[0]["target"])
