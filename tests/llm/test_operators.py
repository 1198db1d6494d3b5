import gzip
import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from weft.llm import decontaminate, exact_dedup, html_extract, langid, licenses, mixing, ngram_join, passages, substrings, warc
from weft.llm.textnum import shingles, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row_id bigint"


def vocabulary(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


WORDS = vocabulary(800)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Null, empty, short, long, equal, edited and passage-sharing texts."""
    rng = random.Random(11)
    base = [prose(rng, 150) for _ in range(8)]
    shared = prose(rng, 70)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "!!! 123"), (6, prose(rng, 3000))]
    for k, text in enumerate(base):
        w = text.split()
        w[75] = "changed"
        rows += [(10 + 10 * k, text), (11 + 10 * k, text), (12 + 10 * k, " ".join(w))]
        rows.append((13 + 10 * k, prose(rng, 60) + " " + shared + " " + prose(rng, 40)))
    rows += [(200 + k, base[0]) for k in range(30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With further columns whose names clash with those of results, and nulls in them."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, "x", i) for i, t in corpus]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles():
    raw = "Ab  c\td".encode() + b"" + "é x".encode()
    off = np.array([0, 7, 7, len(raw)])
    w = words(np.frombuffer(raw, np.uint8), off)
    assert w.first.tolist() == [0, 3, 3, 5]
    again = words(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    assert again.hash[0] == w.hash[0]
    code, first = shingles(w, 2)
    assert first.tolist() == [0, 2, 2, 3] and len(set(code.tolist())) == 3


def test_substrings(spark, corpus, docs, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup_substrings(docs).collect()}
    assert got == brute.removed(corpus)
    few = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup_substrings(docs, hot=2).collect()}
    assert few == got
    assert substrings.dedup_substrings(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"ab", b"abc", b"b", b"\x00", b"abcabcabcabcabcabcabcabcabc"]), max_size=8), min_size=1, max_size=30))
def test_deep_shallow_order(parts):
    strings = [b"".join(p) for p in parts]
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    start = np.cumsum(size) - size
    order, lcp = substrings.sort_strings(np.zeros(len(strings), int), data, start, size, shallow=8)
    ordered = [strings[k] for k in order]
    assert ordered == sorted(strings)
    for a, b, n in zip(ordered, ordered[1:], lcp[1:]):
        assert n == substrings.common_prefix(a, b)


def test_mixing(docs, empty):
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    taken, target = {}, {}
    for r in rows.values():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    total = sum(r["size"] for r in rows.values())
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()} == {i: r["taken"] for i, r in rows.items()}
    assert rows[0]["taken"] == 0
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(corpus, docs, empty, keep):
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    best = {i: (min if keep == "min" else max)(g) for g in groups.values() for i in g}
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, keep=keep).collect()}
    assert {i: r["keep_id"] for i, r in got.items()} == best
    assert all(r["kept"] == (i == best[i]) and r["group_size"] == len(groups[dict(corpus)[i] or ""]) for i, r in got.items())
    assert exact_dedup.exact_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs, keep="first")


def test_exact_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (None, "b"), (3, "b")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect())
    assert got == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def test_exact_many_tasks(spark):
    """A group of copies that spreads over all tasks."""
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) as text")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = exact_dedup.exact_dedup(rows).groupBy("group_size", "kept").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {tuple(r) for r in got} == {(1000, True, 1), (1000, False, 999), (1, True, 2000)}


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x y\n", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "v", "z" * 50_000), (None, "w", "<p>é"), (6, "v", "only")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder, shard_bytes=20_000, roll_bytes=300)
    (tmp_path / "w" / "pages-999999-00000.warc.gz").write_bytes(b"not listed")
    got = {r["page_id"]: r for r in warc.read(spark, folder, manifest, payloads=True).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw)
        assert got[i]["payload_digest"] == warc.base32(__import__("hashlib").sha1(raw).digest())
        assert got[i]["payload"] == (raw if got[i]["record_type"] == "response" else None)
    assert {i: r["refers_to"] for i, r in got.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, None: 1, 6: None}
    again = warc.write(pages.repartition(3), f"file://{tmp_path}/w2", shard_bytes=20_000, roll_bytes=300)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    text = gzip.decompress(next(p for p in (tmp_path / "w2").glob("*.gz")).read_bytes())
    assert text.startswith(b"WARC/1.1\r\n")
    assert not list((tmp_path / "w2").glob("_tmp*"))
    none = warc.write(pages.limit(0), f"file://{tmp_path}/w3")
    assert none.count() == 0 and warc.read(spark, f"file://{tmp_path}/w3", none).count() == 0
    least = warc.write(pages, f"file://{tmp_path}/w4", least_revisit=10)
    assert warc.read(spark, f"file://{tmp_path}/w4", least).where("record_type = 'revisit'").count() == 0


def test_warc_record_ids_are_unique(spark, tmp_path):
    """Repeated and null page ids have record ids of their own, and revisits refer to one that exists."""
    rows = [(1, "u1", "<p>a"), (1, "u1", "<p>a"), (1, "u2", "<p>a"), (1, "u1", "<p>b"), (None, "u3", "<p>a"), (None, "u4", "<p>a"), (None, "u4", "<p>a"), (None, None, None), (2, None, None), (3, "u5", "<p>a")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/ids", least_revisit=0)
    heads = [h for r in manifest.collect() for h, _ in warc.records((tmp_path / "ids" / r["file"]).read_bytes())]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(rows) == len(set(ids))
    responses = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert revisits and all(h["WARC-Refers-To"] in responses and "WARC-Refers-To-Date" in h for h in revisits)


def test_langid(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(table.where("not held_out"))
    got = langid.identify(table.select("doc_id", "held_out", "text", "lang"), model)
    test = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert test[0] >= 0.95 and 0 <= test[1] and test[2] <= 1
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert {odd[i] for i in (0, 1, 2, 5)} == {"und"} and odd[3] != "und"
    blank = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text"), blank).collect()} == {"und"}
    one = langid.train(docs)
    assert {r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text"), one).collect()} == {"und", "en"}
    # A text's prediction doesn't depend on its neighbours in the batch.
    alone = langid.identify(table.where("doc_id = 7").select("doc_id", "text"), model).first()
    assert got.where("doc_id = 7").first()["score"] == pytest.approx(alone["score"], abs=1e-6)


def test_decontaminate(spark, docs, corpus, empty):
    rng = random.Random(3)
    items = [(k, prose(rng, 12 + 4 * k)) for k in range(10)] + [(20, None), (21, ""), (22, "alpha beta"), (23, "?!")]
    rows = list(corpus)
    for k in range(10):
        w = items[k][1].split()
        edits = rng.sample(range(len(w)), len(w) // 5)
        edited = ["edited" if j in edits else x for j, x in enumerate(w)]
        rows += [(500 + k, prose(rng, 30) + " " + items[k][1].upper() + ". " + prose(rng, 30)), (600 + k, prose(rng, 30) + " " + " ".join(edited) + " " + prose(rng, 30))]
        w[::2] = ["no"] * len(w[::2])
        rows.append((700 + k, " ".join(w)))
    rows += [(800, "so ALPHA, beta!"), (801, "alpha gamma beta")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, known).collect()}
    assert brute.holds(rows, items) <= got
    assert {(600 + k, k) for k in range(10)} <= got
    assert {d for d, _ in got} <= {*range(500, 510), *range(600, 610), 800}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, known, block_items=4).collect()}
    assert blocks == got
    assert decontaminate.contaminated(empty, known).count() == 0
    assert decontaminate.contaminated(frame, known.limit(0)).count() == 0


def test_align():
    item, passage = np.array([1, 2, 3, 4, 5], np.uint64), np.array([9, 1, 2, 7, 4, 5, 9], np.uint64)
    score, matches, extra, first, end = decontaminate.align(item, passage)
    assert (score, matches, extra, first, end) == (7, 4, 0, 1, 6)


def test_fit_and_align_against_plain_tables():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        passage = [rng.randrange(5) for _ in range(rng.randrange(12))]
        a, b = np.array(item, np.uint64), np.array(passage, np.uint64)
        edits, first, end = decontaminate.fit(a, b)
        assert edits == brute.fit_edits(item, passage) == brute.edit_distance(item, passage[first:end])
        assert decontaminate.align(a, b)[0] == brute.local_score(item, passage)


def test_decontaminate_clustered_edits(spark):
    """A fifth of an item's words substituted, dropped or put in, side by side, at every place of it."""
    rng = random.Random(6)
    items = [(k, prose(rng, n)) for k, n in enumerate((5, 6, 10, 20, 40))]
    rows, want = [], set()
    for k, text in items:
        w = text.split()
        e = len(w) // 5
        for at in range(len(w) - e + 1):
            for changed in (["new"] * e, [], ["new"] * e + w[at : at + e]):
                rows.append((len(rows), " ".join(["before", "it", *w[:at], *changed, *w[at + e :], "after", "it"])))
                want.add((rows[-1][0], k))
        rows.append((len(rows), " ".join(["new"] * (2 * e + 1) + w[2 * e + 1 :])))  # too many edits
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, known).collect()}
    assert got == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, known, block_chars=40).collect()} == want


def test_decontaminate_null_and_repeated_ids(spark):
    rng = random.Random(7)
    item = prose(rng, 20)
    rows = [(None, "x " + item), (None, "x " + item), (4, item), (4, item), (4, "x"), (5, prose(rng, 300_000) + " " + item)]
    known = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id bigint, text string")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("similarity", F.lit("clash"))
    got = sorted(((r["doc_id"] or -1, r["item_id"] or -1) for r in decontaminate.contaminated(frame, known).collect()))
    assert got == sorted((d, i) for d in (-1, -1, 4, 4, 5) for i in (1, 1, -1))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, corpus, empty, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, n=n, percent=percent).collect()}
    assert got == brute.components(corpus, n, percent)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_chains(spark):
    """Texts that each link to the next only, in one large component."""
    rng = random.Random(2)
    w = [rng.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w[(i * 7) % 100] = f"new{i}"
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame, n=3, percent=90).collect()}
    assert got == brute.components(rows, 3, 90)


def test_ngram_join_groups_of_edited_copies(spark):
    """A group with copies on both sides of the threshold, short texts, and repeated and null ids."""
    rng = random.Random(5)
    lexicon = [f"w{i}" for i in range(60)]
    base = [rng.choice(lexicon) for _ in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(90)] = rng.choice(lexicon)
        rows.append((i, " ".join(w)))
    for i in range(30):
        w = [rng.choice(lexicon) for _ in range(rng.randrange(1, 30))]
        rows.append((200 + 2 * i, " ".join(w)))
        rows.append((201 + 2 * i, " ".join(["zz", *w[1:]])))
    want = brute.components(rows, 3, 90)
    # Id 900 has two texts, each equal to another row's: one vertex joins both.
    odd = [(900, rows[0][1]), (900, rows[120][1]), (None, rows[1][1]), (None, "a b c d e f g")]
    frame = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    got = [tuple(r) for r in ngram_join.jaccard_components(frame, n=3, percent=90).collect()]
    assert len(got) == len(rows) + 4 and sum(r[0] is None for r in got) == 2
    a, b = want[0][1], want[200][1]
    known = {r[0]: (r[1], r[2]) for r in got if r[0] is not None and r[0] != 900}
    assert known == {i: (n, min(a, b) if c in (a, b) else c) for i, (n, c) in want.items()}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies, many, many.</div>
<main><article><header><h1>Head  line</h1></header><p>First &eacute;, &lt;b&gt;\n  text, that is long enough, <b>bold</b>.<br>Next<p>Second &#x41;
<div class="ad">Buy, buy, buy</div><aside>Side</aside><blockquote><p>Quoted</p></blockquote><form><p>Name<input></form></article>
<section id="comments"><p>Nice, very nice, so nice, thank you all, dear friends, for this.</p></section></main>
<div class="sidebar"><p>Related, stories, and more</p></div><footer>&copy; us</footer><!-- x --></body></html>"""


def test_html(spark):
    assert html_extract.extract_text(PAGE) == "Head line\nFirst é, <b> text, that is long enough, bold. Next\nSecond A\nQuoted"
    assert html_extract.extract_text(None) == html_extract.extract_text("<p>") == html_extract.extract_text("<nav>a</nav>") == ""
    assert html_extract.extract_text("just text & more") == "just text & more"
    assert html_extract.extract_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_extract.extract_text("<p>a < b <p title='x>y'>c") == "a < b\nc"
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_sections_without_end():
    assert html_extract.extract_text("<p>a <![CDATA[b & c]]> d <![CDATA[e > f") == "a b & c d f"
    assert html_extract.extract_text("<p>a" + "<![CDATA[" * 200_000) == "a"
    assert html_extract.extract_text("<p>a" + "<![CDATA[x>" * 100_000 + "b") == "ab"


def test_html_class_words_are_evidence():
    lines = [f"Paragraph {k}, long enough to count, with words and more words in it, of an article." for k in range(4)]
    text, body = "\n".join(lines), "".join(f"<p>{x}</p>" for x in lines)
    extract = html_extract.extract_text
    for wrapper in ("page has-sidebar", "no-comments main", "foot notes", "sidebar-layout", "related"):
        assert extract(f'<div class="{wrapper}">{body}</div>') == text
    section = '<section class="related-work"><h2>Earlier</h2><p>Work that did less, and is cited here at length.</p></section>'
    assert extract(f"<article>{body}{section}</article>") == text + "\nEarlier\nWork that did less, and is cited here at length."
    for beside in ("related", "related-posts", "sidebar", "ad", "cookie-notice", "shareButtons", "comments"):
        assert extract(f'<div>{body}</div><div class="{beside}"><p>Something else, in a line, or two.</p></div>') == text
    # However much readers write, and however little the article does.
    assert extract(f'<article><p>Short.</p></article><div class="comments">{body * 5}</div><div class="ad">{body}</div>') == "Short."
    assert extract(f'<div class="ad">{body}</div>') == extract(f'<p></p><div id="comments">{body}</div>') == ""


def test_html_takes_linear_time():
    import time

    pages = [
        "<em><div>" + "<span>" * 40_000 + "</em>" * 40_000, "<span>" * 40_000 + "<td></td>" * 40_000, "<b>" * 60_000 + "<li>a" * 60_000,
        "<p>" + "<span>" * 60_000 + "<div></div>" * 40_000, '<a "' * 200_000, "<a '\">" * 150_000, "<div class=nav>" * 60_000 + "x",
        "<div>" + "<p>words, and more of them, in a row, up to a length</p><i>x</i>" * 10_000,
    ]
    for page in pages:
        began = time.process_time()
        html_extract.extract_text(page)
        assert time.process_time() - began < 8


def test_html_plain_layout():
    body = "".join(f"<p>Paragraph {k}, with some words, and others.</p>" for k in range(5))
    page = f"<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><div class=story>{body}</div><div><a href=x>More, stories, here</a></div></div></body>"
    assert html_extract.extract_text(page).split("\n") == [f"Paragraph {k}, with some words, and others." for k in range(5)]


def test_language_replaces_columns_of_its_names(spark, docs):
    model = langid.train(docs.withColumn("lang", F.lit("en")))
    clash = docs.select("doc_id", F.lit(7).alias("lang_pred"), "text", F.lit("x").alias("score"))
    got = langid.identify(clash, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted(got.collect(), key=str) == sorted(langid.identify(docs.select("doc_id", "text"), model).collect(), key=str)


def test_join_below_half(spark):
    """Sets of very different size that are similar enough at a low threshold."""
    rng = random.Random(8)
    rows = []
    for k in range(12):
        text = prose(rng, 16).split()
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[4:11]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n=3, percent=30).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows, 3, 30).items()}


def test_passages(spark, docs, corpus, empty):
    got = {r["doc_id"]: r for r in passages.near_passages(docs).collect()}
    found = {i for i, r in got.items() if r["n_passages"]}
    assert brute.repeated_windows(corpus) == found
    shared = [got[13 + 10 * k]["class_id"] for k in range(8)]
    assert set(shared) == {13}
    a, b = got[13]["passages"]
    assert a <= 60 and b >= 130 and b - a < 80
    hot = {r["doc_id"]: (r["n_passages"], r["class_id"]) for r in passages.near_passages(docs, hot=1).collect()}
    assert hot == {i: (r["n_passages"], r["class_id"]) for i, r in got.items()}
    assert passages.near_passages(empty).count() == 0


def test_passages_around_a_frequent_quote(spark):
    """Pairs of passages of 54 words, one word edited in most, among documents that only share the quote in their middle."""
    rng, rows, want = random.Random(3), [], {}
    for case, (quote, holders, edited) in enumerate([(40, 60, True), (36, 100, True), (30, 300, True), (30, 100, False), (45, 60, True)]):
        middle, base, side = prose(rng, quote), 10_000 * case, (54 - quote) // 2
        for k in range(20):
            passage = f"{prose(rng, side)} {middle} {prose(rng, 54 - quote - side)}".split()
            other = list(passage)
            if edited:
                other[rng.randrange(5, 49)] = "changed"
            for m, p in enumerate((passage, other)):
                rows.append((base + 2 * k + m, " ".join([prose(rng, 80), *p, prose(rng, 80)])))
                want[base + 2 * k + m] = base + 2 * k
        for k in range(holders):
            rows.append((base + 1000 + k, f"{prose(rng, 80)} {middle} {prose(rng, 80)}"))
            want[base + 1000 + k] = base + 1000 + k
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] in (i, want[i]) for i in want)
    assert sum(got[i] == want[i] for i in want if i % 10_000 < 1000 and i % 2) >= 95  # of 100 pairs


def test_equal_runs_have_equal_marks():
    """Whatever is around a run: the second look of passages drops runs by their marks."""
    rng = np.random.default_rng(5)
    for n in (0, 10, 16, 40, 300):
        same = rng.integers(0, 2**63, n).astype(np.uint64)
        found = []
        for before, behind in ((0, 0), (7, 30), (50, 1)):
            code = np.concatenate([rng.integers(0, 2**63, before).astype(np.uint64), same, rng.integers(0, 2**63, behind).astype(np.uint64)])
            marks, index = passages._marks(code)
            assert len(index) == max(len(code) - passages.RUN + 1, 0)
            found.append(marks[index[before : before + max(n - passages.RUN + 1, 0)]].tolist())
        assert found[0] == found[1] == found[2]


def test_common_passage_of_repeated_shingles():
    """A passage whose shingles occur in y before is found where all of it is."""
    x = np.arange(100, 160, dtype=np.uint64)
    y = np.r_[np.arange(130, 140), np.arange(5), x, np.arange(5), np.arange(110, 120)].astype(np.uint64)
    assert passages.common_passages(x, y, 46, 80) == [(0, 60, 15, 75)]


@pytest.mark.parametrize("copies", [1, 8, 9, 50])
def test_unite_many_copies(copies):
    """Four centres of a passage of document 1, each paired with every copy in document 2."""
    rows = [(1, 0, c, 45, 2, 200 * k, 200 * k + c, 200 * k + 45) for c in (10, 20, 30, 40) for k in range(copies)]
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=passages._PAIR)
    got = [r for b in passages._united(46)(iter([batch])) for r in zip(*b.to_pydict().values())]
    assert sorted(got) == [(1, 0, 46, 2, 200 * k, 200 * k + 46) for k in range(copies)]


def test_compact_windows():
    rng = np.random.default_rng(4)
    code = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    left, c, right, _ = passages.compact_windows(code, np.array([0, 120, 300]), 20, 0)
    x = passages.mix64(code ^ passages._SEEDS[0])
    want = set()
    for lo, hi in ((0, 120), (120, 300)):
        for k in range(lo, hi):
            a = k
            while a > lo and x[a - 1] > x[k]:
                a -= 1
            b = k
            while b + 1 < hi and x[b + 1] > x[k]:
                b += 1
            if b - a + 1 >= 20:
                want.add((a, k, b))
    assert set(zip(left.tolist(), c.tolist(), right.tolist())) == want


def test_compact_windows_reach_to_the_next_smaller_value():
    """Windows of long documents end at the nearest smaller hash, however far it is."""
    rng = np.random.default_rng(9)
    code = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    left, c, right, _ = passages.compact_windows(code, np.array([0, 8000, 9000]), 46, 1)
    x = passages.mix64(code ^ passages._SEEDS[1]) >> np.uint64(24)
    for a, k, b in zip(left, c, right):
        lo, hi = (0, 8000) if k < 8000 else (8000, 9000)
        assert (x[a : b + 1] >= x[k]).all() and (a == lo or x[a - 1] <= x[k]) and (b + 1 == hi or x[b + 1] <= x[k])
    assert (right - left).max() >= 7999


def test_licenses(spark, docs, empty):
    mit = dict(licenses.TEMPLATES)["mit"]
    w = mit.split()
    w[20] = w[60] = "changed"
    rows = [(1, "x\nReleased under the MIT License."), (2, "y " * 30 + mit), (3, " ".join(w)), (4, mit[: len(mit) // 3]), (5, None), (6, ""), (7, "released UNDER the, mit license " * 2), (8, "licensed under the")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {(1, "mit-notice"), (2, "mit"), (3, "mit"), (7, "mit-notice")}
    assert got[2, "mit"]["containment"] == 1.0 and 0.8 <= got[3, "mit"]["containment"] < 1
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, templates=(("x", "too short"),))


def test_oracles_hold(spark):
    """The registered queries against their SQL, where they have one, on the smallest tables."""
    from weft.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        rows = sorted(str(r) for r in want.fetchall())
        assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == rows, name


def test_dense_windows_against_brute_force():
    """Whether a shingle can be in a passage, by all runs of the document; similarity is that of sets."""
    rng = np.random.default_rng(11)
    for _ in range(150):
        size = rng.integers(0, 25, 3)
        first = np.r_[0, np.cumsum(size)]
        code = rng.integers(0, rng.integers(2, 60), first[-1]).astype(np.uint64)
        shared = np.isin(code, np.unique(code)[::2] if rng.random() < 0.5 else rng.choice(60, 45).astype(np.uint64))
        got = passages.coverable(code, first, shared, 6, 80)
        for a, z in zip(first[:-1], first[1:]):
            for b in range(a, z):
                for e in range(b + 6, z + 1):
                    part = code[b:e]
                    # A passage is cut to its ends, and begins with the first of equal shingles in a row.
                    if 100 * len(np.unique(part[shared[b:e]])) >= 80 * len(np.unique(part)):
                        assert got[b:e].all()
    code, first = np.arange(100, dtype=np.uint64), np.array([0, 50, 100])
    shared = np.r_[np.ones(30, bool), np.zeros(70, bool)]
    assert passages.coverable(code, first, shared, 46, 80).sum() == 0


def test_windows_of_repeated_words_are_two():
    code = np.r_[np.arange(5), np.full(20, 7), np.arange(8, 12)].astype(np.uint64)
    c = np.r_[3, np.arange(5, 25), 26]
    at, left = passages.ends_of_runs(code, c - 2, c)
    assert c[at].tolist() == [3, 5, 24, 26] and left.tolist() == [1, 3, 3, 24]


def test_passages_second_passage_of_a_linked_pair(spark):
    """Two documents that one passage links share another, edited, around a quote of many documents."""
    rng = random.Random(21)
    rows, quote = [], prose(rng, 40)
    for k in range(10):
        whole, before, behind = prose(rng, 70), prose(rng, 12).split(), prose(rng, 12).split()
        for m in range(2):
            rows.append((2 * k + m, " ".join([prose(rng, 80), whole, prose(rng, 90), *before, quote, *(behind if m else [*behind[:6], "changed", *behind[7:]]), prose(rng, 80)])))
    rows += [(1000 + k, f"{prose(rng, 80)} {quote} {prose(rng, 80)}") for k in range(150)]
    got = {r["doc_id"]: r for r in passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i]["class_id"] == i - i % 2 for i in range(20)) and all(got[i]["class_id"] == i for i in got if i >= 1000)
    assert sum(got[i]["n_passages"] == 2 for i in range(20)) >= 18
