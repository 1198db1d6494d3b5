"""Token files: exact round trips, against plain tokenising."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import huffman, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, ids string, row_id bigint, start string, n int"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def huffman_bits(counts):
    """The total of an unlimited Huffman code."""
    import heapq

    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=80), st.integers(7, 12))
def test_lengths_are_limited_and_best(counts, limit):
    counts = np.array(counts)
    length = huffman.lengths(counts, limit).astype(int)
    used = counts > 0
    assert ((length > 0) == used).all() and length.max(initial=0) <= limit
    if used.sum() > 1:
        assert (2.0 ** -length[used]).sum() == 1
        best = huffman_bits(counts)
        assert (length * counts).sum() >= best
        assert (huffman.lengths(counts, 40).astype(int) * counts).sum() == best


def test_limit_binds():
    counts = np.array([1 << k for k in range(20)])
    length = huffman.lengths(counts, 6)
    assert length.max() == 6 and (2.0 ** -length.astype(float)).sum() == 1
    with pytest.raises(ValueError):
        huffman.lengths(np.ones(65), 6)
    code = huffman.codes(length)
    order = np.lexsort((np.arange(20), length))
    for a, b in zip(order, order[1:]):
        assert int(code[b]) == (int(code[a]) + 1) << int(length[b] - length[a])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 40), st.integers(1, 70))
def test_blocks_decode_alone(symbols, block, step):
    ids = np.array(symbols, np.int64)
    length = huffman.lengths(np.bincount(ids, minlength=31), 9)
    packer, data, at = huffman.Packer(length), [], []
    for k in range(0, len(ids), step):
        words, places = packer.add(ids[k : k + step])
        data.append(words)
        at.append(places)
    data = b"".join([*data, packer.finish()])
    if not len(ids):
        assert data == b""
        return
    points = np.r_[np.concatenate(at)[::block], packer.bits]
    table, blocks = huffman.Table(length), len(points) - 1
    for k in range(blocks):
        begin = int(points[k]) // 32
        rest = min(block, len(ids) - k * block)
        assert table.decode(data[4 * begin :], 32 * begin, points[k : k + 1], points[k + 1 : k + 2], block, rest).tolist() == symbols[k * block : k * block + rest]
    all_at_once = table.decode(data, 0, points[:-1], points[1:], block, len(ids) - (blocks - 1) * block)
    assert all_at_once.tolist() == symbols
    with pytest.raises(ValueError):
        table.decode(data, 0, points[:-1], points[1:] + 1, block, len(ids) - (blocks - 1) * block)


def test_pieces_equal_whole_texts(plain, monkeypatch):
    rng, encoder = random.Random(5), tokenfile.Encoder(PATH)
    usual = list("ab1.'s \n\t\r  ") + ["é", "日", "'ll", "<|endoftext|>", "!!", "  "]
    odd = usual + [chr(c) for c in (0xA0, 0x2003, 0x0B, 0x0C, 0x1C, 0x180E, 0x85, 0x200B, 0xFEFF, 0x2028)]
    texts = ["".join(rng.choice(odd if k % 3 == 0 else usual) for _ in range(rng.randint(0, 16))) for k in range(4000)]
    assert all(np.frombuffer(encoder.ids(t), "<u2").tolist() == plain(t) for t in texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.batch([None, *texts, ""])] == [[], *map(plain, texts), []]
    assert all(np.frombuffer(x, "<u2").tolist() == plain(t) for x, t in zip(tokenfile.Encoder(PATH, pieces=False).batch(texts[:50]), texts))
    monkeypatch.setattr(tokenfile, "_SLICE", 20)
    monkeypatch.setattr(tokenfile, "_CHUNK", 30)
    monkeypatch.setattr(tokenfile, "_MOST", 50)
    monkeypatch.setattr(tokenfile, "_LONGEST", 3)
    texts = ["".join(rng.choice(odd if k % 3 == 0 else usual) for _ in range(200)) for k in range(300)] + ["x" * 500]
    assert all(np.frombuffer(encoder.ids(t), "<u2").tolist() == plain(t) for t in texts)


def test_round_trip(spark, plain, tmp_path, monkeypatch):
    rng = random.Random(9)
    words = ["tree", "house", "über", "日本", "x1", "and", "the"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    texts += [(200, None), (201, ""), (202, "the " * 4000), (None, "no id"), (None, None), (7, "again seven"), (7, texts[7][1]), (-5, "<|endoftext|> \xa0 x")]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "c", 1, None, None) for i, t in texts], SCHEMA).repartition(5)
    folder = f"file://{tmp_path}/ids"
    manifest = tokenfile.write(df, folder, PATH, block=16, roll_ids=700)
    assert manifest.count() > 4
    found = sorted((r for r in tokenfile.read(spark, folder, manifest, ids=True).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in texts if i is not None)) + [None, None]
    have, at = {}, 0
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += len(ids)
        have.setdefault(r["doc_id"], []).append(ids)
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append([*plain(t), 0])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    again = f"file://{tmp_path}/again"
    second = tokenfile.write(df.repartition(3), again, PATH, block=16, roll_ids=700)
    assert sorted(r["ids_crc32"] for r in tokenfile.read(spark, again, second).collect()) == sorted(r["ids_crc32"] for r in found)
    # A file that no manifest lists isn't read; a damaged or foreign one is an error.
    (Path(tmp_path) / "ids" / "ids-999999-00000.bin").write_bytes(b"rest of a lost task")
    assert tokenfile.read(spark, folder, manifest).count() == len(texts)
    victim = Path(tmp_path) / "ids" / manifest.first()["file"]
    data = victim.read_bytes()
    victim.write_bytes(data[:-1])
    with pytest.raises(Exception, match="cut short"):
        tokenfile.read(spark, folder, manifest).collect()
    victim.write_bytes(data[:8] + bytes(b ^ 255 for b in data[8:40]) + data[40:])
    with pytest.raises(Exception, match="checkpoint"):
        tokenfile.read(spark, folder, manifest).collect()


def test_empty_table_and_documents_longer_than_a_step(spark, plain, tmp_path, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    folder = f"file://{tmp_path}/none"
    assert tokenfile.read(spark, folder, tokenfile.write(none, folder, PATH)).collect() == []
    only = spark.createDataFrame([(1, None, None, 1, None, None)] * 3, SCHEMA)
    folder = f"file://{tmp_path}/only"
    assert sorted(tuple(r)[:3] for r in tokenfile.read(spark, folder, tokenfile.write(only, folder, PATH)).collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 1)]
    fs, path = tokenfile.pa.fs.FileSystem.from_uri(f"file://{tmp_path}/steps")
    fs.create_dir(path)
    monkeypatch.setattr(tokenfile, "_STEP", 64)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, n) for n in (0, 1, 500, 63, 64, 65, 3, 0, 200)]
    length = huffman.lengths(np.bincount(np.concatenate(docs)), 8)
    out = tokenfile._Writer(f"file://{tmp_path}/steps", 0, length, 10_000, 16)
    out.add(list(range(9)), docs)
    out.close()
    code = tokenfile.hashlib.sha256(tokenfile._code_bytes(length)).digest()[:8]
    file = tokenfile.File(fs, f"{path}/ids-000000-00000.bin", huffman.Table(length), code)
    assert [np.concatenate(held).tolist() for _, _, _, held in file.documents()] == [d.tolist() for d in docs]
    everything = np.concatenate(docs)
    assert file.decode(3, 7).tolist() == everything[48:112].tolist()
    with pytest.raises(ValueError, match="another code"):
        tokenfile.File(fs, f"{path}/ids-000000-00000.bin", huffman.Table(length), b"12345678")


def test_query_equals_plain_tokenising(spark, plain):
    from weft.llm import queries

    sf = "/root/testdata/sf0.001"
    at, want = 0, []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*plain(r["text"]), 0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op12_token_files(spark, sf).collect())) == want
