"""Token ids in compressed binary files: tokenised, ordered by document, coded by global counts, read back.

Documents become token ids; Spark adds up how often each id occurs, and the driver makes one canonical Huffman
code of limited length of at most a vocabulary of counts. Documents are then range-sorted by id, and each task
writes files of codes that roll after a number of ids.

A file is: MAGIC; the codes as big-endian 32-bit words; an index, deflated (ids of documents and which of them
are null, tokens a document, bits a block); a trailer of fixed size. A block is BLOCK ids, the last may be
shorter. Summed up, bits a block are checkpoints, from which a block is decoded without those before it. A
folder has one `codes.bin`, the lengths of the code, whose digest each trailer repeats. Files are written under
temporary names and renamed; the manifest lists those that count, in order.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import huffman
from weft.llm.common import input_partitions, materialize, release, tune

MAGIC = b"WEFTIDS1"
#: block ids, index offset, index bytes, documents, ids, bits, CRC-32 of codes, of the index, first bytes of the code's digest, magic
TRAILER = struct.Struct("<IQQQQQII8s8s")
BLOCK = 1024
ROLL_IDS = 16 << 20
LIMIT = 18
#: Ids coded or decoded at a time: bounds a task's memory whatever a document's or a file's size.
_STEP = 1 << 20
_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bits", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

# ---- tokenising --------------------------------------------------------------------------------------------

#: White space but blanks and line feeds, and what some Unicode version counts as such: such texts are encoded whole.
_OTHER_SPACE = tuple(chr(c) for c in (*range(9, 10), *range(11, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
#: Runs of white space that belong to one id. Shorter ones, but at the end, are encoded one by one.
_RUN = re.compile("[ \n]{3}|[ \n]{2}$")
_CUT = re.compile("(?<![\\s\u180e\u200b\ufeff])(?=[ \n])")
#: What follows a letter as a piece of its own.
_MARKS = ".,;:!?)"
_SLICE, _CHUNK, _LONGEST, _MOST = 1 << 20, 1 << 16, 48, 1 << 20


class Encoder:
    """Ids of texts as little-endian bytes. Words that were seen before aren't encoded again.

    For byte-level BPE files with their usual pattern, by which nothing joins the end of a word to the white
    space after it: words, each with the blank or line feed before it, are encoded independently of each other,
    new ones of many texts as one text, whose ids are cut by the bytes that they stand for. pieces=False, for
    other files, encodes texts whole. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, pieces: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pieces = pieces
        self.width = np.zeros(self.size, np.int64)  # bytes that an id stands for
        for token, k in vocabulary.items():
            self.width[k] = len(token)
        self.single = {m: self._encode([m])[0] for m in [*_MARKS, " ", "\n"]}
        self._forget()

    def _forget(self) -> None:
        self.known = {"": self.single[" "], "\n": self.single["\n"]}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > _SLICE:
            cut = _CUT.search(text, at + _SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _words(self, text: str) -> list[str] | None:
        """The text's words; one without a line feed before it has a blank there. None: they can't stand alone."""
        words = text.replace("\n", " \n").split(" ")
        if not words[0] or ("" in words or "\n" in words) and _RUN.search(text) or any(c in text for c in _OTHER_SPACE):
            return None
        return words

    def _learn(self, words: set[str]) -> list[str]:
        """Add words to those known; returns those that are too long to be kept."""
        marked = [w for w in words if w[-1] in _MARKS and w[-2:-1].isalpha()]
        new = words.difference(marked).union([w[:-1] for w in marked]).difference(self.known)
        chunk, size, chunks = [], 0, []
        for w in new:
            chunk.append(w if w[0] == "\n" else " " + w)
            size += len(w)
            if size > _CHUNK:
                chunks.append(chunk)
                chunk, size = [], 0
        chunks.append(chunk)
        for chunk, ids in zip(chunks, self._encode(["".join(c) for c in chunks])):
            ends = np.cumsum([len(w.encode()) for w in chunk])
            upto = np.cumsum(self.width[np.frombuffer(ids, self.kind)])
            cuts = np.searchsorted(upto, ends)
            if not (upto[cuts] == ends).all():
                raise ValueError("the tokenizer joins words: use pieces=False")
            cuts = [0, *((cuts + 1) * self.kind.itemsize).tolist()]
            for w, a, b in zip(chunk, cuts, cuts[1:]):
                self.known[w if w[0] == "\n" else w[1:]] = ids[a:b]
        for w in marked:
            self.known[w] = self.known[w[:-1]] + self.single[w[-1]]
        return [w for w in (*new, *marked) if len(w) > _LONGEST]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        if len(self.known) > _MOST:
            self._forget()
        out: list = [b""] * len(texts)
        plans, new, whole, heads = [], set(), [], []
        for k, text in enumerate(texts):
            for part in self._slices(text) if text else ():
                # A slice after the first begins with white space: an empty word would stand before it.
                words = self._words(part) if self.pieces else None
                plans.append((k, words, len(whole)))
                if words is None:
                    whole.append(part)
                    continue
                heads.append(words.pop(0))
                got = list(map(self.known.get, words))
                if None in got:
                    new.update([w for w, g in zip(words, got) if g is None])
                else:
                    plans[-1] = (k, b"".join(got), len(whole))
        whole_ids = self._encode(whole)
        head_ids = iter(self._encode(heads))
        long = self._learn(new) if new else []
        for k, words, at in plans:
            if words is None:
                ids = whole_ids[at]
            else:
                ids = next(head_ids) + (words if isinstance(words, bytes) else b"".join(map(self.known.__getitem__, words)))
            out[k] = out[k] + ids if out[k] else ids
        for w in long:
            self.known.pop(w, None)
        return out

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pieces: bool) -> Encoder:
    """One a worker process: loading takes a third of a second, and pieces stay known from task to task."""
    return Encoder(path, pieces)


def tokenise(docs: DataFrame, path: str, text: str = "text", row_id: str = "doc_id", end: int = 0, pieces: bool = True) -> DataFrame:
    """Rows (row_id, ids, n) of every document with the end id, and one row a task with its ids' counts.

    ids: little-endian, two bytes an id if the vocabulary allows, else four. Rows of counts have symbols and
    counts, and nothing else. Null texts are empty.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("row_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("symbols", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            if encoder is None:
                encoder = _encoder(path, pieces)
                last, count = np.array([end], encoder.kind).tobytes(), np.zeros(encoder.size, np.int64)
            ids = [x + last for x in encoder.batch(b.column("text").to_pylist())]
            count += np.bincount(np.frombuffer(b"".join(ids), encoder.kind), minlength=encoder.size)
            n = pa.array([len(x) // encoder.kind.itemsize for x in ids], pa.int64())
            yield pa.record_batch([b.column("row_id"), pa.array(ids, pa.binary()), n, pa.nulls(len(ids), schema.types[3]), pa.nulls(len(ids), schema.types[4])], schema=schema)
        if encoder is not None:
            used = np.flatnonzero(count)
            tail = {"symbols": pa.array([used.tolist()], schema.types[3]), "counts": pa.array([count[used].tolist()], schema.types[4])}
            yield pa.record_batch([tail.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    rows = docs.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(task, "row_id bigint, ids binary, n bigint, symbols array<int>, counts array<bigint>")


# ---- writing -----------------------------------------------------------------------------------------------


class _Writer:
    """Files of one task, one open at a time."""

    def __init__(self, folder: str, part: int, length: np.ndarray, roll: int, block: int) -> None:
        self.fs, self.path = pa.fs.FileSystem.from_uri(folder)
        self.part, self.length, self.roll, self.block = part, length, roll, block
        self.code = _code_bytes(length)
        self.seq, self.stream, self.done = 0, None, []

    def _open(self) -> None:
        self.temporary = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.hash, self.crc, self.bytes = hashlib.sha256(), 0, 0
        self.packer = huffman.Packer(self.length)
        self.rows, self.sizes, self.ids, self.starts = [], [], 0, []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def _codes(self, ids: np.ndarray) -> None:
        """ids are adjacent in the file and begin at self.ids."""
        data, at = self.packer.add(ids)
        self.starts.append(at[-self.ids % self.block :: self.block])
        self.ids += len(ids)
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def add(self, rows: list, ids: list[np.ndarray]) -> None:
        """Documents in order. Short ones are coded together, long ones in steps."""
        held, size = [], 0
        for row, x in zip(rows, ids):
            if self.stream is None:
                self._open()
            self.rows.append(row)
            self.sizes.append(len(x))
            for at in range(0, len(x), _STEP):
                held.append(x[at : at + _STEP])
                size += len(held[-1])
                if size >= _STEP:
                    self._codes(np.concatenate(held))
                    held, size = [], 0
            if self.ids + size >= self.roll:
                if held:
                    self._codes(np.concatenate(held))
                    held, size = [], 0
                self.close()
        if held:
            self._codes(np.concatenate(held))

    def close(self) -> None:
        if self.stream is None:
            return
        data = self.packer.finish()
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        starts = np.concatenate([*self.starts, [self.packer.bits]])
        known = np.array([r is not None for r in self.rows], np.uint8)
        named = np.array([r or 0 for r in self.rows], "<i8")
        index = zlib.compress(known.tobytes() + named.tobytes() + np.array(self.sizes, "<u8").tobytes() + np.diff(starts).astype("<u4").tobytes())
        at = self.bytes
        self._put(index)
        self._put(TRAILER.pack(self.block, at, len(index), len(self.rows), self.ids, self.packer.bits, self.crc, zlib.crc32(index), hashlib.sha256(self.code).digest()[:8], MAGIC))
        self.stream.close()
        self.stream = None
        name = f"ids-{self.part:06d}-{self.seq:05d}.bin"
        self.fs.move(self.temporary, f"{self.path}/{name}")
        self.done.append((self.part, self.seq, name, len(self.rows), self.ids, self.packer.bits, self.bytes, self.hash.hexdigest()))
        self.seq += 1

    def listed(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*self.done), _MANIFEST)], schema=_MANIFEST)
            self.done = []


def _code_bytes(length: np.ndarray) -> bytes:
    return MAGIC + zlib.compress(length.astype(np.uint8).tobytes())


def code_lengths(folder: str) -> np.ndarray:
    """The code of a folder's files."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/codes.bin") as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError("no code of token files")
    return np.frombuffer(zlib.decompress(data[8:]), np.uint8)


def write(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", row_id: str = "doc_id", end: int = 0, limit: int = LIMIT, block: int = BLOCK, roll_ids: int = ROLL_IDS, pieces: bool = True) -> DataFrame:
    """Write every document's ids and the end id below folder, in ascending order of row_id; return the manifest.

    tokenizer: a file of the tokenizers library that every executor can open. limit: the longest code in bits.
    folder: a URI that the driver and all executors see. A file goes on to the end of the document with which
    it reaches roll_ids.

    Null texts are empty and hold the end id only; rows without id come last; rows that repeat an id are all
    written, ordered by a hash of their ids. An empty table gives no files. Other columns aren't read. Rows of the
    manifest: part, seq, file, docs, ids, bits, bytes, sha256; files follow each other in order of part and seq.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenise(docs, tokenizer, text, row_id, end, pieces), "tokens")
    counted = tokens.where("symbols is not null").select(F.explode(F.arrays_zip("symbols", "counts")).alias("c"))
    counts = counted.groupBy("c.symbols").agg(F.sum("c.counts").alias("n")).collect()  # a vocabulary at most
    total = np.zeros(max((r["symbols"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r["symbols"]] = r["n"]
    length = huffman.lengths(total, limit)
    rows = tokens.where("ids is not null").select("row_id", "ids", F.col("row_id").isNull().alias("last"), F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    order = ["last", "row_id", "hash", "tie"]
    # The last two keys spread rows that repeat an id over tasks.
    dealt = rows.repartitionByRange(input_partitions(tokens), *order).sortWithinPartitions(*order).select("row_id", "ids", F.spark_partition_id().alias("part"))
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/codes.bin") as f:
        f.write(_code_bytes(length))
    wide = _width(tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                files = _Writer(folder, b.column("part")[0].as_py(), length, roll_ids, block)
            files.add(b.column("row_id").to_pylist(), [np.frombuffer(x, wide) for x in b.column("ids").to_pylist()])
            yield from files.listed()
        if files is not None:
            files.close()
            yield from files.listed()

    manifest = materialize(dealt.mapInArrow(task, "part int, seq int, file string, docs bigint, ids bigint, bits bigint, bytes bigint, sha256 string"), "tokens-manifest")
    release(spark, tokens)
    return manifest


def _width(path: str) -> np.dtype:
    return _encoder(path, True).kind


# ---- reading -----------------------------------------------------------------------------------------------


class File:
    """A file of ids: its index, and decoding from any block."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, table: huffman.Table, code: bytes) -> None:
        self.table = table
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(TRAILER.size, size - TRAILER.size)
        self.block, at, length, self.docs, self.ids, self.bits, self.crc, index_crc, digest, magic = TRAILER.unpack(tail)
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no file of token ids, or is cut short")
        if digest != code:
            raise ValueError(f"{path} was written with another code")
        index = self.file.read_at(length, at)
        if zlib.crc32(index) != index_crc:
            raise ValueError(f"the index of {path} is damaged")
        raw = zlib.decompress(index)
        n = self.docs
        known, named = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n)
        self.rows = [int(v) if k else None for k, v in zip(known, named)]
        self.sizes = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.checkpoints = np.r_[0, np.cumsum(np.frombuffer(raw, "<u4", -1, 17 * n).astype(np.int64))]

    def decode(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1, read from the file's bytes of these blocks alone."""
        bits = self.checkpoints[first : last + 1]
        begin, end = int(bits[0]) // 32, -(-int(bits[-1]) // 32)
        data = self.file.read_at(4 * (end - begin), len(MAGIC) + 4 * begin)
        rest = min(self.block, self.ids - (last - 1) * self.block)
        return self.table.decode(data, 32 * begin, bits[:-1], bits[1:], self.block, rest)

    def steps(self) -> Iterator[np.ndarray]:
        blocks, each = len(self.checkpoints) - 1, max(1, _STEP // self.block)
        for at in range(0, blocks, each):
            yield self.decode(at, min(at + each, blocks))

    def documents(self) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
        """(row_id, ids before it in the file, number of ids, its ids in pieces) of each document in order."""
        steps, have, at = self.steps(), np.zeros(0, np.uint32), 0
        for row, n in zip(self.rows, self.sizes.tolist()):
            held, want = [], n
            while want > len(have):
                held.append(have)
                want -= len(have)
                have = next(steps)
            held.append(have[:want])
            have = have[want:]
            yield row, at, n, held
            at += n


def read(spark: SparkSession, folder: str, manifest: DataFrame, ids: bool = False, row_id: str = "doc_id") -> DataFrame:
    """Read the manifest's files: row_id, start, n_tokens, ids_crc32, ids.

    start: ids of all documents before; ids_crc32: of the ids as little-endian unsigned 32-bit integers; ids:
    those bytes, null unless asked for. Blocks that don't end at their checkpoints, damaged indexes and other
    codes are errors. Files that the manifest doesn't list aren't opened.
    """
    tune(spark)
    length = code_lengths(folder)
    code = hashlib.sha256(_code_bytes(length)).digest()[:8]
    before = F.sum("ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    placed = manifest.select("file", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"))
    schema = pa.schema([("row_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (fs, path) = None, pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                table = table or huffman.Table(length)
                rows, size = [], 0
                for row, at, n, held in File(fs, f"{path}/{name}", table, code).documents():
                    crc = 0
                    for x in held:
                        crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                    rows.append((row, base + at, n, crc, b"".join(x.astype("<u4").tobytes() for x in held) if ids else None))
                    size += 100 + len(rows[-1][4] or b"")
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    tasks = min(max(manifest.count(), 1), 20_000)
    # Dealt by file, so tasks have a few files each at any number of files.
    return placed.repartition(tasks, "file").mapInArrow(task, "row_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary").withColumnRenamed("row_id", row_id)
