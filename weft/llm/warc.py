"""Deterministic sharded WARC writer and reader.

Records get a sort key, a hash of url, id and payload digest, whose range is cut at fixed places into shards;
records are range-sorted by it, so shard contents don't depend on sampling, partition counts or reruns. A
shard is written as files that roll by compressed size, one gzip member a record, with headers and digests
made anew. A task writes under a temporary name and renames a finished file; the manifest, written after all
tasks ended, lists the files that count. Writing the same shard twice (a lost executor, a speculative task)
gives the same bytes under the same name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import materialize, tune

SHARD_BYTES = 32 << 20
ROLL_BYTES = 32 << 20
_STEP = 1 << 13
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(value: str) -> str:
    """A header value on one line: control characters and what isn't ASCII are percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def record_id(page_id: int | None, url: str | None, digest: bytes, ordinal: int) -> str:
    """The id of the ordinal-th of equal records: of one page id and payload, or of one URL and payload without page id."""
    name = f"page {page_id}" if page_id is not None else f"url {url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name} {digest.hex()} {ordinal}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, ordinal: int = 0, refers_url: str | None = None) -> bytes:
    """A response record, or with refers_to a revisit record without the payload."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest, ordinal)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    head += [f"WARC-Payload-Digest: sha1:{base32(digest)}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, None, digest, 0)}", f"WARC-Refers-To-Date: {date}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_header(refers_url)}")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose header holds no time or name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Files of one task: opened under a temporary name, renamed when complete."""

    def __init__(self, folder: str, roll: int) -> None:
        self.fs, self.path = pa.fs.FileSystem.from_uri(folder)
        self.roll, self.shard, self.seq, self.stream = roll, None, 0, None
        self.done: list[tuple] = []

    def write(self, shard: int, data: bytes) -> None:
        if self.stream is not None and (shard != self.shard or self.size + len(data) > self.roll):
            self.close()
        if shard != self.shard:
            self.shard, self.seq = shard, 0
        if self.stream is None:
            self.temporary = f"{self.path}/_tmp-{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temporary)
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
        self.stream.write(data)
        self.size += len(data)
        self.records += 1
        self.hash.update(data)

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        name = f"pages-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.path}/{name}")
        self.done.append((self.shard, name, self.records, self.size, self.hash.hexdigest()))
        self.seq += 1

    def manifest(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            yield pa.record_batch([pa.array(x) for x in zip(*self.done)], schema=_MANIFEST)
            self.done = []


def write(pages: DataFrame, folder: str, row_id: str = "page_id", url: str = "url", source: str = "html", least_revisit: int = 0, date: str = "1970-01-01T00:00:00Z", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row below folder (a URI that all executors see) and return the manifest.

    Of rows with equal payloads of at least least_revisit bytes, the one with the smallest id is a response,
    the others are revisit records that refer to it; rows that repeat that smallest id are responses too. A
    null payload is empty; a null url or id leaves its header out (and a row without id never is referred
    to, nor a revisit unless some row with an id has its payload). Rows: shard, file, records, bytes, sha256.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    narrow = rows.where(F.octet_length("payload") >= least_revisit).select("digest", F.when(F.col("row_id").isNotNull(), F.struct("row_id", "url")).alias("page"))
    # Only payloads that occur twice; a join with it is split where one payload fills a partition.
    firsts = narrow.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(firsts.select("digest", F.col("first.row_id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-copies")
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # Records of one id and payload lie side by side; those without id are told apart by URL.
    key = F.xxhash64(F.coalesce(F.col("row_id").cast("string"), "url", F.lit("")), "digest")
    # The top 31 bits of the key, times the shards: cuts at fixed places of the key's range.
    place = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 33)
    refers = F.when(F.col("row_id").isNull() | (F.col("first_id") != F.col("row_id")), F.col("first_id"))
    joined = rows.join(copies, "digest", "left").select("row_id", "url", "payload", "digest", refers.alias("refers_to"), "first_url", key.alias("key"))
    dealt = joined.withColumn("shard", F.shiftright(place * F.lit(shards), 31)).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "key", "row_id", "digest", "url")

    columns = ["row_id", "url", "payload", "digest", "refers_to", "first_url", "shard"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, before, ordinal = _Files(folder, roll_bytes), None, 0
        for b in batches:
            for page_id, link, payload, digest, refers_to, first_url, shard in zip(*(b.column(c).to_pylist() for c in columns)):
                same = (page_id, link if page_id is None else None, digest)
                before, ordinal = same, ordinal + 1 if same == before else 0
                files.write(shard, member(record(page_id, link, payload, refers_to, date, ordinal, first_url)))
            yield from files.manifest()
        files.close()
        yield from files.manifest()

    _make_folder(pages.sparkSession, folder)
    listed = dealt.select(*columns).mapInArrow(task, "shard bigint, file string, records bigint, bytes bigint, sha256 string")
    return materialize(listed, "warc-manifest")


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file's bytes, one gzip member at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        # Small steps: what a member leaves of its last one is copied, and must not be the rest of the file.
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("the file ends within a gzip member")
            step = view[at : at + _STEP]
            parts.append(unpacker.decompress(step))
            at += len(step) - len(unpacker.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if "sha1:" + base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
            raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
        yield fields, block


def _parse(data: bytes, payloads: bool) -> Iterator[tuple]:
    for fields, block in records(data):
        head, _, payload = block.partition(b"\r\n\r\n")
        revisit = fields["WARC-Type"] == "revisit"
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if revisit:
            size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        else:
            size, made = len(payload), base32(hashlib.sha1(payload).digest())
            if made != digest:
                raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
        number = lambda k: int(fields[k]) if k in fields else None
        yield number("X-Page-Id"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), payload if payloads and not revisit else None


def read(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload is null unless asked for, and for revisit records. Block and payload digests are checked; a bad
    one, or a file cut short, is an error. Files that the manifest doesn't list are left out.
    """
    tune(spark)
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = files.join(manifest.select("file").distinct(), "file", "left_semi").select("content")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                for r in _parse(b.column(0)[k].as_py(), payloads):
                    rows.append(r)
                    size += 100 + len(r[6] or b"")
                    if size > 8 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _RECORD)], schema=_RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _RECORD)], schema=_RECORD)

    return listed.mapInArrow(task, schema)
