"""WARC archives in which every record is a Zstandard frame under a dictionary of the archive's own.

Writing: equal payloads are found by SHA-1 and length; the record of the largest id keeps the
payload (`response`), the others are `revisit` records that refer to it. Each task writes
archives of bounded size: the first records train a dictionary (records too few or too small to
learn from are the dictionary's raw content themselves), which goes into a leading skippable
frame, and then every record is one frame of its own. The manifest of finished files
is checkpointed; a file counts only if the task attempt that wrote it succeeded, so files of lost
executors are never read.

Reading: the manifest's files are opened on the executors, a partition for each, and parsed
record by record.

Null payloads are empty; with `least_bytes` 0 empty payloads are de-duplicated too. A null url
leaves its header out; line breaks in urls are escaped. Rows repeating the leader's id are
responses as well; a group of only null ids has no leader, so all are responses. Long payloads
are written whole. An empty table gives no archive and no rows; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import HOT_KEYS, checkpointed, ensure_checkpoint_dir

#: An archive is closed after so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
#: Bounds of what trains a dictionary, and the dictionary's size.
TRAIN_BYTES, TRAIN_RECORDS, DICT_BYTES = 2 << 20, 1000, 32 << 10
#: Leaders of up to so many repeated payloads are broadcast; beyond it only those of the most repeated ones are, the rest shuffles.
BROADCAST_ROWS = 100_000
# Fixed values of the formats
_SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

_MANIFEST = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def record(page_id: int | None, url: str | None, payload: bytes, leader: int | None, date: str) -> bytes:
    """One record's bytes. A leader makes it a revisit: HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if leader is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if leader is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if leader is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{leader}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    stream = io.BufferedReader(stream, 1 << 16)
    while line := stream.readline():
        if line.strip() == b"":
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))
        stream.read(4)


class _Archive:
    """An open archive file: a dictionary frame, then a frame for each record."""

    def __init__(self, fs, path: str, first: list[bytes]):
        import zstandard

        self.path, self.n, self.out, self.size = path, 0, fs.open_output_stream(path, compression=None), 0
        try:
            dictionary = zstandard.train_dictionary(DICT_BYTES, first, k=200, d=8)
        except zstandard.ZstdError:  # too few or too small records to learn from
            dictionary = zstandard.ZstdCompressionDict(b"".join(r[:DICT_BYTES] for r in first)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = dictionary.as_bytes()
        self._put(struct.pack("<II", _SKIPPABLE, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for r in first:
            self.add(r)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, r: bytes) -> None:
        self._put(self.compressor.compress(r))
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.n, self.size


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, done = TaskContext.get(), []
        archive, waiting, held = None, [], 0

        def begin() -> _Archive:
            return _Archive(fs, f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst", waiting)

        for batch in batches:
            for page_id, url, html, leader in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = record(page_id, url, (html or "").encode(), leader, date)
                if archive is not None:
                    archive.add(r)
                else:
                    waiting.append(r)
                    held += len(r)
                    if held >= TRAIN_BYTES or len(waiting) >= TRAIN_RECORDS:
                        archive, waiting, held = begin(), [], 0
                if archive is not None and archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is None and waiting:
            archive = begin()
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[], [], []], _MANIFEST, strict=True)], schema=_MANIFEST)

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes all rows below `folder` (a URI that executors share); the manifest: file, n_records, n_bytes."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    repeated = checkpointed(
        rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies")).where("copies > 1 and leader is not null")
    )
    keys, (n_repeated, copies) = ["digest", "n"], repeated.agg(F.count("*"), F.sum("copies")).first()
    if n_repeated <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(repeated), keys, "left")
    else:
        hot = F.col("copies") > copies / HOT_KEYS  # fewer than HOT_KEYS payloads, so no payload is a hot key of the shuffle
        often = F.broadcast(repeated.where(hot))
        joined = rows.join(often, keys).unionByName(rows.join(often, keys, "left_anti").join(repeated.where(~hot), keys, "left"))
    linked = joined.withColumn("leader", F.when(~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader")))
    return checkpointed(linked.select("page_id", "url", "html", "leader").mapInArrow(_writer(folder, date), "file string, n_records long, n_bytes long"))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(folder)
        page = lambda v: int(v[1:-1].removeprefix(_ID)) if v and v[1:-1] != _ID else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    dictionary, head = None, f.read(8)
                    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _SKIPPABLE:
                        dictionary = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", head[4:])[0]))
                    else:
                        f.seek(0)
                    stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(f, read_across_frames=True)
                    out: list[tuple] = []
                    for headers, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(next(h for h in http.decode("latin-1").split("\r\n") if h.lower().startswith("content-length:")).split(":")[1])
                        kind = headers["warc-type"]
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else told
                        out.append((page(headers["warc-record-id"]), len(payload) if kind == "response" else size, own, kind, page(headers.get("warc-refers-to")), own == told and (kind != "response" or size == len(payload))))
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[] for _ in _RECORD]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of each record."""
    # ranges of names, a file in each but for ties of the sampled bounds; their number is given, so that they are not merged for being small
    n_files = max(1, manifest.count())
    return manifest.select("file").repartitionByRange(n_files, "file").mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base if ':/' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
