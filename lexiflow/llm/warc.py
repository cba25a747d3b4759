"""WARC archives by way of a chunked record table.

A payload never travels whole: it is cut in rows (record, chunk number, bytes), and each
row carries the payload's length and SHA-1 up to and including its own bytes, so the last
row of a record has the digest of all of it. Writing streams the rows of a record, in
order, into one gzip member; reading streams them out again the same way.

``write_archives`` writes one ``.warc.gz`` file for each shuffle partition. A file counts
only if it is listed in the returned table, which is itself written before use: files of
lost or repeated task attempts are ignored.

Of records with equal payloads of at least ``revisit_from`` bytes, the one with the
smallest page_id is the response, the others revisit it.

Defined cases: null html counts as empty; a null page_id sorts last and refers to
nothing by number; repeated rows are a record each, one of them the response; a null url
leaves the target out, control characters in it are percent-encoded; an empty table
writes no archive and reads back empty; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import shared_path, written

CHUNK = 1 << 16
CHUNK_SCHEMA = ("record_id long, page_id long, url string, chunk_no long, data binary, "
                "bytes_so_far long, sha1_so_far binary, last boolean")
FILE_SCHEMA = "path string, n_records long, n_bytes long"
READ_SCHEMA = ("record_id long, page_id long, url string, record_type string, refers_to long, chunk_no long, "
               "data binary, payload_bytes long, payload_digest string, last boolean")
URN = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                chunk: int = CHUNK) -> DataFrame:
    """Rows (record, chunk number, bytes) with running length and digest, in order."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = (pages.select(F.monotonically_increasing_id().alias("record_id"), F.col(id_col).cast("long").alias("page_id"),
                         F.col(url_col).cast("string").alias("url"), body.alias("body"))
            .withColumn("size", F.octet_length("body"))
            .select("record_id", "page_id", "url", "body", "size",
                    F.explode(F.expr(f"sequence(0L, cast(greatest(size - 1, 0) div {chunk} as long))")).alias("chunk_no"))
            .select("record_id", "page_id", "url", "chunk_no", "size",
                    F.expr(f"substring(body, cast(chunk_no * {chunk} + 1 as int), {chunk})").alias("data")))

    def run(batches):  # the chunks of a record follow each other in one partition
        sha, size, so_far = hashlib.sha1(), 0, 0
        for batch in batches:
            lengths, digests, last = [], [], []
            for no, whole, data in zip(*(batch.column(c).to_pylist() for c in ("chunk_no", "size", "data"))):
                if no == 0:
                    sha, so_far = hashlib.sha1(), 0
                sha.update(data)
                so_far += len(data)
                lengths.append(so_far)
                digests.append(sha.digest())
                last.append(so_far == whole)
            cols = [batch.column(c) for c in ("record_id", "page_id", "url", "chunk_no", "data")]
            cols += [pa.array(lengths, pa.int64()), pa.array(digests, pa.binary()), pa.array(last, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["record_id", "page_id", "url", "chunk_no", "data",
                                                          "bytes_so_far", "sha1_so_far", "last"])

    return rows.mapInArrow(run, CHUNK_SCHEMA)


def record_roles(chunks: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(record_id, payload_bytes, sha1, first_record, first_page): first_* null for responses."""
    ends = chunks.where("last").select("record_id", "page_id", F.col("bytes_so_far").alias("payload_bytes"),
                                       F.col("sha1_so_far").alias("sha1"))
    groups = written(ends.where(F.col("payload_bytes") >= revisit_from).groupBy("sha1", "payload_bytes")
                     .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first"),
                          F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    revisit = F.col("first.record_id").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return (ends.join(groups, ["sha1", "payload_bytes"], "left")
            .select("record_id", "payload_bytes", "sha1", F.when(revisit, F.col("first.record_id")).alias("first_record"),
                    F.when(revisit, F.col("first.page_id")).alias("first_page")))


def _urn(record_id, page_id) -> str:
    return f"<{URN}{'' if page_id is None else page_id}:{record_id}>"


def _from_urn(urn: str) -> tuple[int, int | None]:
    page, record = urn.strip("<>").removeprefix(URN).split(":")
    return int(record), int(page) if page else None


def _head(row: dict) -> tuple[bytes, bytes]:
    """(WARC header, HTTP header) of a record."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    revisit = row["first_record"] is not None
    url = "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{x:02X}" for x in c.encode()) for c in row["url"] or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_urn(row['record_id'], row['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(row['sha1']).decode()}",
             "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    lines += [f"WARC-Target-URI: {url}"] * bool(url)
    lines += [f"WARC-Refers-To: {_urn(row['first_record'], row['first_page'])}", f"WARC-Profile: {PROFILE}"] * revisit
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(chunks: DataFrame, roles: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the records as archives below ``folder``; returns the table of files."""
    folder = folder or shared_path(chunks.sparkSession, "warc")
    rows = (chunks.select("record_id", "page_id", "url", "chunk_no", "data").join(roles, "record_id")
            .where("first_record is null or chunk_no = 0")
            .withColumn("data", F.expr("CASE WHEN first_record is null THEN data END"))
            .repartition("record_id").sortWithinPartitions("record_id", "chunk_no"))

    def run(batches):
        from pyarrow import fs
        store, path, out, packer, n, size = None, "", None, None, 0, 0
        names = ("record_id", "page_id", "url", "payload_bytes", "sha1", "first_record", "first_page")
        for batch in batches:
            heads = [batch.column(c).to_pylist() for c in names]
            numbers, data = batch.column("chunk_no").to_pylist(), batch.column("data")
            for k, no in enumerate(numbers):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out = posixpath.join(folder, name), store.open_output_stream(posixpath.join(base, name), compression=None)
                if no == 0:
                    if packer is not None:
                        size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    packer, n = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                    size += out.write(packer.compress(b"".join(_head(dict(zip(names, (h[k] for h in heads)))))))
                if data[k].is_valid:
                    size += out.write(packer.compress(data[k].as_py()))
        if out is not None:
            size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return written(rows.mapInArrow(run, FILE_SCHEMA), "warc-files")


class _Members:
    """Bytes of a gzip file of many members, a bounded piece at a time."""

    def __init__(self, stream, piece: int = CHUNK):
        self.stream, self.piece = stream, piece
        self.raw, self.buffer, self.unpacker = b"", b"", None

    def _fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = bytes(self.stream.read(self.piece))
                if not self.raw:
                    return False
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            got = self.unpacker.decompress(self.raw, self.piece)
            self.raw = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, None
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._fill():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        """At most n bytes, at least one."""
        if not self.buffer and not self._fill():
            raise ValueError("the archive ends within a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def _records(stream, piece: int):
    """Rows of READ_SCHEMA, one for each chunk of each record."""
    source = _Members(stream, piece)
    while (head := source.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        http = source.until(b"\r\n\r\n")
        left = int(warc["Content-Length"]) - len(http) - 4
        record, page = _from_urn(warc["WARC-Record-ID"])
        declared = warc["WARC-Payload-Digest"].removeprefix("sha1:")
        row = [record, page, warc.get("WARC-Target-URI"), warc["WARC-Type"],
               _from_urn(warc["WARC-Refers-To"])[1] if "WARC-Refers-To" in warc else None]
        if warc["WARC-Type"] == "revisit":  # the payload is in the record referred to
            yield [*row, 0, None, int(_fields(http)["Content-Length"]), declared, True]
        else:
            sha, size, no = hashlib.sha1(), 0, 0
            while left or not no:
                data = source.take(min(left, piece)) if left else b""
                left, size = left - len(data), size + len(data)
                sha.update(data)
                yield [*row, no, data, size, base64.b32encode(sha.digest()).decode(), not left]
                no += 1
            if base64.b32encode(sha.digest()).decode() != declared:
                raise ValueError(f"record {record}: the payload does not match its digest")
        if source.until(b"\r\n\r\n") != b"":
            raise ValueError(f"record {record}: no blank lines at its end")


def read_archives(files: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Rows (record, chunk number, bytes, running length and digest) of the listed archives."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(),
             pa.string(), pa.bool_()]

    def run(batches):
        from pyarrow import fs
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for row in _records(stream, chunk):
                        if not with_data:
                            if not row[-1]:
                                continue
                            row[6] = None
                        rows.append(row)
                        size += len(row[6] or b"") + 200
                        if size >= 16 * chunk:
                            yield _batch(rows, names, types)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names, types)

    # a number that adaptive execution keeps: an archive, already the size of a partition, is a task
    return files.select("path").repartitionByRange(max(1, files.count()), "path").mapInArrow(run, READ_SCHEMA)


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def archive_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write every page to archives, read them back; one row per page."""
    chunks = written(chunk_table(pages), "chunks", "zstd")
    files = write_archives(chunks, record_roles(chunks, revisit_from))
    return read_archives(files, with_data=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
