"""WARC archives, written and read as tables of record chunks.

A payload is a run of rows (record, chunk number, bytes), never more than ``chunk_bytes`` long, and digests are
carried from chunk to chunk. So neither side holds a whole record in Python, however long it is.

Writing takes three passes. The first streams the chunks and gives each row's payload digest and length. Then
rows with equal payloads of at least ``min_revisit`` bytes are resolved by an aggregate: the one with the
greatest id becomes the response and the others are revisits of it. The last pass joins that back by id and
digest, which no hot payload can skew, and streams the chunks into gzip files of about ``file_bytes`` below a shared folder.
Every attempt of a task writes files of its own name, and only those of the attempt that counts are listed in the
returned manifest, so a lost executor leaves at most files that nobody reads.

Reading streams every listed file and yields the chunk rows again, each with the digest and length of the payload so
far; the last chunk's are the record's. Revisits have one empty chunk; their length is the one in their HTTP header.

Null payloads are empty. Rows without an id are response records with an empty id. Rows repeated with the same id
and payload are each written, all as the response or all as revisits of the same one. Very long payloads are read by chunk, but
the writing pass holds one whole in the JVM. Columns other than id, address and payload are not read, so their names do no
harm. An empty table gives no archive, and no archive gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.llm.common import map_arrow, type_of
from spreadrank.storage import materialize, new_folder

# The record format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-record:{}>"
DATE = "2024-01-01T00:00:00Z"

READ_BYTES = 256 << 10
FLUSH_BYTES = 4 << 20


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(df: DataFrame, keep: list[str], payload: Column, chunk_bytes: int) -> DataFrame:
    """The columns ``keep`` and ``chunk, last, data`` for each piece of the payload, in order."""
    whole = df.select(*keep, F.coalesce(payload.cast("binary"), F.lit(b"")).alias("_payload"))
    count = F.greatest(F.lit(1), F.ceil(F.length("_payload") / F.lit(chunk_bytes)).cast("int"))
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("_payload"), i * chunk_bytes + 1, F.lit(chunk_bytes))
    )
    rows = whole.select(*keep, pieces.alias("_pieces"), count.alias("_count"))
    return rows.select(*keep, "_count", F.posexplode("_pieces").alias("chunk", "data")).select(
        *keep, "chunk", (F.col("chunk") == F.col("_count") - 1).alias("last"), "data"
    )


def payload_digests(df: DataFrame, id_col: str, payload: Column, chunk_bytes: int) -> DataFrame:
    """``id, n_bytes, digest`` (hex SHA-1) of each row, from its chunks as they stream by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            rows, sizes, digests = [], [], []
            for at, (last, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                state.update(data.as_buffer())
                size += len(data.as_buffer())
                if last:
                    rows.append(at)
                    sizes.append(size)
                    digests.append(state.hexdigest())
                    state, size = hashlib.sha1(), 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=names,
            )

    names = [id_col, "n_bytes", "digest"]
    return map_arrow(
        chunks(df, [id_col], payload, chunk_bytes), run, f"`{id_col}` {type_of(df, id_col)}, n_bytes long, digest string"
    )


def _records(rows: Iterable[dict], out: Files) -> None:
    """Write the rows, chunks of records in order, to ``out``."""
    packer = None
    for row in rows:
        if row["chunk"] == 0:
            packer = zlib.compressobj(wbits=31)
            out.write(packer.compress(_head(row)))
        if row["refers_to"] is None:
            out.write(packer.compress(row["data"]))
        if row["last"]:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            out.end_record()


def _head(row: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
    revisit = row["refers_to"] is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": RECORD_ID.format("" if row["id"] is None else row["id"]),
        "WARC-Date": DATE,
        # A line break in a header would end it.
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["uri"] or ""),
        "WARC-Payload-Digest": "sha1:" + base32_sha1(bytes.fromhex(row["digest"])),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(http) + (0 if revisit else row["n_bytes"]),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": RECORD_ID.format(row["refers_to"])}
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n" + http).encode()


class Files:
    """Archive files of one task, a new one after ``file_bytes``."""

    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes = folder, file_bytes
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.out, self.done = None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name, self.size, self.records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(data)
        self.size += len(data)

    def end_record(self) -> None:
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.records, self.size))
            self.out = None


def write_archives(
    df: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = 0,
    chunk_bytes: int = 256 << 10,
    file_bytes: int = 128 << 20,
) -> DataFrame:
    """Write a record per row and return the manifest: ``path, records, bytes``. ``folder`` is a URI that all
    executors can write to; without one it is below the session's shared folder."""
    spark = df.sparkSession
    folder = _as_uri(folder or new_folder(spark, "warc"))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    payload = F.col(payload_col)
    digests = materialize(payload_digests(df, id_col, payload, chunk_bytes), "digests")
    shared = digests.filter((F.col("n_bytes") >= min_revisit) & F.col(id_col).isNotNull())
    kept = shared.groupBy("digest").agg(F.max(id_col).alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # One row per id and payload; only those that do not stay what they are.
    revisits = shared.join(kept, "digest").filter(F.col(id_col) < F.col("_kept"))
    revisits = revisits.select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), "_kept").distinct()
    own = F.coalesce(payload.cast("binary"), F.lit(b""))
    pages = df.select(
        F.col(id_col).alias("id"),
        F.col(uri_col).cast("string").alias("uri"),
        own.alias("payload"),
        F.length(own).cast("long").alias("n_bytes"),
        F.sha1(own).alias("digest"),
    )
    resolved = pages.join(revisits, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    ready = resolved.select("id", "uri", "n_bytes", "digest", F.col("_kept").alias("refers_to"), "payload")
    # A revisit has no payload of its own to be cut up.
    body = F.when(F.col("refers_to").isNull(), F.col("payload"))
    rows = chunks(ready, ["id", "uri", "n_bytes", "digest", "refers_to"], body, chunk_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Files(folder, file_bytes)
        _records((row for batch in batches for row in batch.to_pylist()), out)
        out.close()
        paths, records, sizes = zip(*out.done) if out.done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"],
        )

    return materialize(map_arrow(rows, run, "path string, records long, bytes long"), "manifest")


def _as_uri(folder: str) -> str:
    return folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"


class Members:
    """The bytes of a gzip file of many members, decompressed as they are asked for."""

    def __init__(self, source):
        self.source, self.unpack, self.raw, self.ready = source, zlib.decompressobj(wbits=31), b"", b""

    def more(self) -> bool:
        """Have more bytes ready; False at the end."""
        while True:
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data or self.raw, zlib.decompressobj(wbits=31)
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
                if not self.raw:
                    return False
            data = self.unpack.decompress(self.raw, READ_BYTES)
            self.raw = self.unpack.unconsumed_tail
            if data:
                self.ready += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is skipped; None at the end of the file."""
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                return None
        found, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        if not self.ready and not self.more():
            raise EOFError("the archive ends within a record")
        found, self.ready = self.ready[:most], self.ready[most:]
        return found


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_records(source, chunk_bytes: int) -> Iterator[tuple]:
    """``record_id, record_type, target_uri, refers_to, payload_digest, chunk, last, data, n_bytes, digest`` rows
    of one archive. ``n_bytes`` and ``digest`` (base32 SHA-1) are of the payload up to and with this chunk; a
    revisit's are the ones its headers give."""
    members = Members(source)
    while (head := members.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        revisit = fields["warc-type"] == "revisit"
        block = int(fields["content-length"])
        http = members.until(b"\r\n\r\n")
        left = block - len(http) - 4
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        fixed = (fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), told)
        state, size, chunk, held = hashlib.sha1(), 0, 0, b""
        while True:
            while left and len(held) < chunk_bytes:
                piece = members.take(min(left, chunk_bytes - len(held)))
                held += piece
                left -= len(piece)
            state.update(held)
            size += len(held)
            if revisit:
                yield (*fixed, chunk, True, b"", int(_fields(http)["content-length"]), told)
                break
            yield (*fixed, chunk, not left, held, size, base32_sha1(state.digest()))
            if not left:
                break
            held, chunk = b"", chunk + 1
        members.until(b"\r\n\r\n")


COLUMNS = [
    ("record_id", pa.string()),
    ("record_type", pa.string()),
    ("target_uri", pa.string()),
    ("refers_to", pa.string()),
    ("payload_digest", pa.string()),
    ("chunk", pa.int32()),
    ("last", pa.bool_()),
    ("data", pa.binary()),
    ("n_bytes", pa.int64()),
    ("digest", pa.string()),
]


def read_archives(manifest: DataFrame, chunk_bytes: int = 256 << 10) -> DataFrame:
    """The chunk rows of all archives in ``manifest`` (column ``path``)."""
    spark: SparkSession = manifest.sparkSession
    files = manifest.select("path").filter(F.col("path").isNotNull())
    paths = files.repartition(max(1, spark.sparkContext.defaultParallelism, files.count()), "path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as source:
                    for row in read_records(source, chunk_bytes):
                        held.append(row)
                        size += len(row[7]) + 300
                        if size >= FLUSH_BYTES:
                            yield as_batch(held)
                            held, size = [], 0
        if held:
            yield as_batch(held)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), COLUMNS)]
        return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in COLUMNS])

    return map_arrow(
        paths,
        run,
        "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
        "chunk int, last boolean, data binary, n_bytes long, digest string",
    )


def id_in(record: str) -> Column:
    """The id in a record id of ours; null for the empty one."""
    return F.nullif(F.regexp_extract(record, r"(?s)^<urn:x-record:(.*)>$", 1), F.lit(""))
