"""WARC archives: a writer of monolithic gzip streams, and the normaliser that makes them seekable.

The normaliser inflates a whole-file gzip stream once, piece by piece, rewrites every record as a
gzip member of its own and writes a sidecar index with each record's offset. Readers then
seek to single records. A stream can't be entered in the middle, so a file is one task; the
writer bounds the size of its files. All files go to a folder that every executor sees, under
names that no other attempt of a task uses; only files named in the written manifest count, so
lost executors leave nothing but unused files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import fresh_path, pick, saved

PIECE = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, revisit_of, date: str) -> bytes:
    """One WARC record: a response with the payload, or a revisit that only names its response."""
    url = re.sub(r"\s", "%20", url) if url is not None else None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit_of is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if revisit_of is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {url}"] if url is not None else []),
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {revisit_of}"] if revisit_of is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name, of the lines before the empty line."""
    first, *lines = block.split(b"\r\n")
    pairs = (x.decode(errors="replace").partition(":") for x in lines if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs} | {"": first.decode(errors="replace")}


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload and refers_to, the response's page_id for revisits.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response; rows that
    share this id are all responses. Rows without an id are revisits where some equal payload has
    an id, else responses. Only payloads that occur twice or more are joined.
    """
    rows = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    many = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("sha")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1 and response is not null")
        .select("sha", "response")
    )
    joined = rows.join(many, "sha", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write(rows: DataFrame, path: str, *, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes rows of ``revisits`` as archives, each one gzip stream; the manifest (file, records).

    A file is closed once it holds ``file_bytes`` of records before compression.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        out = None
        done = []
        for batch in batches:
            for page, url, payload, refers in batch[["page_id", "url", "payload", "refers_to"]].astype(object).itertuples(index=False):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, zipper, size, count = system.open_output_stream(name, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                data = record(None if pd.isna(page) else int(page), url, payload, None if pd.isna(refers) else int(refers), date)
                out.write(zipper.compress(data))
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.write(zipper.flush())
                    out.close()
                    done.append((name.rsplit("/", 1)[1], count))
                    out = None
        if out is not None:
            out.write(zipper.flush())
            out.close()
            done.append((name.rsplit("/", 1)[1], count))
        yield pd.DataFrame(done, columns=["file", "records"])

    return saved(rows.mapInPandas(run, "file string, records long"), "warc-manifest")


class Inflater:
    """Bytes of a gzip file of one or more members, asked for piece by piece."""

    def __init__(self, source) -> None:
        self.source, self.unzip, self.ready, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        raw = self.unzip.unconsumed_tail
        if self.unzip.eof:
            raw, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        raw = raw or self.source.read(PIECE)
        if not raw:
            self.ended = True
            return False
        self.ready += self.unzip.decompress(raw, PIECE)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``; None at the file's end."""
        at = 0
        while (found := self.ready.find(mark, at)) < 0:
            at = max(0, len(self.ready) - len(mark))
            if not self.more():
                if bytes(self.ready).strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        got = bytes(self.ready[:found])
        del self.ready[: found + len(mark)]
        return got

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise ValueError("the archive ends inside a record")
            got = bytes(self.ready[:size])
            del self.ready[: len(got)]
            size -= len(got)
            if got:
                yield got


def normalise_file(source_uri: str, target_uri: str) -> list[tuple[int, int, str]]:
    """Rewrites one archive with a member per record and writes ``target_uri``.idx beside it.

    Returns offset, length and record id of each record. Memory holds a piece of the stream and
    a record's header, never a whole record.
    """
    (system, source), (target_system, target) = opened(source_uri), opened(target_uri)
    index = []
    with system.open_input_stream(source, compression=None) as raw, target_system.open_output_stream(target, compression=None) as out:
        stream, offset = Inflater(raw), 0
        while (head := stream.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            fields = headers(head)
            if not fields[""].startswith("WARC/"):
                raise ValueError("not a WARC record")
            zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(zipper.compress(head + b"\r\n\r\n"))
            for piece in stream.take(int(fields["content-length"])):
                out.write(zipper.compress(piece))
            for _ in stream.take(4):  # the two line ends after a record
                pass
            out.write(zipper.compress(b"\r\n\r\n") + zipper.flush())
            end = out.tell()
            index.append((offset, end - offset, fields.get("warc-record-id", "")))
            offset = end
    with target_system.open_output_stream(f"{target}.idx", compression=None) as side:
        for start, length, name in index:
            side.write(json.dumps({"offset": start, "length": length, "id": name}).encode() + b"\n")
    return index


#: Bytes of an archive that one task reads, and tasks of a stage at most.
STRETCH, MOST_TASKS = 8 << 20, 100_000


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Normalises the manifest's archives, one task each; the index as a table: file, offset, length, record_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = opened(target)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for file in batch["file"]:
                new = f"{uuid.uuid4().hex}.warc.gz"
                rows = normalise_file(f"{source}/{file}", f"{target}/{new}")
                yield pd.DataFrame([(new, *r) for r in rows], columns=["file", "offset", "length", "record_id"])

    # A row stands for a whole archive: as many tasks as archives, however few bytes the rows have.
    files = manifest.select("file").repartition(max(1, min(manifest.count(), MOST_TASKS)))
    return saved(files.mapInPandas(run, "file string, offset long, length long, record_id string"), "warc-index")


def read(index: DataFrame, path: str) -> DataFrame:
    """Reads records by their offsets: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    For revisits the digest and size are those that the record states; a response's are taken
    from its payload, and a payload that doesn't match its record's digest is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file, system = None, None, None
        for batch in batches:
            rows = []
            for wanted, offset, length in batch[["file", "offset", "length"]].itertuples(index=False):
                if wanted != name:
                    if file is not None:
                        file.close()
                    system, folder = opened(path)
                    name, file = wanted, system.open_input_file(f"{folder}/{wanted}")
                file.seek(offset)
                data = zlib.decompress(file.read(length), 31)
                head, _, block = data.partition(b"\r\n\r\n")
                fields = headers(head)
                http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                rows.append(
                    (
                        int(page) if page else None,
                        fields.get("warc-target-uri"),
                        kind,
                        int(refers) if refers else None,
                        len(payload) if kind == "response" else int(headers(http)["content-length"]),
                        digest,
                        payload if kind == "response" else None,
                    )
                )
            out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
            out["page_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            out["refers_to"] = pd.array([r[3] for r in rows], dtype="Int64")
            yield out
        if file is not None:
            file.close()

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    # Stretches of a file are read by different tasks, about one a task.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(size // STRETCH + index.select("file").distinct().count(), MOST_TASKS))
    stretches = index.repartition(tasks, F.col("file"), F.expr(f"offset div {STRETCH}")).sortWithinPartitions("file", "offset")
    return stretches.mapInPandas(run, schema)


def archive(pages: DataFrame, path: str | None = None, *, least: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``pages`` to archives, normalises them and reads them back, as ``read`` does.

    One row for each row of ``pages``, repeated rows included. Null html is an empty payload,
    null urls are left out of the record, ids may be null. Other columns are ignored; no
    pages give no files and no rows.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    manifest = write(revisits(pages, least), f"{path}/streams", file_bytes=file_bytes)
    index = normalise(manifest, f"{path}/streams", f"{path}/records")
    return read(index, f"{path}/records")
