"""Web archives: a data source that writes one gzip member per record and reads archives back record by record."""
from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sunloom.llm.common import written

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
ARROW_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
#: fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


class BrokenArchive(ValueError):
    pass


def file_system(path: str):
    """(file system, path in it) for any place that pyarrow knows: local or mounted folders, HDFS, object stores."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member of its own. A revisit carries the response's HTTP head without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page_id), "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = target
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other, inflated as the bytes come in."""
    inflate, parts, fed = zlib.decompressobj(31), [], False
    while chunk := stream.read(READ_BYTES):
        while chunk:
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise BrokenArchive(f"not a gzip member: {e}") from e
            fed = True
            if not inflate.eof:
                break
            yield b"".join(parts)
            chunk, parts, fed = inflate.unused_data, [], False
            inflate = zlib.decompressobj(31)
    if fed:
        raise BrokenArchive("the last gzip member is cut off")


def decode_record(data: bytes) -> tuple:
    """A row of the schema from an inflated member, framed by its content length and checked against its digests."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION + b"\r\n") or end < 0:
        raise BrokenArchive("no WARC head")
    fields = dict(line.split(": ", 1) for line in data[len(VERSION) + 2 : end].decode().split("\r\n"))
    length = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise BrokenArchive(f"{fields['WARC-Record-ID']}: the content length does not frame the block")
    if fields["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise BrokenArchive(f"{fields['WARC-Record-ID']}: the block digest does not match")
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[: cut - 4].decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block[cut:]
    if payload is not None and (digest != hashlib.sha1(payload).hexdigest() or len(payload) != int(http["Content-Length"])):
        raise BrokenArchive(f"{fields['WARC-Record-ID']}: the payload digest does not match")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return _id_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"], _id_of(fields["WARC-Refers-To"]) if revisit else None, int(http["Content-Length"]), digest, payload


@dataclass
class _Archives(WriterCommitMessage):
    files: list[str]


@dataclass
class _Archive(InputPartition):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """Every task attempt writes files of its own name; those of the attempts that won are listed when the job commits."""

    def __init__(self, options: dict):
        self.path, self.roll, self.date = options["path"], int(options.get("roll_bytes", 64 << 20)), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        attempt, names, out, size = uuid.uuid4().hex, [], None, 0
        try:
            for batch in iterator:
                columns = {n: batch.column(n) for n in ("page_id", "url", "payload", "payload_digest", "refers_to")}
                for k in range(batch.num_rows):
                    if out is None or size >= self.roll:
                        if out is not None:
                            out.close()
                        names.append(f"{attempt}-{len(names):05d}.warc.gz")
                        out, size = store.open_output_stream(f"{folder}/{names[-1]}"), 0
                    v = {n: c[k].as_py() for n, c in columns.items()}
                    record = encode_record(v["page_id"], v["url"], v["payload"], v["payload_digest"], v["refers_to"], self.date)
                    out.write(record)
                    size += len(record)
        finally:
            if out is not None:
                out.close()
        return _Archives(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        import uuid

        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([name for m in messages if m is not None for name in m.files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = file_system(self.path)
        for m in messages:
            for name in m.files if m is not None else []:
                store.delete_file(f"{folder}/{name}")


class WarcReader(DataSourceReader):
    """One partition per archive; an archive is streamed, and at most one record and one batch of rows are in memory."""

    def __init__(self, options: dict):
        self.path, self.with_payload = options["path"], str(options.get("payload", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = file_system(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith("_committed-"):
                with store.open_input_stream(info.path) as listing:
                    found += json.loads(listing.read())
        # an archive needs a partition even if nothing was written, or Spark would read one without a path
        return [_Archive(name) for name in sorted(found)] or [_Archive("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, folder = file_system(self.path)
        rows, size = [], 0
        with store.open_input_stream(f"{folder}/{partition.path}") as stream:
            for data in members(stream):
                row = decode_record(data)
                rows.append(row if self.with_payload else (*row[:-1], None))
                size += len(row[-1] or b"") if self.with_payload else 100
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW_OUT, strict=True)], schema=ARROW_OUT)


class WarcSource(DataSource):
    """Format `warc`. Options: path; for writing roll_bytes (size at which a task begins a new archive) and date; for reading
    payload=false, which checks payloads without handing them out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def records(pages: DataFrame, least_bytes: int = 1000, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): one record per page, later copies pointing at the one that is stored.

    The payload is the page in UTF-8; null counts as empty. Of equal payloads of at least `least_bytes` the one with the
    largest page_id is stored and the others refer to it; smaller ones are always stored, as are rows that repeat the page_id
    of the stored one and groups without any page_id. Pages are not shuffled by content: only digests are grouped, and the
    groups that hold several pages are joined back (broadcast only where their files are below Spark's threshold).
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("payload_digest"), F.xxhash64("payload").alias("check"))
    large = rows.filter(F.octet_length("payload") >= least_bytes).select("page_id", "payload_digest", "check")
    groups = large.groupBy("payload_digest", "check").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).filter("n > 1 and stored is not null").drop("n")
    joined = rows.join(written(groups, "payload-groups"), ["payload_digest", "check"], "left")
    refers = F.when((F.octet_length("payload") >= least_bytes) & ~F.col("stored").eqNullSafe(F.col("page_id")), F.col("stored"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def write_archives(rows: DataFrame, path: str, roll_bytes: int = 64 << 20) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").option("roll_bytes", roll_bytes).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
