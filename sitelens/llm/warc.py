"""WARC archives: a writer and a Python data source.

Writer: one ``response`` record per page, or a ``revisit`` record that refers to
the response with the same payload.  Each record is a gzip member whose header
carries the standard's "sl" field (compressed and uncompressed length), so a
reader can step over a record without inflating it.

Data source ``warc``: plans partitions from the file list (small files share a
partition), takes equality and IN predicates on record type, target URI and
record id, inflates a record's headers first, and inflates and decodes the
payload only of records that pass, and only if the schema has it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from sitelens.llm.common import salted_join, scratch_folder

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def gzip_member(data: bytes) -> bytes:
    """``data`` as one gzip member whose extra field "sl" holds its lengths."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8                 # header with extra field, body, checksum and length
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def warc_record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, full_bytes: int,
                refers_to: str | None) -> bytes:
    http = b""
    if kind == "response":
        http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(full_bytes)),
            ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(block))))
    clean = lambda s: s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    lines = "".join(f"{k}: {clean(v) if k == 'WARC-Target-URI' else v}\r\n" for k, v in head)
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def classified(pages: DataFrame) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to to pages (page_id, url, html).

    Only digests met twice or more are joined back, with their first page; the
    join is salted, so a payload shared by a third of the pages is split.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))
    firsts = (rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = salted_join(rows, firsts, ["payload_digest"], F.struct("page_id", "url"), "left")
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(True))
    return joined.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write pages as WARC files under ``folder``; Spark commits the list of files in ``_files``.

    A null url becomes empty and a null html an empty payload.  Records with equal
    payloads of 100 bytes or more refer to the one with the smallest page_id
    (repeated rows of that id are all responses; null ids count last).
    """
    def task(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                page, url, html, digest, full, kind, first = r
                if out is None:
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = gzip_member(warc_record(
                    kind, record_id(page), url or "", digest, html.encode() if kind == "response" else b"", full,
                    record_id(first) if kind == "revisit" else None))
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((name, size))
        if out is not None:
            out.close()
            done.append((name, size))
        if done:
            yield pa.RecordBatch.from_pydict({"name": [d[0] for d in done], "size": [d[1] for d in done]})

    classified(pages).mapInArrow(task, "name string, size long").write.json(f"{folder}/_files")


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    PUSHED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI"}

    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.folder = options["path"]
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in self.PUSHED and values is not None:
                header = self.PUSHED[name]
                self.allowed[header] = values & self.allowed.get(header, values)
            else:
                yield f

    def partitions(self):
        fs, path = pafs.FileSystem.from_uri(self.folder)
        listed = fs.get_file_info(pafs.FileSelector(f"{path}/_files", allow_not_found=True))
        files = []
        for info in listed:                    # the committed list, if the folder has one
            if info.base_name.startswith("part-"):
                with fs.open_input_stream(info.path) as f:
                    files += [(d["size"], d["name"]) for d in map(json.loads, f.read().decode().splitlines())]
        if not listed:
            files = [(i.size, i.base_name) for i in fs.get_file_info(pafs.FileSelector(path))
                     if i.base_name.endswith((".warc.gz", ".warc"))]
        plan, room = [], 0
        for size, name in sorted(files, reverse=True):
            if not plan or size > room:
                plan.append([])
                room = PARTITION_BYTES
            plan[-1].append(name)
            room -= size
        return [WarcPartition(p) for p in plan] or [WarcPartition([])]

    def read(self, partition):
        fs, path = pafs.FileSystem.from_uri(self.folder)
        want_payload = "payload" in self.names
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(f"{path}/{name}") as f:
                for head, payload in records(f, name, self.allowed, want_payload):
                    rows.append({"record_type": head.get("WARC-Type"), "record_id": head.get("WARC-Record-ID"),
                                 "target_uri": head.get("WARC-Target-URI"), "refers_to": head.get("WARC-Refers-To"),
                                 "payload_digest": head.get("WARC-Payload-Digest"),
                                 "payload_bytes": int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None,
                                 "payload": payload})
                    size += 500 + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; give a schema without payload to skip decoding it."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)


def _members(f, name):
    """(offset, length) of each gzip member; a length of None ends the walk: read on in sequence."""
    at, end = 0, f.size()
    while at < end:
        start = f.read_at(min(64, end - at), at)
        if name.endswith(".warc"):
            yield at, None
            return
        if start[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"{name}: no gzip member at {at}")
        length = None
        if start[3] & 4 and start[12:14] == b"sl":
            length = struct.unpack_from("<I", start, 16)[0]
        yield at, length
        if length is None:
            return
        at += length


def records(f, name: str, allowed: dict[str, set[str]], want_payload: bool):
    """(headers, payload or None) of the records that pass; other payloads are not inflated."""
    for at, length in _members(f, name):
        if length is None:                     # foreign file: no lengths to step by
            yield from _plain(f, name, at, allowed, want_payload)
            return
        data = f.read_at(length, at)
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(data, 4096)
        while b"\r\n\r\n" not in text and inflate.unconsumed_tail:
            text += inflate.decompress(inflate.unconsumed_tail, 4096)
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = parse_head(head)
        if any(fields.get(h) not in values for h, values in allowed.items()):
            continue
        payload = None
        if want_payload:
            rest += inflate.decompress(inflate.unconsumed_tail) + inflate.flush()
            payload = http_payload(fields, rest[:int(fields["Content-Length"])])
        yield fields, payload


def _plain(f, name, at, allowed, want_payload):
    """Records of an uncompressed file, or of gzip members without lengths: read in sequence."""
    f.seek(at)
    stream = pa.CompressedInputStream(f, "gzip") if name.endswith(".gz") else f
    held = b""

    def more(n):
        nonlocal held
        while len(held) < n:
            part = stream.read(max(65536, n - len(held)))
            if not part:
                return False
            held += part
        return True

    while True:
        n = 1
        while b"\r\n\r\n" not in held:
            n = len(held) + 1
            if not more(n):
                return
        head, _, held = held.partition(b"\r\n\r\n")
        fields = parse_head(head.lstrip(b"\r\n"))
        size = int(fields["Content-Length"])
        more(size + 4)
        block, held = held[:size], held[size + 4:]
        if all(fields.get(h) in values for h, values in allowed.items()):
            yield fields, http_payload(fields, block) if want_payload else None


def parse_head(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    out = {k: v for k, _, v in pairs}
    if "WARC-Target-URI" in out:
        uri = out["WARC-Target-URI"]
        out["WARC-Target-URI"] = uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return out


def http_payload(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("WARC-Type") == "response" and block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_warc(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc")
    return (reader.schema(schema) if schema else reader).load(folder)


def page_number(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken of the payload that was read; those
    of a revisit from its headers.
    """
    folder = folder or scratch_folder(pages.sparkSession, "warc")
    write_warc(pages, folder)
    back = read_warc(pages.sparkSession, folder)
    response = F.col("record_type") == "response"
    return back.select(
        page_number(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1))
        .alias("payload_digest"),
        "record_type", page_number(F.col("refers_to")).alias("refers_to"), "target_uri")
