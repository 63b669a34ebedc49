"""WARC archives of Zstandard frames: a dictionary up front, one record a frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
compressed; each further frame is one record. Writing tasks roll archives at ARCHIVE_BYTES and
return a manifest, which is stored: files of lost or repeated attempts are in no manifest. Readers
open the manifest's files one after another and stream them, holding one record at a time, and
check the version line, the required headers, the block's length, the payload's length and digest,
and the record's end.

Pages with equal payloads (by SHA-1) of at least ``least`` bytes: that of the smallest page_id is
the response, the others are revisits that refer to it and carry no payload. Digests are counted
with partial sums and joined with hot digests dealt apart.

Defined cases: a null html is an empty payload; a null url writes no target; a null page_id comes
after all others and reads back as null; pages of the same smallest id are all responses; without
pages there is one archive per task at most and no record; texts of any length are one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import join_counted, scratch, store, text_slices

ARCHIVE_BYTES = 32 << 20
#: The dictionary: its size, and the most pages and bytes of html it is trained on.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_BYTES = 64 << 10, 400, 16 << 20
LEVEL = 3
#: Fixed values of the format.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = ("page_id long, record_type string, url string, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")


class Broken(ValueError):
    """A record that does not keep to the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, payload_digest)}>"


def page_of(name: str | None) -> int | None:
    return int(name[len("<urn:x-page:"):-1]) if name and name.startswith("<urn:x-page:") else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name, revisit = digest(payload), refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id, name)),
            ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    block = HTTP_HEAD % len(payload)
    if revisit:
        head += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    else:
        block += payload
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of one record; Broken if a header, a length or the digest is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise Broken("no version line or no end of the header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode().partition(":")
        if not colon or key != key.strip() or key.lower() in fields:
            raise Broken(f"header line {line[:80]!r}")
        fields[key.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-payload-length"} - set(fields)
    if missing or not fields["content-length"].isdigit() or not fields["warc-payload-length"].isdigit():
        raise Broken(f"missing or wrong headers {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Broken("the block does not end where Content-Length says")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    kind, length = fields["warc-type"], int(fields["warc-payload-length"])
    if not sep or not http.startswith(b"HTTP/1.1 ") or kind not in ("response", "revisit"):
        raise Broken("no HTTP head or an unknown type")
    name = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != name):
        raise Broken("the payload differs from its length or digest")
    if kind == "revisit" and (payload or page_of(fields.get("warc-refers-to")) is None):
        raise Broken("a revisit with a payload or without its response")
    return {"page_id": page_of(fields["warc-record-id"]), "record_type": kind, "url": fields.get("warc-target-uri"),
            "payload_bytes": length, "payload_digest": name, "refers_to": page_of(fields.get("warc-refers-to")),
            "payload": payload if kind == "response" else None}


def trained(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample, the texts of the smallest hashes, empty where the
    sample is too small for one. Hashes alone are compared first, so tasks send no texts that
    are not chosen."""
    few = pages.where(F.length("html") > 0).select("html", F.octet_length("html").alias("size"), F.xxhash64("html").alias("h"))
    few = few.where(F.col("size") <= SAMPLE_BYTES // SAMPLE_PAGES)
    chosen = few.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES)
    rows = few.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html"))
    texts = [r["html"].encode() for r in sorted(rows.collect(), key=lambda r: r["h"])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    content = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(content)) + content


def dictionary_of(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def tag_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to) with the page that each revisit refers to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    marks = rows.where(F.octet_length("html") >= least).select("page_id", "sha1")
    first = marks.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = store(first, "warc-first")
    total = first.agg(F.sum("n")).first()[0] or 0
    revisits = join_counted(marks, first, ["sha1"], "n", total).where("first IS NOT NULL AND NOT page_id <=> first")
    revisits = revisits.select("page_id", "sha1", "first").distinct().alias("v")
    same = F.expr("r.sha1 = v.sha1 AND r.page_id <=> v.page_id")
    return rows.alias("r").join(revisits, same, "left").select(
        F.col("r.page_id").cast("long").alias("page_id"), "r.url", "r.html", F.col("v.first").cast("long").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; the stored manifest
    (path, records, bytes)."""
    sent = pages.sparkSession.sparkContext.broadcast(trained(pages))
    rows = tag_revisits(pages, least)

    def write(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        held = dictionary_of(sent.value)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True)
        out, path, made = None, "", {"path": [], "records": [], "bytes": []}
        number = size = 0

        def close() -> None:
            if out is not None:
                out.close()
                for key, value in (("path", path), ("records", number), ("bytes", size)):
                    made[key].append(value)

        for part, texts in text_slices(batches, "html"):
            columns = [part.column(c).to_pylist() for c in ("page_id", "url", "refers_to")]
            for page_id, url, refers_to, html in zip(*columns, texts, strict=True):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    path, number = f"{folder.rstrip('/')}/{name}", 0
                    out = system.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)
                    frame = dictionary_frame(sent.value)
                    out.write(frame)
                    size = len(frame)
                frame = packer.compress(record(page_id, url, html, refers_to))
                out.write(frame)
                number, size = number + 1, size + len(frame)
        close()
        yield pa.RecordBatch.from_pydict(made, schema=pa.schema(
            [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return store(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one frame each, with the dictionary it leads with."""
    head = stream.read(8)
    held, data = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        content = stream.read(struct.unpack("<I", head[4:])[0])
        if content[:4] == ZSTD_FRAME:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        held, data = dictionary_of(content), b""
    opener = zstandard.ZstdDecompressor(dict_data=held)
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if not data:
                raise Broken("the archive ends inside a frame")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else stream.read(chunk)
        yield b"".join(parts)


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives named in ``manifest`` (path); a broken one raises."""
    def read(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = file_system(path)
                rows, held = [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for data in frames(stream):
                        row = parsed(data)
                        rows.append(row if payload else row | {"payload": None})
                        held += len(data) if payload else 256
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds, strict=True))))
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds, strict=True))))

    number = max(1, manifest.count())
    return manifest.select("path").repartition(number).mapInArrow(read, RECORD)


def report(pages: DataFrame) -> DataFrame:
    """Write all pages, read all archives back: what each page's record says."""
    folder = scratch(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder), payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
