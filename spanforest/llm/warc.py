"""WARC archives of pages, each record a Zstandard frame by a shared dictionary.

A dictionary is trained on a bounded sample of the pages' records (of records too
few or too alike to train on, their bytes are the dictionary) and stands at the
head of every file in a skippable frame (magic 0x184D2A5D, itself compressed), so
a file can be read without anything else; every record is a frame of its own, so
a record can be read without the others. Of equal payloads
the one with the smallest page id is archived whole and the others are
`revisit` records that refer to it.

Defined results: null pages have an empty payload; payloads shorter than
`least` bytes are always responses; rows with the same id and payload as the
response are responses too; a null id is larger than any other, is written as
`none` and read back as null; a null url is `about:blank`, and control
characters, spaces and non-ASCII characters in a url are percent-encoded;
an empty table makes no file; other columns are not read. Record ids are
`urn:x-page:` with the page id and, where other records refer to this one, the
payload's digest, else the record's place in its file; so only rows repeated
exactly, which are one record, share an id.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, get, partitions_for, put, ready, shared_dir, written

LEAST = 100
FILE_BYTES = 32 << 20
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 64 << 10, 2000, 8 << 20
#: Characters of a page that the sample takes, so that no long page fills it: at most four bytes each, 32 pages at least.
PAGE_CHARS = SAMPLE_BYTES // 128
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SKIPPABLE = 0x184D2A5D


def urn(page_id: int | None, which: str) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{which}>"


def page_of(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str = "", date: str = DATE) -> bytes:
    """A response, or a revisit of page `refers_to`; `place` tells records apart that no other refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id, place or digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]\'') if url else 'about:blank'}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def information(name: str, date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most `size` bytes; empty only if there are no records."""
    total = sum(map(len, records))
    try:
        if len(records) >= 8:
            return zstandard.train_dictionary(min(size, max(256, total // 8)), records).as_bytes()
    except zstandard.ZstdError:  # too little, or too much alike
        pass
    return b"".join(records)[:size] if total >= 8 else b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, known by its magic number, or bytes as they are."""
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


class Writer:
    """The bytes of one file."""

    def __init__(self, dictionary: bytes, level: int = LEVEL, name: str = "", date: str = DATE):
        self.pieces: list[bytes] = []
        self.size = self.records = 0
        known = _dictionary(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
        if dictionary:
            frame = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(struct.pack("<II", _SKIPPABLE, len(frame)) + frame)
        self._put(self.compressor.compress(information(name, date)))

    def _put(self, data: bytes) -> None:
        self.pieces.append(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))
        self.records += 1


def frames(data: bytes) -> Iterator[bytes]:
    """The records of a file, decompressed one by one."""
    view, at, known = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == _SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
        known = _dictionary(raw)
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + (1 << 14)]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            out.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("no whole WARC record")
    return headers, rest[:size]


def _sampled(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> list[bytes]:
    """Records of the rows whose hashes are smallest: at most SAMPLE_ROWS and SAMPLE_BYTES, each page's text cut after PAGE_CHARS characters."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.substring(F.coalesce(F.col(html_col).cast("string"), F.lit("")), 1, PAGE_CHARS).alias("html"), F.xxhash64(id_col, url_col).alias("h"))
    sizes = rows.select("h", "id", F.octet_length("html").alias("n")).orderBy("h", "id", "n").limit(SAMPLE_ROWS).collect()
    total, many = 0, 0
    for r in sizes:
        if total + r.n > SAMPLE_BYTES:
            break
        total, many = total + r.n, many + 1
    if not many:
        return []
    got = rows.filter(F.col("h") <= sizes[many - 1].h).orderBy("h", "id", F.octet_length("html")).limit(many).collect()
    return [record(r.id, r.url, p := r.html.encode(), hashlib.sha256(p).hexdigest(), None, False) for r in got]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least: int = LEAST, file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE, folder: str | None = None) -> DataFrame:
    """Writes all pages; the manifest has a row a file: file, n_records, n_bytes."""
    spark = pages.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "warc")
    sample = _sampled(pages, id_col, url_col, html_col)
    dictionary = spark.sparkContext.broadcast(train(sample))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    firsts = rows.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.min("id").alias("first_id"), F.count("*").alias("many")).filter("many > 1").drop("many")
    firsts = written(firsts, "first-pages")  # so that the join, straight from two shuffles, is one whose skew Spark splits
    planned = rows.join(firsts, ["digest", "n"], "left").select("id", "url", "payload", "digest", "first_id", (F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))).alias("revisit"))

    def run(batches):
        claim("warc")
        part, number, writer = TaskContext.get().partitionId(), 0, None

        def close():
            uri = f"{folder}/part-{part:06d}-{number:04d}.warc.zst"
            put(uri, writer.pieces)
            return pa.record_batch({"file": [uri], "n_records": [writer.records], "n_bytes": [writer.size]})

        for batch in batches:
            for i, url, data, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or Writer(dictionary.value, level, f"{part}-{number}", date)
                place = "" if first is not None and not revisit else f"{part}-{number}-{writer.records}"
                writer.add(record(i, url, data, digest, first, revisit, place, date))
                if writer.size >= file_bytes:
                    yield close()
                    number, writer = number + 1, None
        if writer:
            yield close()

    return written(planned.mapInArrow(run, "file string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of each record; digests of responses are checked."""
    ready(manifest.sparkSession)

    def rows(uri: str) -> Iterator[tuple]:
        for data in frames(get(uri)):
            headers, block = parse(data)
            if headers["warc-type"] == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = headers["warc-payload-digest"].removeprefix("sha256:")
            revisit = headers["warc-type"] == "revisit"
            if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{uri}: the payload of {headers['warc-record-id']} doesn't agree with its digest")
            yield page_of(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, headers["warc-type"], page_of(headers["warc-refers-to"]) if revisit else None, None if revisit else payload

    def run(batches):
        claim("warc")
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(held):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(uri):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size > 4 << 20 or len(held) >= 5000:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    files = manifest.select("file").repartition(partitions_for(manifest.sparkSession), "file")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
