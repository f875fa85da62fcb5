"""WARC archives in Zstandard: a dictionary up front and one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary;
every record after it is a frame of its own, compressed with that dictionary, so records
are decoded one at a time. The dictionary is trained on a bounded sample of payloads.

A page is a ``response`` record with an HTTP head and the payload. Of records with equal
payloads of at least ``min_bytes`` bytes, that with the largest ``page_id`` is the
response; the others are ``revisit`` records, with the head alone and a reference to it.

Defined results. Null html is an empty payload; so are its digest and length. Null
``page_id``: the record is a response, is referred to by none, and reads back as null.
Repeated rows (equal ``page_id`` and payload) are one response and revisits that refer to
their own number. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm.common import hash_cut, shared_folder, written
from tarnwork.llm.store import read_file, write_file

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of records, as stored, after which an archive is closed.
ARCHIVE_BYTES = 32_000_000
#: The sample that the dictionary is trained on: so many pages, so many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 8_192, 65_536
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = re.compile(r"<urn:page:(-?\d+|null)(?::\d+)?>")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    match = RECORD_ID.fullmatch(record)
    if not match:
        raise ValueError(f"not a record id of this archive: {record}")
    return None if match[1] == "null" else int(match[1])


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """The WARC record of a page; a revisit if it refers to one."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers_to))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(data: bytes, first: str) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the block after them starts."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a header has no end")
    lines = data[:end].decode().split("\r\n")
    if not re.fullmatch(first, lines[0]):
        raise ValueError(f"unexpected first line: {lines[0][:80]}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in out:
            raise ValueError(f"a bad or repeated header line: {line[:80]}")
        out[name.lower()] = value.strip()
    return out, end + 4


def parsed(data: bytes) -> dict:
    """A record's page, url, type, payload and digest; raises if anything is amiss."""
    fields, at = _fields(data, r"WARC/1\.[01]")
    needed = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"}
    if missing := needed - fields.keys():
        raise ValueError(f"header lines are missing: {', '.join(sorted(missing))}")
    if not re.fullmatch(r"\d+", fields["content-length"]):
        raise ValueError("a content length is no number")
    size = int(fields["content-length"])
    block = data[at : at + size]
    if len(block) != size or data[at + size :] != b"\r\n\r\n":
        raise ValueError("a record's length does not agree with its content length")
    if (digest := fields.get("warc-block-digest")) and digest != f"sha1:{sha1_base32(block)}":
        raise ValueError("a block does not have its digest")
    http, begin = _fields(block, r"HTTP/1\.[01] \d{3}.*")
    payload, length = block[begin:], int(http.get("content-length", "-1"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != length or sha1_base32(payload) != digest:
            raise ValueError("a payload does not have its length or digest")
        refers_to = None
    elif kind == "revisit":
        if payload or length < 0 or "warc-refers-to" not in fields:
            raise ValueError("a revisit has a payload, or no length or reference")
        refers_to = page_of(fields["warc-refers-to"])
    else:
        raise ValueError(f"a record of type {kind}")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri", ""),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": refers_to,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that holds a dictionary, itself compressed."""
    body = zstandard.ZstdCompressor(level=10).compress(dictionary) if dictionary else b""
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def opened(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """The decompressor of an archive and where its first record's frame starts."""
    if len(data) < 8:
        raise ValueError("an archive is cut short")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("an archive does not begin with its dictionary")
    body = data[8 : 8 + size]
    if len(body) != size:
        raise ValueError("a dictionary is cut short")
    if size >= 4 and struct.unpack_from("<I", body)[0] == FRAME:
        body = zstandard.ZstdDecompressor().decompress(body)
    own = zstandard.ZstdCompressionDict(body) if body else None
    return zstandard.ZstdDecompressor(dict_data=own), 8 + size


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    decompressor, at = opened(data)
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 4 or struct.unpack_from("<I", data, at)[0] != FRAME:
            raise ValueError(f"no frame at byte {at}")
        one = decompressor.decompressobj()
        # A frame's end shows only when it is decoded: feed it piece by piece.
        parts, step, begin = [], 65_536, at
        while not one.eof:
            piece = view[begin : begin + step]
            if not len(piece):
                raise ValueError("a frame is cut short")
            parts.append(one.decompress(piece))
            begin += len(piece)
        at = begin - len(one.unused_data)
        yield b"".join(parts)


def train(pages: DataFrame) -> bytes:
    """A dictionary from at most ``SAMPLE_PAGES`` starts of pages; empty if they are few.

    Pages are chosen by the hashes of number and url, which is all that is read to choose
    them; only the chosen ones' starts travel.
    """
    h = F.xxhash64("page_id", "url").alias("h")
    cut = hash_cut(pages.select(h), SAMPLE_PAGES)
    chosen = pages if cut is None else pages.where(h <= cut)
    sample = (
        chosen.groupBy(h)
        .agg(F.min(F.substring("html", 1, SAMPLE_BYTES)).alias("start"))
        .orderBy("h")
        .collect()
    )
    try:
        starts = [row["start"].encode() for row in sample if row["start"]]
        return zstandard.train_dictionary(DICTIONARY_BYTES, starts).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def planned(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id``, ``url``, ``html``, and ``refers_to`` for revisits.

    Digests are counted where they are read; what is joined back to the pages is a row
    per page that has an equal, by page number, so that no group of copies is one task.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    keys = rows.where(F.octet_length("html") >= min_bytes).select(
        "page_id", F.sha1(F.col("html")).alias("sha1")
    )
    keys = written(keys.where("page_id is not null"), "page-digests")
    first = keys.groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count("*").alias("c"))
    copies = (
        keys.join(first.where("c > 1"), "sha1")
        .groupBy(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "kept")
        .agg(F.count("*").alias("_times"))
    )
    same = (F.col("page_id") == F.col("_id")) & (F.sha1(F.col("html")) == F.col("_sha1"))
    joined = rows.join(copies, same, "left")
    refers = F.when(F.col("page_id") != F.col("kept"), F.col("kept")).alias("refers_to")
    columns = "page_id", "url", "html"
    if copies.where("_times > 1").isEmpty():
        return joined.select(*columns, refers)
    # Rows that repeat a page in full are counted where they are read, html and all; one is
    # written as the page itself, the others refer to it and need no payload of their own.
    single = joined.where("_times is null or _times = 1").select(*columns, refers)
    repeated = (
        joined.where("_times > 1")
        .groupBy("page_id", "url", "kept", "_sha1")
        .agg(F.first("html").alias("html"), F.count("*").alias("n"))
    )
    order = Window.partitionBy("page_id", "_sha1").orderBy("url")
    numbered = repeated.withColumn("first", F.row_number().over(order) == 1)
    each = numbered.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    itself = F.col("first") & (F.col("nth") == 1) & (F.col("page_id") == F.col("kept"))
    return single.union(each.select(*columns, F.when(~itself, F.col("kept")).alias("refers_to")))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write archives of all pages to ``folder``; the manifest, a row per archive."""
    dictionary = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=own)
        held, size = [dictionary_frame(dictionary)], 0

        def flush() -> pa.RecordBatch:
            name = write_file(folder, ".warc.zst", held)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(held) - 1], pa.int64())], ["file", "records"]
            )

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                payload = html.as_py().encode()
                data = record(
                    page_id.as_py(), url.as_py(), payload, sha1_base32(payload), refers_to.as_py()
                )
                held.append(compressor.compress(data))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = held[:1], 0
        if len(held) > 1:
            yield flush()

    rows = planned(pages, min_bytes)
    return written(rows.mapInArrow(run, "file string, records long"), "warc-manifest")


RECORD = (
    "page_id long, url string, record_type string, payload binary, payload_bytes long, "
    "payload_digest string, refers_to long"
)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the manifest's archives."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip([x.split()[0] for x in RECORD.split(", ")], kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size, seen = [], 0, 0
                for data in records(read_file(folder, name)):
                    rows.append(parsed(data))
                    seen, size = seen + 1, size + len(data)
                    if size >= 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, the manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = min(max(manifest.count(), 1), 10_000)
    dealt = manifest.select("file", "records").repartition(n, F.xxhash64("file"))
    return dealt.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages written to new archives in the shared folder and read back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder)
