"""WARC archives in Zstandard: one frame per record, a dictionary in a leading skippable frame, revisits for equal payloads."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.session import cut

#: Fixed values of the format.
SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID_PREFIX = "urn:page:"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


class ArchiveError(ValueError):
    """An archive breaks the format."""


def _label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    """Header values are one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the payload's length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _label(payload)), ("WARC-Block-Digest", _label(block)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _one_line(url)))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def pack_archive(records: list[bytes], dictionary_bytes: int) -> bytes:
    """An archive of the records. The dictionary is trained on the leading records, up to 100 times its size; if they are too few
    or too alike to train on, the archive has no dictionary frame."""
    samples, room = [], 100 * dictionary_bytes
    for r in records:
        if room <= 0:
            break
        samples.append(r[:room])
        room -= len(r)
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, samples) if len(samples) > 7 else None
    except zstandard.ZstdError:
        trained = None
    press = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    data = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes()) if trained else b""
    lead = struct.pack("<II", SKIPPABLE_DICTIONARY, len(data)) + data if trained else b""
    return lead + b"".join(press.compress(r) for r in records)


def archive_frames(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each frame after the dictionary frame, whose dictionary may itself be compressed."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE_DICTIONARY:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if len(raw) != size:
            raise ArchiveError("the dictionary frame is cut short")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
        at = 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame, parts = opener.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(data):
                    raise ArchiveError("the last frame is cut short")
                piece = view[at : at + step]
                parts.append(frame.decompress(piece))
                at += len(piece) - len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"bad frame: {e}") from e
        yield b"".join(parts)


def _headers(text: bytes) -> dict[str, str]:
    found = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def parse_record(data: bytes) -> tuple:
    """Checks one record (version, mandatory headers, lengths, block and payload digest) and gives its RECORD fields."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not blank or first != VERSION:
        raise ArchiveError("no WARC/1.1 header")
    h = _headers(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise ArchiveError(f"missing {sorted(missing)}")
    if not h["content-length"].isdigit():
        raise ArchiveError("Content-Length is no number")
    size = int(h["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length differs from the block")
    if "warc-block-digest" in h and h["warc-block-digest"] != _label(block):
        raise ArchiveError("block digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        raise ArchiveError("no HTTP header")
    claimed = _headers(http.partition(b"\r\n")[2]).get("content-length", "")
    digest = h.get("warc-payload-digest", "")
    kind = h["warc-type"]
    if not claimed.isdigit() or not digest.startswith("sha1:"):
        raise ArchiveError("payload length or digest is missing")
    if kind == "response" and (len(payload) != int(claimed) or _label(payload) != digest):
        raise ArchiveError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise ArchiveError("a revisit with a payload or without its response")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"unknown record type {kind}")
    uri = lambda name: h[name].strip("<>") if name in h else None
    return (uri("warc-record-id"), kind, h.get("warc-target-uri"), uri("warc-refers-to"), base64.b32decode(digest[5:]).hex(), int(claimed), None if kind == "revisit" else payload)


def mark_revisits(pages: DataFrame, key: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """(key, url, html, refers_to): refers_to is the key of the response that has the same payload of at least `least_bytes`."""
    p = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    groups = p.where("digest is not null").groupBy("digest").agg(F.max("key").alias("newest"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("n > 1 and newest is not null").select("digest", "newest"))
    joined = p.join(groups, "digest", "left")
    return joined.select("key", "url", "html", F.when(~F.col("key").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000,
    archive_bytes: int = 8 << 20, dictionary_bytes: int = 16 << 10, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """(archive, content): `.warc.zst` archives of about `archive_bytes` before compression, a record per row of `pages`.

    Archives are rows, so Spark's own writers put them into any store; each content is a complete file. The record with the largest
    key among equal payloads is the response, the others revisit it. Rows of one key and payload (repeated rows) are all
    responses; rows without a key revisit the group's response if a key exists. Null html is an empty payload, null
    urls give no target header. Other columns are not read; an empty table gives no archive.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k, u, text, ref in zip(batch["key"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                name = lambda x: ID_PREFIX + ("" if pd.isna(x) else str(x))
                held.append(record_bytes(name(k), u, text.encode(), None if pd.isna(ref) else name(ref), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [f"{part:06d}-{number:06d}.warc.zst"], "content": [pack_archive(held, dictionary_bytes)]})
                    number, held, size = number + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [f"{part:06d}-{number:06d}.warc.zst"], "content": [pack_archive(held, dictionary_bytes)]})

    marked = mark_revisits(pages, key, url, html, least_bytes)
    as_text = [F.col(c).cast("string").alias(c) for c in ("key", "refers_to")]
    return marked.select("url", "html", *as_text).mapInPandas(pack, "archive string, content binary")


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of all archives, in the RECORD fields; a broken archive raises ArchiveError.

    Takes the table of `write_archives` or files read with Spark's `binaryFile` source. Null contents hold no record.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                rows, size = [], 0
                for frame in archive_frames(data or b""):
                    rows.append(parse_record(frame))
                    size += len(frame)
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select(F.col(content).alias("content")).mapInPandas(unpack, RECORD)


def page_key(record_id: str, kind: str = "long") -> Column:
    """The row key inside a record id; null for rows written without one."""
    return F.nullif(F.substring(record_id, len(ID_PREFIX) + 1, 1000), F.lit("")).cast(kind)
