"""WARC archives: pages written with revisits, read back by a reader that salvages.

The writer decides by payload digest which record of equal payloads is the response,
packs records as gzip members (or plain) into archives of bounded size in a folder that
all executors reach, and returns a list of the archives that counted. A task that
is run again writes under new names; what a lost task left is in no list.

The reader checks each record (member checksum, version line, header, content length,
payload digest). When a check fails it looks for the next member start or version line
from which a record can be read, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import bounded_batches, cut_lineage, shared_folder

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Bytes read from an archive at a time.
READ_BYTES = 1 << 20
#: Payload digests that are checked, with their bytes.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
_VERSION = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"
_DATE = datetime(2020, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string())])


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. The id of a page is in its record id, so that any payload and url comes back whole."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """One gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _length(digits: bytes) -> int | None:
    """A count of bytes; no number of more than eighteen digits is one."""
    return int(digits) if digits.isdigit() and len(digits.lstrip(b"0")) <= 18 else None


def _page(name: bytes) -> int | None:
    """The page id of a record id. One of another form, or that needs more than 64 bits, is none."""
    inner = name.removeprefix(b"<urn:page:").removesuffix(b">")
    if not re.fullmatch(rb"-?[0-9]{1,19}", inner):
        return None
    return int(inner) if -(1 << 63) <= int(inner) < 1 << 63 else None


def _said(value: bytes) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a digest field, in hexadecimal or base 32; None if it is neither."""
    name, colon, text = value.decode("ascii", "replace").strip().partition(":")
    name, text = (name.lower().replace("-", ""), text) if colon else ("sha1", name)
    size = DIGESTS.get(name)
    if size is None:
        return name, b""  # of a kind that is not checked here
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (name, raw) if len(raw) == size else None


def parse(data: bytes) -> tuple[dict, int] | None:
    """The record at the start of ``data`` and its bytes; None unless all of it holds together.

    A payload digest is checked if it is there; what is reported is the SHA-1 in any case
    (of a revisit: the SHA-1 it names, else null).
    """
    if not data.startswith(_VERSION):
        return None
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for line in data[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    size = _length(fields.get(b"content-length", b""))
    if size is None:
        return None
    end = stop + 4 + size
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[stop + 4 : end]
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    http = block.find(b"\r\n\r\n")
    payload = block[http + 4 :] if http >= 0 else b""
    digest = None
    if b"warc-payload-digest" in fields:
        said = _said(fields[b"warc-payload-digest"])
        if said is None:
            return None
        if kind == "response" and said[1] and hashlib.new(said[0], payload).digest() != said[1]:
            return None
        digest = said[1].hex() if said[0] == "sha1" else None
    if kind == "response":
        digest = hashlib.sha1(payload).hexdigest()
    found = {
        "page_id": _page(fields.get(b"warc-record-id", b"")), "record_type": kind, "payload_digest": digest, "refers_to": _page(fields.get(b"warc-refers-to", b"")),
        "payload_bytes": len(payload) if kind == "response" else _length(fields.get(b"warc-payload-length", b"")),
        "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "payload": payload if kind == "response" else None,
    }
    return found, end + 4


def _inflated(data: bytes) -> tuple[bytes, int] | bool:
    """The member at the start of ``data`` whole and checked, and its packed bytes; True if it is cut off, False if damaged."""
    pull = zlib.decompressobj(31)
    try:
        out = pull.decompress(data)
    except zlib.error:
        return False
    return (out, len(data) - len(pull.unused_data)) if pull.eof else True


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """``("record", (offset, record))`` and ``("gap", (offset, bytes))`` over the whole of an archive, in order.

    Members and plain records may follow each other. Members are packed one record each.
    """
    at, bad = 0, -1
    ahead = {_MEMBER: -1, _VERSION: -1}  # the next start of each kind, looked for once
    stop, line = -1, -1  # the next end of a header and the next version line, looked for once too
    while at < len(data):
        found = None
        if data.startswith(_MEMBER, at):
            # Members are small against archives; windows that double keep a damaged one from reading all the rest.
            window = 1 << 16
            while True:
                whole = _inflated(data[at : at + window])
                if whole is not True or at + window >= len(data):
                    break
                window *= 4
            whole = whole if isinstance(whole, tuple) else None
            got = whole and parse(whole[0])
            if got and got[1] == len(whole[0]):
                found = got[0], whole[1]
        elif data.startswith(_VERSION, at):
            if stop < at:
                stop = data.find(b"\r\n\r\n", at)
                stop = stop if stop >= 0 else len(data)
            if line < at:
                line = data.find(b"\r\n" + _VERSION, at)
                line = line if line >= 0 else len(data)
            # A header of any length, but it holds no other version line.
            low = data[at:stop].lower() if stop < line else b""
            place = low.find(b"\ncontent-length:")
            size = _length(low[place + 16 :].split(b"\r\n")[0].strip()) if place >= 0 else None
            if size is not None:
                got = parse(data[at : stop + 4 + size + 4])
                found = got and (got[0], got[1])
        if found:
            if bad >= 0:
                yield "gap", (bad, at - bad)
                bad = -1
            yield "record", (at, found[0])
            at += found[1]
            continue
        if bad < 0:
            bad = at
        for mark, place in ahead.items():
            if place <= at:
                place = data.find(mark, at + 1)
                ahead[mark] = place if place >= 0 else len(data)
        at = min(ahead.values())
    if bad >= 0:
        yield "gap", (bad, len(data) - bad)


def _writer(folder: str, packed: bool, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, many = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, html, refers_to, digest in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if out is None:
                    name, size, many = f"pages-{uuid.uuid4().hex}.warc{'.gz' * packed}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                size += out.write(member(data) if packed else data)
                many += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, many))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, many))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "bytes", "records"])

    return run


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        names = ["archive", "offset", "gap_bytes", "page_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "url", *["payload"] * payloads]
        kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{archive}") as stream:
                    data = stream.read()
                rows = []
                for what, (offset, found) in salvage(data):
                    rows.append((archive, offset, found) if what == "gap" else (archive, offset, None, *[found[n] for n in names[3:]]))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in rows], t) for k, t in enumerate(kinds)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run


def with_revisits(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to, digest): which page each record revisits, null for responses.

    Of payloads that are equal and have ``least`` bytes the one with the largest id is
    the response. Rows without an id are responses and are never referred to; rows that
    repeat the largest id are all responses. Other columns of ``pages`` are not looked at.
    """
    html_ = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), html_.alias("html"), F.sha1(html_.cast("binary")).alias("digest"))
    large = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    copies = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("many")).where("many > 1").select("digest", "last")
    revisits = cut_lineage(large.select("page_id", "digest").join(copies, "digest").where("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to")).distinct())
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to", "digest")


def write(records: DataFrame, folder: str, *, packed: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; the list (archive, bytes, records) of those that count, stored."""
    bounded_batches(records.sparkSession)
    return cut_lineage(records.mapInArrow(_writer(folder, packed, archive_bytes), "archive string, bytes bigint, records bigint"))


def read(archives: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """Every record and every gap of the listed archives; ``gap_bytes`` is null for records."""
    spark = archives.sparkSession
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = "archive string, offset bigint, gap_bytes bigint, page_id bigint, record_type string, payload_digest string, refers_to bigint, payload_bytes bigint, url string" + ", payload binary" * payloads
    return archives.select("archive").repartition(wide).mapInArrow(_reader(folder, payloads), kinds)


def round_trip(pages: DataFrame, *, packed: bool = True) -> DataFrame:
    """One row per page: what the archives say about it after writing and reading them."""
    folder = shared_folder(pages.sparkSession, "warc")
    found = read(write(with_revisits(pages), folder, packed=packed), folder, payloads=False)
    return found.where("gap_bytes is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
