"""Web archives: written one compressed record at a time, and read back by byte ranges.

A record is a gzip member of its own. The reader cuts every file into ranges of `SPLIT` bytes
and gives each to a task of its own. A task looks for the gzip magic in its range; what it finds
may be chance, so a candidate counts only if it decodes to a WARC header, its checksum holds and
another member or the end of the file follows it. A record belongs to the range it starts in,
however far it reaches beyond. No range needs another, so a lost executor costs its ranges only.

Of records with equal payloads the one with the least page id is kept as a response, the others
refer to it. Copies are found by length and SHA-1, on rows without payloads until the one join that marks
them; a page copied a thousand times is split by the skew join.

Archives live in the shared folder. Each task writes under names of its own and reports
them; files of tasks that did not finish are never listed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.session import cut_lineage, ensure_checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT = 4 << 20
#: A task starts another file after so many bytes.
FILE = 128 << 20
STEP = 1 << 16
#: Fixed values of the archive format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

_MANIFEST = "path string, bytes long"
_RECORDS = (
    "record_type string, record_id string, target_uri string, refers_to string,"
    " payload_digest string, payload_bytes long, payload binary"
)


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit has no payload, but names its digest and length."""
    block = HTTP + payload if kind == "response" else b""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if uri is None else _clean(uri),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(size),
        "WARC-Refers-To": f"<{refers_to}>" if refers_to else None,
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response" if kind == "response" else None,
        "Content-Length": str(len(block)),
    }
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in head.items() if v is not None], b"", b""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + block + b"\r\n\r\n") + packer.flush()


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def page_urn(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"


def page_of(urn: Column) -> Column:
    """The page id a record id stands for; null for pages without one."""
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), size, sha1 and first: the page to which a copy refers.

    `first` is the least page id among equal payloads of at least `least_bytes` bytes, null for shorter ones.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    firsts = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"))
    return rows.join(firsts, ["sha1", "size"], "left")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write every page into archives under `folder`; the files, as path and bytes.

    Defined results: a null html is an empty payload; rows of the least page id are all responses, should they be
    repeated; a null page id is never the least (copies without any id are all responses) and gets a random record
    id; a url is written on one line, a null one not at all; other columns are not read.
    """
    rows = marked(pages, least_bytes)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        out, path, held = None, "", 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, held = store.open_output_stream(path, compression=None), 0
                first, page = row["first"], row["page_id"]
                response = first is None or first == page
                member = record(
                    "response" if response else "revisit",
                    page_urn(page),
                    row["url"],
                    row["payload"] if response else b"",
                    base32(row["sha1"]),
                    row["size"],
                    None if response else page_urn(first),
                )
                out.write(member)
                held += len(member)
                if held >= FILE:
                    out.close()
                    done.append((path, held))
                    out = None
        if out is not None:
            out.close()
            done.append((path, held))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "bytes"])

    arrow_fs_make(folder)
    return cut_lineage(rows.mapInArrow(write, _MANIFEST))


def arrow_fs_make(folder: str) -> None:
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)


class _Range:
    """Bytes of a file from `start` on, read as far as they are asked for."""

    def __init__(self, source, start: int, size: int):
        self.source, self.start, self.size = source, start, size
        self.data = bytearray()

    def upto(self, end: int) -> None:
        """Have the bytes before file position `end`, if the file has them."""
        have = self.start + len(self.data)
        end = min(end, self.size)
        if end > have:
            self.source.seek(have)
            self.data += self.source.read(max(end - have, min(STEP, self.size - have)))

    def at(self, a: int, b: int) -> bytes:
        self.upto(b)
        return bytes(self.data[a - self.start : b - self.start])


def _member(bytes_: _Range, at: int) -> tuple[bytes, int] | None:
    """The content of the member at a position and the position after it; None if there is none."""
    unpack = zlib.decompressobj(31)
    out, place = [], at
    try:
        while not unpack.eof:
            chunk = bytes_.at(place, place + STEP)
            if not chunk:
                return None
            got = unpack.decompress(chunk)
            place += len(chunk)
            if got:
                out.append(got)
                if len(out) == 1 and len(got) < 8:
                    out[0] += unpack.decompress(b"")
            begun = out[0][:7] if out else b""
            if not b"WARC/1.".startswith(begun):
                return None
    except zlib.error:
        return None
    end = place - len(unpack.unused_data)
    return (b"".join(out), end) if end == bytes_.size or bytes_.at(end, end + 3) == MAGIC else None


def records_in(source, start: int, stop: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record that starts in [start, stop)."""
    bytes_ = _Range(source, start, size)
    bytes_.upto(stop + len(MAGIC) - 1)
    place = start
    while place < stop:
        found = bytes_.data.find(MAGIC, place - start, stop + len(MAGIC) - 1 - start)
        if found < 0:
            return
        place = start + found
        member = _member(bytes_, place)
        head, _, block = member[0].partition(b"\r\n\r\n") if member else (b"", b"", b"")
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = headers.get("content-length", "")
        if member is None or not length.isdecimal() or len(block) < int(length):
            place += 1
            continue
        yield headers, block[: int(length)]
        place = member[1]


def read_archives(files: DataFrame, folder: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Every record of the files (path, bytes), each file read by ranges of `split` bytes.

    The digest and length of a response are those of the payload read; a mismatch with its header raises.
    A revisit gives what its header says. Without `payloads` the payload column is null.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = cut_lineage(ranges)
    ranges = ranges.repartition(max(1, ranges.count()), "path", "start")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = arrow_fs.FileSystem.from_uri(folder)
        schema = pa.schema(
            [(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
            + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(row["path"]) as source:
                    for headers, block in records_in(source, row["start"], min(row["start"] + split, row["bytes"]), row["bytes"]):
                        rows.append(_read(headers, block, payloads))
                        held += len(block)
                        if held > STEP * 64:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.select("path", "bytes", "start").mapInArrow(read, _RECORDS)


def _read(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = headers["warc-type"]
    digest, size, payload = headers.get("warc-payload-digest", "").removeprefix("sha1:"), headers.get("x-payload-length"), None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and own != digest:
            raise ValueError(f"{headers['warc-record-id']}: payload digest {own}, header {digest}")
        digest, size = own, len(payload)
    return {
        "record_type": kind,
        "record_id": headers["warc-record-id"].strip("<>"),
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
        "payload_digest": digest or None,
        "payload_bytes": int(size) if size is not None else None,
        "payload": payload if payloads else None,
    }


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages' archives into the shared folder and read them back, without payloads."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder, payloads=False)
