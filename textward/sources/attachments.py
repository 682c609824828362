"""Attachments, inline or as files: decoding, declared against detected type, limits, archives, extracted text."""

from __future__ import annotations

import io
import zipfile
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import case_map

# Types with a built-in extractor and their leading bytes.
MAGIC = {
    "image/png": "^89504E470D0A1A0A",
    "image/jpeg": "^FFD8FF",
    "image/gif": "^47494638(?:37|39)61",
    "image/webp": "^52494646.{8}57454250",
    "application/pdf": "^255044462D",
    "application/zip": "^504B.{4}",
}
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ARCHIVES = ("application/zip", DOCX)


@dataclass(frozen=True)
class AttachmentLimits:
    max_encoded_bytes: int = 8 << 20
    max_decoded_bytes: int = 4 << 20
    max_text_bytes: int = 1 << 20
    max_pages: int = 200
    max_entries: int = 1024
    max_expansion: int = 100
    allowed: tuple[str, ...] = (
        "text/plain",
        "application/json",
        "application/pdf",
        "image/png",
        "image/jpeg",
        "image/gif",
        "image/webp",
        "application/zip",
    )


def normal_mime(value: Column) -> Column:
    return F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))


# ---- archives ------------------------------------------------------------------------------------------

STEP = 64 << 10
#: Archives inside archives that are opened; deeper ones count as expansion without end.
NESTED = 3
INVALID, EXPANDS = "ATTACHMENT_ARCHIVE_INVALID", "ATTACHMENT_EXPANSION_LIMIT_EXCEEDED"


class _Over(Exception):
    """The archive would expand beyond its limits."""


def _inflated(raw: memoryview, method: int, most: int) -> bytes:
    """An entry's content, read in steps; stops as soon as it is larger than `most`."""
    if method == zipfile.ZIP_STORED:
        if len(raw) > most:
            raise _Over
        return bytes(raw)
    if method != zipfile.ZIP_DEFLATED:
        raise zipfile.BadZipFile("method")
    inflate, out, size, left = zlib.decompressobj(-15), [], 0, bytes(raw)
    while True:
        piece = inflate.decompress(left, STEP)
        size += len(piece)
        if size > most:
            raise _Over
        out.append(piece)
        left = inflate.unconsumed_tail
        if inflate.eof or not (piece or left):
            return b"".join(out)


def _expand(blob: bytes, limits: AttachmentLimits, budget: int, entries: int, depth: int) -> tuple[int, int]:
    """Bytes and entries an archive expands to, nested ones included; raises beyond the budget.

    The central directory is read first, so an honest bomb costs nothing. Then every entry is inflated in
    bounded steps: one that holds more than it declares is a bomb too.
    """
    archive = zipfile.ZipFile(io.BytesIO(blob))
    listed = archive.infolist()
    entries += len(listed)
    if entries > limits.max_entries or sum(e.file_size for e in listed) > budget:
        raise _Over
    view, used = memoryview(blob), 0
    for entry in listed:
        if entry.flag_bits & 1:
            raise zipfile.BadZipFile("encrypted")
        at = entry.header_offset
        if bytes(view[at : at + 4]) != b"PK\x03\x04":
            raise zipfile.BadZipFile("entry")
        begin = at + 30 + int.from_bytes(view[at + 26 : at + 28], "little") + int.from_bytes(view[at + 28 : at + 30], "little")
        content = _inflated(view[begin : begin + entry.compress_size], entry.compress_type, min(entry.file_size, budget - used))
        if len(content) != entry.file_size:
            raise zipfile.BadZipFile("size")
        used += len(content)
        if content[:4] == b"PK\x03\x04":
            if depth == NESTED:
                raise _Over
            inner, entries = _expand(content, limits, budget - used, entries, depth + 1)
            used += inner
    return used, entries


def archive_code(blob: bytes, limits: AttachmentLimits) -> str | None:
    """Why an archive is refused, or None. An encrypted one cannot be inspected, so it is invalid."""
    try:
        size, _ = _expand(blob, limits, limits.max_decoded_bytes, 0, 0)
    except _Over:
        return EXPANDS
    except (zipfile.BadZipFile, zlib.error, ValueError, OSError, NotImplementedError):
        return INVALID
    return EXPANDS if size // max(len(blob), 1) > limits.max_expansion else None


def _archive_code(limits: AttachmentLimits):
    def check(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else archive_code(bytes(b), limits) for b in blobs], dtype="object")

    return F.pandas_udf(check, "string")


#: File endings and the types they declare.
ENDINGS = {
    "txt": "text/plain", "json": "application/json", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "zip": "application/zip", "docx": DOCX,
}


def read_files(spark: SparkSession, path: str, limits: AttachmentLimits = AttachmentLimits(), glob: str = "*") -> DataFrame:
    """Files below a folder as attachments (`path`, `data`, `declared`, `size`); content over the limit is not kept.

    Spark's source leaves out files without content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    small = F.when(F.col("length") <= limits.max_decoded_bytes, F.col("content"))
    return files.select("path", small.alias("data"), case_map(ending, ENDINGS).alias("declared"), F.col("length").alias("size"))


def scan_files(files: DataFrame, limits: AttachmentLimits = AttachmentLimits()) -> DataFrame:
    """Attachments given as bytes (`data`, `declared`, `size`), judged as inline ones are."""
    rows = files.withColumns({"found": F.lit(""), "given": normal_mime(F.coalesce("declared", F.lit("")))})
    large = F.when(F.col("size") > limits.max_decoded_bytes, "ATTACHMENT_DECODED_BYTES_EXCEEDED")
    return _judged(rows, large, [c for c in files.columns if c not in ("data", "declared")], limits, True)


def scan_attachments(
    rows: DataFrame, limits: AttachmentLimits = AttachmentLimits(), archives: bool = True
) -> DataFrame:
    """Attachment rows (`raw`, `declared`) with a reject code or type, pages, hash and text.

    Only archive rows send their bytes to Python; `archives=False` leaves that step out.
    """
    raw = F.col("raw")
    is_url = F.lower(F.left(raw, F.lit(5))) == "data:"
    comma = F.instr(raw, ",")
    header = F.substr(raw, F.lit(6), comma - 6)
    payload = F.when(is_url, F.substr(raw, comma + 1)).otherwise(raw)
    payload = F.translate(payload, "\r\n", "")
    url_bad = is_url & ((comma == 0) | ~F.lower(header).rlike("(?:^|;)base64(?:;|$)"))
    safe = ~(payload.rlike("[-_]") & payload.rlike("[+/]"))
    data = F.when(
        safe & ((F.length(payload) % 4 == 0) | ~F.contains(payload, F.lit("="))),
        F.try_to_binary(F.translate(payload, "-_", "+/"), F.lit("base64")),
    )
    out = rows.withColumn("data", F.when(~url_bad & (F.length("raw") <= limits.max_encoded_bytes), data))
    found = F.when(is_url, normal_mime(header)).otherwise("")
    given = normal_mime(F.coalesce("declared", F.lit("")))
    out = out.withColumn("found", found).withColumn("given", given)
    early = F.when(F.length("raw") > limits.max_encoded_bytes, "ATTACHMENT_ENCODED_BYTES_EXCEEDED").when(
        url_bad | F.col("data").isNull(), "ATTACHMENT_BASE64_INVALID"
    )
    return _judged(out, early, [c for c in rows.columns if c not in ("raw", "declared")], limits, archives)


def _judged(out: DataFrame, early: Column, keep: list[str], limits: AttachmentLimits, archives: bool) -> DataFrame:
    """`keep` columns with code, type, pages, hash and text of rows with `data`, `found` and `given` types."""
    mime = F.when(F.col("found") != "", F.col("found")).otherwise(F.col("given"))
    out = out.withColumn("mime", mime)
    text = F.try_validate_utf8(F.col("data").cast("string"))
    head = F.hex(F.substring("data", 1, 16))
    magic = F.when(F.col("mime") == "text/plain", text.isNotNull()).when(
        F.col("mime") == "application/json", F.try_parse_json(text).isNotNull()
    )
    for name, pattern in MAGIC.items():
        names = [name, DOCX] if name == "application/zip" else [name]
        magic = magic.when(F.col("mime").isin(*names), head.rlike(pattern))
    magic = F.coalesce(magic.otherwise(False), F.lit(False))
    out = out.withColumn("body", F.when(F.col("mime").isin("text/plain", "application/json"), text))
    latin = F.decode("data", "iso-8859-1")
    counted = (F.length(latin) - F.length(F.replace(latin, F.lit("/Type /Page"), F.lit("")))) / 11
    pages = F.when(F.col("mime") == "application/pdf", F.greatest(counted.cast("int"), F.lit(1))).otherwise(0)
    out = out.withColumn("pages", pages)
    archive = F.lit(None).cast("string")
    if archives:
        archive = _archive_code(limits)(F.when(F.col("mime").isin(*ARCHIVES) & magic, F.col("data")))
    code = (
        F.when(early.isNotNull(), early)
        .when(F.octet_length("data") > limits.max_decoded_bytes, "ATTACHMENT_DECODED_BYTES_EXCEEDED")
        .when((F.col("given") != "") & (F.col("found") != "") & (F.col("given") != F.col("found")), "ATTACHMENT_MIME_MISMATCH")
        .when(~F.col("mime").isin(*limits.allowed), "ATTACHMENT_MIME_NOT_ALLOWED")
        .when(~magic, "ATTACHMENT_MIME_MISMATCH")
        .when(archive.isNotNull(), archive)
        .when(F.col("pages") > limits.max_pages, "ATTACHMENT_PAGE_LIMIT_EXCEEDED")
        .when(F.octet_length("body") > limits.max_text_bytes, "ATTACHMENT_TEXT_BYTES_EXCEEDED")
        .otherwise("")
    )
    out = out.withColumn("code", code)
    ok = F.col("code") == ""
    return out.select(
        *keep,
        "code",
        F.when(ok, F.col("mime")).otherwise("").alias("mime"),
        F.when(ok, F.col("pages")).otherwise(0).alias("pages"),
        F.when(ok, F.left(F.sha2("data", 256), F.lit(16))).otherwise("").alias("hash"),
        F.when(ok, F.coalesce("body", F.lit(""))).otherwise("").alias("text"),
    )
