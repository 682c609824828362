"""Keyed and plain digests as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    if len(raw) > BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def _binary(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def hmac_sha256(key: str, value: Column) -> Column:
    """Hex HMAC-SHA256 of a string column under a key known to the driver."""
    inner, outer = hmac_pads(key)
    first = F.sha2(F.concat(_binary(inner), F.encode(value, "utf-8")), 256)
    return F.sha2(F.concat(_binary(outer), F.unhex(first)), 256)


def value_hash(key: str, value: Column) -> Column:
    """Correlation hash of a detected value; an empty key disables hashing."""
    if not key:
        return F.lit("")
    return F.concat(F.lit("sha256:"), hmac_sha256(key, value))


def joined_digest(*values: Column) -> Column:
    """SHA-256 over values joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[v.cast("string") for v in values]), 256)


def cohort_slot(*values: Column) -> Column:
    """Stable slot 0..99 from the first two digest bytes."""
    return F.conv(F.substring(joined_digest(*values), 1, 4), 16, 10).cast("int") % 100
