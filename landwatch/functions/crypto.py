"""HMAC-SHA-256 from built-in hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA-256 of a binary or string column (RFC 2104).

    The key becomes a literal of the plan, so plans, event logs and query listings show it: keep
    those private, or use a key made for one job.
    """
    block_key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in block_key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in block_key))
    inner = F.sha2(F.concat(inner_pad, message.cast("binary")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def verify_signature(body: Column, header: Column, key: bytes) -> Column:
    """True when ``header`` is the body's HMAC; a missing header or body is False."""
    return F.coalesce(hmac_sha256_hex(body, key) == header, F.lit(False))
