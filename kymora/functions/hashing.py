"""Randomness and identity derived from row content.

A draw depends on what a row is, never on where it sits, so results do not
change with partitioning, task retries or row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4294967296.0  # 2^32


def key_text(*parts) -> Column:
    """Join parts with ``|``; strings are constants, nulls are spelled ``~``."""
    cols = [F.lit(str(p)) if not isinstance(p, Column) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts]
    return F.concat_ws("|", *cols)


def u01(*parts) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(key_text(*parts)), 1, 8), 16, 10).cast("double") / F.lit(SCALE)


def draw_index(n: Column | int, *parts) -> Column:
    """Zero-based draw below ``n``."""
    return F.floor(u01(*parts) * n).cast("int")


def micro(c: Column) -> Column:
    """A double as whole millionths: the same text in every engine."""
    return F.round(c * F.lit(1e6)).cast("bigint")


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def payload_hash(payload: dict[str, Column], exclude: tuple[str, ...] = (), length: int = 8) -> Column:
    """Fingerprint of named fields: key order is irrelevant, listed keys are left out."""
    kept = [payload[k].alias(k) for k in sorted(payload) if k not in exclude]
    return short_hash(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), length)
