"""Canonical identities: JSON bytes, digests and typed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in alphabetical order and nulls kept; for strings, integers, booleans and arrays of them.

    Floating-point fields must not enter an identity (their text differs between writers). Nested structs must be
    built with :func:`ordered_struct`.
    """
    return F.to_json(ordered_struct(**fields), {"ignoreNullFields": "false"})


def ordered_struct(**fields: Column) -> Column:
    """A struct whose fields are in alphabetical order, as canonical JSON needs at every level."""
    return F.struct(*(fields[k].alias(k) for k in sorted(fields)))


def digest(text: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(text, 256)


def typed_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """``prefix`` and the first ``length`` hexadecimal digits of the SHA-256 of the parts joined by '|'; nulls count as ''."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(digest(joined), 1, length))


def short_hash(text: Column) -> Column:
    """CRC-32 as eight hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.crc32(text))), 8, "0")
