"""UTF-8 byte arithmetic on columns and on Python strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(c: Column) -> Column:
    return F.octet_length(c)


def byte_slice(c: Column, start: Column, end: Column) -> Column:
    """Text of the bytes [start, end)."""
    return F.decode(F.substring(F.encode(c, "UTF-8"), start + 1, end - start), "UTF-8")


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def trim_column(c: Column, most: int) -> Column:
    """Longest prefix of at most ``most`` bytes that ends between characters.

    A prefix of that many bytes is cut back to where the next byte does not
    continue a character; a character has at most three continuation bytes.
    """
    raw = F.encode(c, "UTF-8")
    byte_at = lambda at: F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")
    cut = F.lit(0)
    for back in (3, 2, 1, 0):  # the nearest boundary wins, so it is tested last-written, first
        at = most - back
        if at >= 0:
            cut = F.when(byte_at(F.lit(at)).bitwiseAND(0xC0) != 0x80, F.lit(at)).otherwise(cut)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def trim(text: str, most: int) -> str:
    raw = text.encode()
    if len(raw) <= most:
        return text
    while most and raw[most] & 0xC0 == 0x80:
        most -= 1
    return raw[:most].decode()
