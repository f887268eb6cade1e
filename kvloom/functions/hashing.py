"""Hashes of the physical layout, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000
MASK = 0xFFFFFFFF
ENTRY_OVERHEAD = 13
TAGS = {"STRING": 0, "INT": 1, "DOUBLE": 2, "BOOL": 3, "JSON": 4, "SUB": 5, "TOMBSTONE": 255}


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    step = lambda acc, i: (acc.bitwiseXOR(F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, 1)), 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(MASK))
    n = F.octet_length(text)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(2166136261).cast("long"), step)


def mix32(x: Column) -> Column:
    """Two rounds of xor-shift and multiplication, modulo 2**32."""
    for _ in range(2):
        x = (F.shiftrightunsigned(x, 16).bitwiseXOR(x) * F.lit(0x45D9F3B)).bitwiseAND(F.lit(MASK))
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x)


def fingerprint(h: Column) -> Column:
    return F.pmod(h, F.lit(255)) + 1


def bucket(h: Column, n: int = BUCKETS) -> Column:
    return F.pmod(h, F.lit(n))


def other_bucket(i: Column, fp: Column, n: int = BUCKETS) -> Column:
    return F.pmod(i.bitwiseXOR(mix32(fp)), F.lit(n))


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of a log entry."""
    return F.lit(ENTRY_OVERHEAD) + F.octet_length(key) + F.octet_length(value)


def little_endian(n: Column) -> Column:
    """A 32-bit number as four bytes, lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def tag_number(tag: Column) -> Column:
    """The byte of a type tag."""
    out = F.lit(None).cast("int")
    for name, number in TAGS.items():
        out = F.when(tag == name, F.lit(number)).otherwise(out)
    return out


def entry_crc(key: Column, value: Column, tag: Column) -> Column:
    """CRC-32 over key length, key, value length, tag and value."""
    byte = F.unhex(F.lpad(F.hex(tag_number(tag).cast("long")), 2, "0"))
    return F.crc32(F.concat(little_endian(F.octet_length(key)), F.encode(key, "UTF-8"), little_endian(F.octet_length(value)), byte, F.encode(value, "UTF-8")))
