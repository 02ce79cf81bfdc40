"""Binary scalars: varints, checksums, keys, attributes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reversed Castagnoli polynomial; a fixed value.
CASTAGNOLI = 0x82F63B78


def crc_table(polynomial: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(polynomial), out >> 1)
    return out


_TABLE = [int(x) for x in crc_table(CASTAGNOLI)]


def crc32c_bytes(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of binary values; Spark's crc32 is of another polynomial. Null stays null."""
    return data.map(crc32c_bytes, na_action="ignore").astype("Int64")


def zigzag(n: Column) -> Column:
    """Small numbers of either sign to small ones without."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("long")))


def encode_varint(n: int) -> bytes:
    """Zigzag, then seven bits a byte, lowest first."""
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def decode_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` and the place behind it."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return (n >> 1) ^ -(n & 1), at


def big_endian(data: Column, position: int, size: int) -> Column:
    """An unsigned number of ``size`` (at most 7) bytes of a binary column; position from 0."""
    return F.conv(F.hex(F.substring(data, position + 1, size)), 16, 10).cast("long")


def has_attribute(attributes: Column, bit: int) -> Column:
    return F.shiftright(attributes, bit).bitwiseAND(F.lit(1)) == 1


def codec_name(attributes: Column) -> Column:
    """The codec of attribute bits 0 to 2; null where unknown."""
    return F.try_element_at(F.array(*map(F.lit, ("none", "gzip", "snappy", "lz4", "zstd"))), (attributes.bitwiseAND(F.lit(7)) + 1).cast("int"))


def pad20(n: Column) -> Column:
    return F.lpad(n.cast("string"), 20, "0")


def object_key(prefix: Column, topic: Column, topic_id: Column, part: Column, offset: Column) -> Column:
    """prefix/topic-<32 hex>/partition/<20 digits>.obj"""
    return F.concat(prefix, F.lit("/"), topic, F.lit("-"), topic_id, F.lit("/"), part.cast("string"), F.lit("/"), pad20(offset), F.lit(".obj"))


def key_offset(path: Column) -> Column:
    """The base offset of an object key; null where it isn't one."""
    return F.nullif(F.regexp_extract(path, r"/(\d{20})\.obj$", 1), F.lit("")).cast("long")
