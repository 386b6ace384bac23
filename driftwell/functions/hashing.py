"""MurmurHash3 (public domain, Austin Appleby): as native columns for integers, as Arrow UDFs for bytes.

Spark's ``hash`` of a long is Murmur3 x86_32 of its 8 little-endian bytes, and with several arguments
each hash seeds the next. Murmur of one int is a bijection, so for any seed there is an int literal
whose hash *is* that seed; put in front, it makes ``hash`` a seeded Murmur3 inside codegen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The constants of MurmurHash3 and Spark's seed for hash().
C1_32, C2_32, ADD_32, FMIX1_32, FMIX2_32 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
C1_64, C2_64, FMIX1_64, FMIX2_64 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
ADD1_64, ADD2_64 = 0x52DCE729, 0x38495AB5
SPARK_SEED = 42
#: Seed of the hash that certifies a cell of an invertible Bloom filter.
CHECK_SEED = 123456789

_M32 = 0xFFFFFFFF


def _rotate(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & _M32


def _unshift(x: int, r: int) -> int:
    """Inverse of x ^ (x >> r) on 32 bits."""
    y = x
    for _ in range(32 // r + 1):
        y = x ^ (y >> r)
    return y & _M32


def seed_literal(seed: int) -> int:
    """The signed int that Spark's ``hash`` maps to ``seed``: Murmur3 of one block, run backwards."""
    h = _unshift(seed & _M32, 16) * pow(FMIX2_32, -1, 1 << 32) & _M32
    h = _unshift(h, 13) * pow(FMIX1_32, -1, 1 << 32) & _M32
    h = _unshift(h, 16) ^ 4
    k = _rotate((h - ADD_32) * pow(5, -1, 1 << 32) & _M32, 32 - 13) ^ SPARK_SEED
    k = _rotate(k * pow(C2_32, -1, 1 << 32) & _M32, 32 - 15) * pow(C1_32, -1, 1 << 32) & _M32
    return k - (1 << 32) if k >> 31 else k


def murmur32(column: Column | str, seed: int) -> Column:
    """Unsigned Murmur3 x86_32 of a long (8 bytes), an int (4 bytes) or bytes of length divisible by 4."""
    col = F.col(column) if isinstance(column, str) else column
    return F.hash(F.lit(seed_literal(seed)).cast("int"), col).cast("long").bitwiseAND(F.lit(_M32))


def _fmix32(h: np.ndarray) -> np.ndarray:
    u = np.uint32
    h = (h ^ (h >> u(16))) * u(FMIX1_32)
    h = (h ^ (h >> u(13))) * u(FMIX2_32)
    return h ^ (h >> u(16))


def _fmix64(h: np.ndarray) -> np.ndarray:
    u = np.uint64
    h = (h ^ (h >> u(33))) * u(FMIX1_64)
    h = (h ^ (h >> u(33))) * u(FMIX2_64)
    return h ^ (h >> u(33))


def _rot(x: np.ndarray, r: int, bits: int) -> np.ndarray:
    t = x.dtype.type
    return (x << t(r)) | (x >> t(bits - r))


def _columns(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded rows of ``values`` (longest first) as a matrix with ``width``-byte groups, with their lengths."""
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    wide = max(-(-int(lengths.max(initial=0)) // width), 1) * width
    raw = b"".join([v.ljust(wide, b"\0") for v in values])
    return np.frombuffer(raw, dtype=np.uint8).reshape(len(values), wide), lengths


def _in_parts(values: list[bytes], limit: int = 1 << 20, least: int = 256) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """``values`` in parts of similar length, longest first, with their positions.

    The padded matrix of a part stays within ``limit`` bytes (a longer value stands alone), and a part of ``least``
    values ends where values are half as long as its longest, so that there is little padding.
    """
    order = np.argsort([-len(v) for v in values], kind="stable")
    ordered = [values[i] for i in order]
    start = 0
    for i, v in enumerate(ordered):
        longest = len(ordered[start])
        if i > start and (longest * (i + 1 - start) > limit or (2 * len(v) < longest and i - start >= least)):
            yield order[start:i], ordered[start:i]
            start = i
    if start < len(ordered):
        yield order[start:], ordered[start:]


def murmur32_bytes(values: list[bytes], seed: int = 0) -> np.ndarray:
    """Murmur3 x86_32 of byte strings, a block of all of them at a time."""
    out = np.zeros(len(values), dtype=np.uint32)
    u = np.uint32
    for order, part in _in_parts(values):
        matrix, lengths = _columns(part, 4)
        below = -lengths
        blocks = matrix.view("<u4").T
        h = np.full(len(part), seed & _M32, dtype=np.uint32)
        for j, k in enumerate(blocks):
            full = int(np.searchsorted(below, -4 * (j + 1), side="right"))  # rows with this block whole
            some = int(np.searchsorted(below, -4 * j, side="left"))  # rows with at least a byte of it
            k = _rot(k[:some] * u(C1_32), 15, 32) * u(C2_32)
            h[:some] ^= k
            h[:full] = _rot(h[:full], 13, 32) * u(5) + u(ADD_32)
        h = _fmix32(h ^ lengths.astype(np.uint32))
        out[order] = h
    return out


def murmur128_bytes(values: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of Murmur3 x64_128 of byte strings."""
    first, second = np.zeros(len(values), dtype=np.uint64), np.zeros(len(values), dtype=np.uint64)
    u = np.uint64
    for order, part in _in_parts(values):
        matrix, lengths = _columns(part, 16)
        below = -lengths
        blocks = matrix.view("<u8")
        h1 = np.full(len(part), seed, dtype=np.uint64)
        h2 = h1.copy()
        for j in range(blocks.shape[1] // 2):
            full = int(np.searchsorted(below, -16 * (j + 1), side="right"))
            some = int(np.searchsorted(below, -16 * j, side="left"))
            k1 = _rot(blocks[:some, 2 * j] * u(C1_64), 31, 64) * u(C2_64)
            k2 = _rot(blocks[:some, 2 * j + 1] * u(C2_64), 33, 64) * u(C1_64)
            h1[:some] ^= k1
            h1[:full] = (_rot(h1[:full], 27, 64) + h2[:full]) * u(5) + u(ADD1_64)
            h2[:some] ^= k2
            h2[:full] = (_rot(h2[:full], 31, 64) + h1[:full]) * u(5) + u(ADD2_64)
        h1 ^= lengths.astype(np.uint64)
        h2 ^= lengths.astype(np.uint64)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix64(h1), _fmix64(h2)
        h1 = h1 + h2
        h2 = h2 + h1
        first[order], second[order] = h1, h2
    return first, second


def _bytes(values: pd.Series) -> list[bytes]:
    return [b"" if v is None else bytes(v) for v in values]


@F.pandas_udf(T.LongType())
def murmur32_udf(values: pd.Series) -> pd.Series:
    """Unsigned Murmur3 x86_32, seed 0, of bytes of any length; null counts as empty."""
    return pd.Series(murmur32_bytes(_bytes(values)).astype(np.int64))


@F.pandas_udf(T.LongType())
def murmur_id_udf(values: pd.Series) -> pd.Series:
    """The first 8 bytes of Murmur3 x64_128, seed 0, as a signed little-endian long."""
    return pd.Series(murmur128_bytes(_bytes(values))[0].view(np.int64))


@F.pandas_udf(T.StringType())
def murmur128_hex_udf(values: pd.Series) -> pd.Series:
    """All 16 bytes of Murmur3 x64_128, seed 0, as hex in byte order."""
    a, b = murmur128_bytes(_bytes(values))
    raw = np.stack([a, b], axis=1).astype("<u8").tobytes()
    return pd.Series([raw[16 * i : 16 * i + 16].hex() for i in range(len(a))])


def utf16(column: Column) -> Column:
    return F.encode(column, "UTF-16LE")


def item_block(key: Column | str = "key", value: Column | str = "value") -> Column:
    """The bytes that identify a key-value row: key, '-' and value in UTF-16LE. ("a-b","c") and ("a","b-c") coincide.

    A null stands as the character U+0000, so that rows with null values keep ids of their own and null
    differs from empty.
    """
    k, v = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\0")) for c in (key, value))
    return utf16(F.concat(k, F.lit("-"), v))
