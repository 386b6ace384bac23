"""Bit tricks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing_zeros(column: Column, bits: int = 32) -> Column:
    """Trailing zero bits of the lowest ``bits`` - 1 bits, at most ``bits`` - 1; so 0 gives ``bits`` - 1."""
    low = column.cast("long").bitwiseAND(F.lit((1 << (bits - 1)) - 1))
    return F.when(low == 0, F.lit(bits - 1)).otherwise(F.bit_count(low.bitwiseAND(-low) - 1)).cast("int")


def trailing_zeros_int(column: Column) -> Column:
    """Trailing zero bits of an int, 0 to 32."""
    low = column.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low == 0, F.lit(32)).otherwise(F.bit_count(low.bitwiseAND(-low) - 1)).cast("int")


def little_endian_u32(column: Column, position: Column | int) -> Column:
    """Unsigned value of 4 bytes of a binary column from a 0-based position, zero-padded past the end."""
    at = F.lit(position) if isinstance(position, int) else position
    piece = F.rpad(F.substring(column, at + 1, F.lit(4)), F.lit(4), F.lit(b"\x00"))
    return F.conv(_swapped(F.hex(piece)), 16, 10).cast("long")


def _swapped(hexed: Column) -> Column:
    return F.concat(*[F.substring(hexed, i, 2) for i in (7, 5, 3, 1)])
