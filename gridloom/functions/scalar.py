"""Column functions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero; nulls stay."""
    return F.round(value, digits) + F.lit(0.0)


def floor_div(a: Column, b: Column | int | float) -> Column:
    """Floor division: `div` truncates, which differs below zero."""
    return F.floor(a / b).cast("bigint")


def ulp32(value: Column) -> Column:
    """The spacing of 32-bit floats at a value."""
    return F.when(value == 0, F.pow(F.lit(2.0), F.lit(-149))).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - 23))


def slope_class(slope: Column, edges: tuple[float, ...]) -> Column:
    """0 below the first edge, then one more from each edge on."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(slope >= e, 1).otherwise(0)
    return out


def zigzag(value: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def varint_bytes(value: Column) -> Column:
    """Bytes of an unsigned varint with seven bits a byte."""
    bits = F.when(value > 0, F.length(F.bin(value))).otherwise(1)
    return F.ceil(bits / 7).cast("int")


def box_gap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance between two boxes (west, south, east, north); 0 where they overlap."""
    dx = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2])
    dy = F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    return F.sqrt(dx * dx + dy * dy)
