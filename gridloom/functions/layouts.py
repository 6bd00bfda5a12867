"""Binary headers as tables of fields: what a field may hold is stated once, for writing and for reading."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable


def exactly(value: object) -> Callable:
    return lambda x: x == value


def within(low: int, high: int) -> Callable:
    return lambda x: low <= x <= high


def below(end: int) -> Callable:
    return lambda x: 0 <= x < end


def finite(x: float) -> bool:
    return math.isfinite(x)


def positive(x: float) -> bool:
    return math.isfinite(x) and x > 0


def anything(x: object) -> bool:
    return True


class Layout:
    """Fields in order, little-endian: name=(type, test)."""

    def __init__(self, **fields: tuple[str, Callable]):
        self.tests = {name: test for name, (_, test) in fields.items()}
        self.struct = struct.Struct("<" + "".join(kind for kind, _ in fields.values()))

    def checked(self, values: dict) -> dict:
        wrong = [name for name, test in self.tests.items() if not test(values[name])]
        if wrong:
            raise ValueError(f"not allowed: {', '.join(f'{name} = {values[name]!r}' for name in wrong)}")
        return values

    def pack(self, **values) -> bytes:
        held = self.checked(values)
        return self.struct.pack(*(held[name] for name in self.tests))

    def unpack(self, raw: bytes) -> tuple[dict, bytes]:
        """The fields and what follows them."""
        if len(raw) < self.struct.size:
            raise ValueError("shorter than its header")
        values = dict(zip(self.tests, self.struct.unpack_from(raw), strict=True))
        return self.checked(values), raw[self.struct.size :]

    def rows(self, raw: bytes, count: int) -> tuple[list[dict], bytes]:
        """`count` records in a row and what follows them."""
        if len(raw) < count * self.struct.size:
            raise ValueError("fewer records than stated")
        end = count * self.struct.size
        return [self.checked(dict(zip(self.tests, r, strict=True))) for r in self.struct.iter_unpack(raw[:end])], raw[end:]


def unzipped(packed: bytes, most: int) -> bytes:
    """One whole gzip member of at most `most` bytes, packed and unpacked, and nothing behind it."""
    member = zlib.decompressobj(31)
    try:
        raw = member.decompress(packed, most + 1) if len(packed) <= most else b""
    except zlib.error as e:
        raise ValueError("no gzip member") from e
    if len(raw) > most or not member.eof or member.unused_data:
        raise ValueError("cut, too long, or followed by more")
    return raw
