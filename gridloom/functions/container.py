"""The product container: a header, a directory of components with checksums, and their bytes."""

from __future__ import annotations

import hashlib
import zlib

from . import entropy
from .layouts import Layout, anything, exactly, finite, positive, within

#: Fixed values of the format: coders and kinds of components by number, and the unit of the heights.
CODERS = {"cubic-order0": 0, "cubic-ctx": 1, "learned": 2, "foreign": 16}
KINDS = {"coarse": 1, "params": 2, "stream": 3, "raw": 4, "model": 5, "context": 6, "mask": 7, "rule": 8, "foreign": 20, "base": 21, "residual": 22, "corrections": 23, "coefficients": 24}
UNIT = 0.001
#: Which probability tables a stream was written with.
TABLES = hashlib.sha256(entropy.FREQ.astype("<i4").tobytes() + bytes([entropy.PROB_BITS, entropy.PER_OCTAVE])).digest()[:8]
HEAD = Layout(
    magic=("4s", exactly(b"GNC1")), version=("H", exactly(1)), flags=("H", within(0, 1)), rows=("I", within(2, 16385)), cols=("I", within(2, 16385)), unit=("d", positive), half=("I", anything),
    west=("d", finite), north=("d", finite), spacing=("d", finite), epsg_h=("I", anything), epsg_v=("I", anything), node=("B", exactly(1)), coder=("B", lambda k: k in CODERS.values()),
    foreign=("8s", anything), model=("32s", anything), tables=("8s", anything), count=("B", anything),
)
ENTRY = Layout(kind=("B", lambda k: k in KINDS.values()), length=("I", anything), crc32=("I", anything))


#: What a header holds where a product has none of it.
BLANK = {"foreign": b"", "model": bytes(32), "flags": 0, "unit": UNIT}


class Writer:
    """Puts a product together, component by component, and knows at any time what each has taken."""

    def __init__(self, coder: str, **header):
        self.header = BLANK | header | {"magic": b"GNC1", "version": 1, "node": 1, "tables": TABLES, "coder": CODERS[coder]}
        self.body: list[tuple[bytes, bytes]] = []
        self.taken = {"container": HEAD.struct.size}

    def put(self, kind: str, data: bytes) -> None:
        self.body.append((ENTRY.pack(kind=KINDS[kind], length=len(data), crc32=zlib.crc32(data)), data))
        self.taken["container"] += ENTRY.struct.size
        self.taken[kind] = self.taken.get(kind, 0) + len(data)

    def done(self) -> bytes:
        directory, data = (b"".join(x) for x in zip(*self.body, strict=True)) if self.body else (b"", b"")
        return HEAD.pack(**self.header, count=len(self.body)) + directory + data


def opened(blob: bytes) -> tuple[dict, list[tuple[str, bytes]]]:
    """The header and the components in order; ValueError for another format or version, other tables,
    cut or damaged components, and bytes left over."""
    header, rest = HEAD.unpack(blob)
    if header["coder"] != CODERS["foreign"] and (header["unit"], header["tables"]) != (UNIT, TABLES):
        raise ValueError("written in another unit or with other tables")
    entries, body = ENTRY.rows(rest, header["count"])
    names = {n: k for k, n in KINDS.items()}
    parts = []
    for e in entries:
        own, body = body[: e["length"]], body[e["length"] :]
        if len(own) < e["length"] or zlib.crc32(own) != e["crc32"]:
            raise ValueError(f"component {names[e['kind']]} is cut or damaged")
        parts.append((names[e["kind"]], own))
    if body:
        raise ValueError("bytes left over")
    return header, parts
