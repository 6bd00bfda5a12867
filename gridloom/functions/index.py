"""The compact page index: what a manifest says of each page, in 48 bytes a page.

Keys are not stored but follow from the order of the pages: from the coarsest level to the finest,
by rows. Bounds are whole multiples of the quantum, rounded so that they are never tighter than the
true ones: a reader that skips pages by them never skips one that it needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .layouts import Layout, anything, below, exactly, finite, positive, within

#: Fixed values of the format: its fields in order, and what they may hold.
HEAD = Layout(magic=("8s", exactly(b"EATIDX1\0")), version=("H", exactly(1)), sample_side=("I", anything), intervals=("H", within(1, 512)), max_level=("B", within(0, 24)), side=("H", within(2, 513)), raw_bytes=("I", anything))
SCALARS = Layout(spacing=("d", positive), quantum=("d", positive), west=("d", finite), south=("d", finite), east=("d", finite), north=("d", finite), low=("d", finite), high=("d", finite))
PAGE = Layout(sha256=("32s", anything), packed_bytes=("I", anything), low=("i", anything), high=("i", anything), error=("I", anything))
LENGTH, COUNT = Layout(n=("H", anything)), Layout(n=("I", below(1 << 31)))
TEXTS = ("error_kind", "crs", "vertical_crs", "filter", "source_kind", "content_id", "algorithm_sha256", "name")


def places(max_level: int) -> Iterator[tuple[int, int, int]]:
    """(level, x, y) of all pages of a pyramid in the order of the format."""
    for level in reversed(range(max_level + 1)):
        yield from ((level, x, y) for y, x in np.ndindex(1 << (max_level - level), 1 << (max_level - level)))


@dataclass
class PageIndex:
    """pages: (level, x, y) to a dict of sha256 (hex), packed_bytes, low, high and error in metres."""

    sample_side: int
    intervals: int
    max_level: int
    raw_bytes: int
    scalars: dict
    texts: dict
    pages: dict = field(default_factory=dict)

    def to_bytes(self) -> bytes:
        order, q = list(places(self.max_level)), self.scalars["quantum"]
        if unknown := set(self.pages) - set(order):
            raise ValueError(f"pages outside the pyramid: {sorted(unknown)[:3]}")
        there = np.array([k in self.pages for k in order], dtype=bool)
        parts = [HEAD.pack(magic=b"EATIDX1\0", version=1, sample_side=self.sample_side, intervals=self.intervals, max_level=self.max_level, side=self.intervals + 1, raw_bytes=self.raw_bytes), SCALARS.pack(**self.scalars)]
        for name in TEXTS:
            raw = self.texts[name].encode()
            parts += [LENGTH.pack(n=len(raw)), raw]
        parts += [COUNT.pack(n=len(order)), np.packbits(there, bitorder="little").tobytes()]
        for key in order:
            if p := self.pages.get(key):
                parts.append(PAGE.pack(sha256=bytes.fromhex(p["sha256"]), packed_bytes=p["packed_bytes"], low=math.floor(p["low"] / q), high=math.ceil(p["high"] / q), error=math.ceil(p["error"] / q)))
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PageIndex:
        """The index; ValueError for anything that is cut, contradicts itself or is followed by more."""
        head, rest = HEAD.unpack(blob)
        scalars, rest = SCALARS.unpack(rest)
        texts = {}
        for name in TEXTS:
            n, rest = LENGTH.unpack(rest)
            if len(rest) < n["n"]:
                raise ValueError("a text is cut")
            texts[name], rest = rest[: n["n"]].decode(), rest[n["n"] :]
        order = list(places(head["max_level"]))
        count, rest = COUNT.unpack(rest)
        if count["n"] != len(order) or head["side"] != head["intervals"] + 1 or len(rest) < -(-len(order) // 8):
            raise ValueError("the index does not fit its pyramid")
        size = -(-len(order) // 8)
        there = np.unpackbits(np.frombuffer(rest[:size], np.uint8), count=len(order), bitorder="little").astype(bool)
        rows, rest = PAGE.rows(rest[size:], int(there.sum()))
        if rest:
            raise ValueError("the index is followed by more")
        q = scalars["quantum"]
        keys = [k for k, yes in zip(order, there, strict=True) if yes]
        pages = {k: r | {"sha256": r["sha256"].hex()} | {c: r[c] * q for c in ("low", "high", "error")} for k, r in zip(keys, rows, strict=True)}
        return cls(head["sample_side"], head["intervals"], head["max_level"], head["raw_bytes"], scalars, texts, pages)

    def loosened(self) -> dict[str, float]:
        """The most that the stored bounds lie outside of the true ones; none is negative."""
        back = self.from_bytes(self.to_bytes()).pages
        gaps = [(p["low"] - back[k]["low"], back[k]["high"] - p["high"], back[k]["error"] - p["error"]) for k, p in self.pages.items()]
        worst, least = np.max(gaps, 0, initial=0.0), np.min(gaps, initial=0.0)
        return {"low": float(worst[0]), "high": float(worst[1]), "error": float(worst[2]), "never_tighter": bool(least >= -1e-9)}
