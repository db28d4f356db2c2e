"""Spans found in UTF-8 bytes by ASCII patterns, reported as code points."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

_CONTINUATION = bytes(range(0x80, 0xC0))

#: (kind, first byte, end byte)
Span = tuple[str, int, int]


def code_points(raw: bytes, spans: list[Span]) -> list[Span]:
    """The same spans, sorted by start, counted in code points."""
    if raw.isascii():
        return spans
    marks = sorted({p for _, a, b in spans for p in (a, b)})
    at, points, last = {}, 0, 0
    for p in marks:
        piece = raw[last:p]
        points += len(piece.translate(None, _CONTINUATION))
        at[p], last = points, p
    return [(k, at[a], at[b]) for k, a, b in spans]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Covered:
    """What some spans cover together, asked by binary search."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        """Whether one of them shares a byte with the span from ``a`` to ``b``."""
        at = bisect_right(self.ends, a)
        return at < len(self.starts) and self.starts[at] < b
