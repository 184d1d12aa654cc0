"""Words of whole texts as bytes, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator


def separating(*ranges: tuple[int, int]) -> bytes:
    """A table for bytes.translate: A-Z are lower-cased, then every byte of the ranges (ends included) becomes a space."""
    lower = bytes(range(256)).lower()
    return bytes(0x20 if any(a <= c <= z for a, z in ranges) else c for c in lower)


def word_blocks(data: bytes, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists that come from about ``size`` bytes each, so that a very long text never is all words at once."""
    at = 0
    while at < len(data):
        take = size
        piece = data[at : at + take].translate(table)
        while at + take < len(data) and b" " not in piece:
            take *= 2
            piece = data[at : at + take].translate(table)
        if at + take < len(data):
            piece = piece[: piece.rindex(b" ") + 1]
        at += len(piece)
        yield piece.split()
