"""Terms of a text: runs of the bytes that are no separators, A to Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

# Bytes of a long text that are split at once, so that its list of terms is never whole.
SLICE_BYTES = 1 << 20


def _mapping(separators: list[tuple[int, int]]) -> bytes:
    """Each byte's replacement: a space for separators, small letters for capitals."""
    table = bytearray(range(256))
    for first, last in separators:
        table[first : last + 1] = b" " * (last + 1 - first)
    for letter in range(ord("A"), ord("Z") + 1):
        table[letter] = letter + 32
    return bytes(table)


_MARKS = [(0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
# Terms of letters, digits and all that is not ASCII; and of the same without digits.
WITH_DIGITS = _mapping([(0x00, 0x2F), *_MARKS])
LETTERS = _mapping([(0x00, 0x40), *_MARKS[1:]])


def slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """The bytes in parts of about ``size``, cut at spaces only."""
    start = 0
    while len(data) - start > size:
        end = data.find(b" ", start + size)
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def terms(text: str | None, mapping: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, one list per slice; null has none."""
    for part in slices((text or "").encode().translate(mapping)):
        yield part.split()
