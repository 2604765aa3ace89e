"""Words of letters and digits: runs of 0-9, A-Z (lower-cased), a-z and everything beyond ASCII, over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Every byte that is no part of a word becomes a space.
TABLE = bytes(b if (b := bytes([i]).lower()[0]) in _KEPT or b >= 0x80 else 0x20 for i in range(256))
#: A longer text is read in pieces of about so many bytes, so that the list of its words is never held whole.
PIECE = 1 << 20


def runs(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text of any length in order, in lists; none for a null text."""
    spaced, at = (text or b"").translate(TABLE), 0
    while len(spaced) - at > PIECE:
        to = spaced.find(b" ", at + PIECE)
        if to < 0:
            break
        yield spaced[at:to].split()
        at = to
    yield spaced[at:].split() if at else spaced.split()
