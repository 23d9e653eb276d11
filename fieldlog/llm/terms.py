"""Terms of texts as bytes, for operators that count them: UTF-8 keeps every byte of other characters above 7F, so one table of 256 bytes lower-cases A-Z and
turns whatever is no part of a term into spaces, and splitting is all that is left."""

from __future__ import annotations

from collections.abc import Iterator

LETTERS, DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
#: Bytes that are split at once; a longer text is cut at a space, so that its terms don't all stand in memory.
PIECE = 1 << 20


def byte_table(kept: bytes) -> bytes:
    """For bytes.translate: the kept bytes and those above 7F stay, A-Z become small, others are spaces."""
    same = {*kept, *range(128, 256)}
    return bytes(b if b in same else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_terms(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size (a single longer term is a list of its own)."""
    plain, at = text.translate(table), 0
    while at < len(plain):
        end = at + piece
        if end < len(plain):
            space = plain.rfind(b" ", at, end)
            end = space if space > at else plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end
