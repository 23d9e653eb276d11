"""What the tokenizing operators share: texts in pieces that are encoded alone, and ids by the tokenizers library."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

#: White space of the tokenizer's pattern. str.split() also splits at 1C to 1F, which the pattern takes for symbols.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
SPECIAL = "<|"
#: Pieces that a worker remembers; then it starts anew. A piece takes about 200 bytes.
REMEMBERED = 600_000
#: Longer pieces are encoded but not remembered.
LONGEST = 64

END_ID = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_spaces(text: str) -> bool:
    """Whether the tokenizer encodes what stands between white space independently: its pattern drops white space and never
    matches across it, and no step before joins or makes any."""
    return SPECIAL not in text and not any(c in text for c in NOT_SPACE)


def plain_lower(text: str) -> str | None:
    """The text in lower case if it has Latin-1 characters only: each of them is in normal form, and so is its lower case, which
    then is what the tokenizer makes of it. Else None."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return text.lower()


def word_and_mark(piece: str) -> bool:
    """Whether the piece is letters and then one ASCII mark, which joins with nothing; its ids are those of the two parts."""
    return len(piece) > 1 and piece[-1].isascii() and not piece[-1].isalnum() and piece[:-1].isalpha()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one above 255, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Remembered(dict):
    """Pieces to what `make` gives for them; made when first asked for. Forgets all when full."""

    def __init__(self, make, most: int = REMEMBERED):
        self.make, self.most = make, most

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


class LibraryCoder:
    """Ids by the tokenizers library as little-endian 32-bit integers. Repeated pieces between white space are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.plain, self.other = Remembered(self._plain_piece), Remembered(self._encode)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _plain_piece(self, piece: str) -> bytes:
        """Of lower-case Latin-1 letters: they are one word already, so the library's model alone gives the ids."""
        if piece.isalpha():
            word = piece if piece.isascii() else "".join([self.symbols[b] for b in piece.encode()])
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if word_and_mark(piece):
            return self.plain[piece[:-1]] + self.plain[piece[-1]]
        return self._encode(piece)

    def ids(self, text: str) -> bytes:
        if not splits_at_spaces(text):
            return self._encode(text)
        if (low := plain_lower(text)) is not None:
            return b"".join(map(self.plain.__getitem__, low.split()))
        return b"".join(map(self.other.__getitem__, text.split()))


@lru_cache(maxsize=2)
def library_coder(path: str) -> LibraryCoder:
    """One a worker process, so that what it remembers serves all its tasks."""
    return LibraryCoder(path)
