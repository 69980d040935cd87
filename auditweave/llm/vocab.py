"""Word-level memo over a public BPE vocabulary.

The tokenizer file (a parameter) describes: NFC, white space to one space, lower case per
character, pieces by a pattern, byte-level characters, BPE with an end-of-word suffix.  No piece
crosses white space, so the ids of a text are the ids of its white-space chunks in a row, and a
bounded memo of chunks answers nearly all of them.  ``ModelPieces`` leaves the merging of a new
piece to the tokenizers library.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
import unicodedata

import regex

from . import common

#: Entries a memo holds before it starts anew; bounds a worker's memory, never a result.
MEMO_ENTRIES = 300_000
#: Longer chunks are encoded each time.
MEMO_CHARS = 48
#: The end id that closes a document in a token stream.
END_ID = 1



def _ranges(*pairs: tuple[int, int]) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in pairs)


#: White space by Unicode, as the library's pattern engine has it.
_SPACES = _ranges((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Control characters, U+0130 and all from U+0300 on but dashes, quotes and the euro sign: a text
#: without these is NFC, and Python's white space and lower case are the library's.
_UNUSUAL = re.compile("[" + _ranges((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x9F), (0x130, 0x130), (0x300, 0x200F), (0x2028, 0x20AB), (0x20AD, 0x10FFFF)) + "]")
_SPLIT = re.compile("[" + _SPACES + "]+").split
_SIGNS = frozenset(",.;:!?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: printable ones as themselves, the
    rest by counting up from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """What the tokenizer file says: vocabulary, merges, pattern, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", _SPACES)).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.characters = byte_characters()

    def written(self, piece: str) -> str:
        """A piece in byte-level characters."""
        c = self.characters
        return piece if piece.isascii() and piece.isprintable() else "".join([c[b] for b in piece.encode()])


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(ids: bytes) -> array:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


class Pieces(dict):
    """Memo in two generations: chunk without white space -> its packed ids.  Subclasses merge."""

    def __init__(self, vocabulary: Vocabulary, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.vocabulary, self.entries = vocabulary, entries
        self.older: dict = {}

    def piece(self, piece: str) -> bytes:
        """Packed ids of one piece of the pattern."""
        raise NotImplementedError

    def __missing__(self, chunk: str) -> bytes:
        value = self.older.get(chunk)
        if value is None:
            if chunk.isalpha():  # letters only: one piece
                value = self.piece(chunk)
            elif chunk[-1] in _SIGNS and chunk[:-1].isalpha():
                value = self[chunk[:-1]] + self.piece_again(chunk[-1])
            else:
                value = b"".join([self.piece_again(p) for p in self.vocabulary.find(chunk)])
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def piece_again(self, piece: str) -> bytes:
        """A piece that is likely to be a chunk too: through the memo."""
        if piece.isalpha():
            return self[piece]
        value = self.get(piece) if piece in _SIGNS else None
        return self.piece(piece) if value is None else value

    def plain(self, text: str) -> list[bytes]:
        """The chunks' ids of a text without special tokens."""
        if _UNUSUAL.search(text) is None:
            return list(map(self.__getitem__, text.lower().split()))
        text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        return [self[c] for c in _SPLIT(text) if c]

    def __call__(self, text: str) -> bytes:
        if "<|" in text and self.vocabulary.cut is not None:
            out = []
            for k, part in enumerate(self.vocabulary.cut.split(text)):
                out += [packed([self.vocabulary.special[part]])] if k % 2 else self.plain(part)
        else:
            out = self.plain(text)
        return b"".join(out)


class ModelPieces(Pieces):
    """Ids as little-endian unsigned 32-bit integers; the tokenizers library merges."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__(Vocabulary(path), entries)
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize

    def piece(self, piece: str) -> bytes:
        return packed([t.id for t in self.tokenize(self.vocabulary.written(piece))])

    def plain(self, text: str) -> list[bytes]:
        if _UNUSUAL.search(text) is None:
            return list(map(self.__getitem__, text.lower().split()))
        return [packed(self.library.encode(text, add_special_tokens=False).ids)]


def ids_of(path: str, entries: int = MEMO_ENTRIES) -> ModelPieces:
    """The worker's encoder for a tokenizer file."""
    return common.remembered(f"ids of {path}, {entries}", lambda: ModelPieces(path, entries))
