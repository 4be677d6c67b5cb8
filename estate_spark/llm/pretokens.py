"""Texts of byte-level BPE vocabularies, encoded pre-token by pre-token through bounded memos."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

from estate_spark.llm.caches import WordMemo

# The characters of Unicode's White_Space property, which the split pattern calls \s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNKS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
RARE_SPACE = re.compile(f"[{SPACES[6:]}]")
BEFORE_SPACE = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
MEMO_ROWS = 300_000  # words that follow a space; a quarter of it for what does not


class TextEncoder:
    """Packed token ids (little-endian, one width) of a text.

    The pattern never matches across "no space, then space", so a text falls
    into chunks there that can be encoded alone; a chunk falls into the
    pattern's matches, and ``encode_piece`` gives the packed ids of one match.
    Words are remembered without the space before them.
    """

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes]):
        self.find = regex.compile(pattern).findall
        self.encode_piece = encode_piece
        self.words = WordMemo(lambda word: self.encode_chunk(" " + word), MEMO_ROWS)
        self.others = WordMemo(self.encode_chunk, MEMO_ROWS // 4)

    def encode_chunk(self, chunk: str) -> bytes:
        pieces = self.find(chunk)
        if len(pieces) == 1:
            return self.encode_piece(chunk)
        return b"".join([self.words[piece[1:]] if piece[0] == " " and len(piece) > 1 else self.others[piece] for piece in pieces])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        plain = text[0] != " " and not any(pair in text for pair in BEFORE_SPACE)
        if plain and (text.isascii() or not RARE_SPACE.search(text)):
            first, *rest = text.split(" ")
            return self.others[first] + b"".join(map(self.words.__getitem__, rest))
        return b"".join(map(self.others.__getitem__, CHUNKS.findall(text)))
