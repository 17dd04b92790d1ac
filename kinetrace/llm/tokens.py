"""Token ids of whole texts by the tokenizers library, with the ids of frequent pieces kept per worker.

A byte-level tokenizer cuts a text into pieces by a pattern and merges each piece on its own, so a piece that comes
again is looked up. The pattern runs here over texts whose characters are settled in every version of the Unicode
tables; other texts are cut in front of single spaces between two non-space characters, where the pattern always cuts,
and what holds other characters goes to the library. Texts that hold a special token's string are encoded as a whole.
"""

from __future__ import annotations

import re
import unicodedata

#: Pieces kept per worker in each of two generations: about 25 MB each. Pieces still in use move to the younger one.
KEEP = 200_000
#: Longer pieces are encoded each time.
LONGEST = 64
#: A piece is kept when it comes a second time; first times are marked in so many slots.
MARKS = 1 << 20
#: Classes of the characters below this code point are the same in every version of the Unicode tables.
SETTLED = 0x530


def _class(kind: str) -> str:
    """Body of a character class: the settled characters of a general category."""
    return "".join(re.escape(chr(i)) for i in range(SETTLED) if unicodedata.category(chr(i))[0] == kind)


class _Store(dict):
    """Ids of pieces as bytes, of those that came twice, in bounded memory."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old, self.seen = encode, {}, bytearray(MARKS)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
            slot = hash(piece) % MARKS
            if not self.seen[slot]:
                self.seen[slot] = 1
                return ids
        if len(piece) <= LONGEST:
            if len(self) >= KEEP:
                self.old, self.seen = dict(self), bytearray(MARKS)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``encoder(text)``: the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        layout = json.loads(tokenizer.to_str())
        self.special = [x["content"] for x in layout["added_tokens"]]
        self.tokenizer, self.model = tokenizer, tokenizer.model
        plain = layout["normalizer"] is None and layout["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.letters = _alphabet()
        self.space, self.raw = self.letters[32], [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.foreign = re.compile(f"[^\0-{chr(SETTLED - 1)}]").search if plain and layout["model"]["type"] == "BPE" else lambda text: True
        letter, number, space = _class("L"), _class("N"), "\t-\r \x85\xa0"
        self.cut = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall  # the byte-level pattern
        self.piece, self.chunk = _Store(self.merge).__getitem__, _Store(self.whole).__getitem__

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, piece: str) -> bytes:
        """Merges alone, for what the cutting pattern leaves in one piece."""
        mapped = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(mapped)])

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if not self.foreign(text):
            return b"".join(map(self.piece, self.cut(text)))
        first, *rest = self.split(text)
        out = []
        for chunk in (first, *(" " + c for c in rest)):
            if self.foreign(chunk):
                out.append(self.chunk(chunk))
            else:
                out += map(self.piece, self.cut(chunk))
        return b"".join(out)


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
