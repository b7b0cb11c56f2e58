"""Token ids of whole texts from a dictionary of their space-separated chunks.

No merge of these tokenizers crosses white space, so a text's ids are those of its chunks, one after the other. A worker
process keeps the chunks it has encoded, up to a bound; it then starts anew, which costs time but changes no id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

from .common import WHITE

KEPT = 600_000  # chunks and words that a worker process holds at most
_SPACES = re.compile(f"[{WHITE}]+")
#: How the lower-case vocabulary's tokenizer cuts text into words (a fixed value of that file).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters on whose classes all Unicode versions agree, all in normal form C; other chunks go through the whole tokenizer.
_PLAIN = re.compile("[!-~¡-ɏ]+")
#: Marks of which a run is one word of that tokenizer (the apostrophe can begin another sort).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of texts under a word-level BPE file (lower case, white space dropped), as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT):
        self.whole, self.kept, self.chunks = load(path), kept, _Chunks(self._chunk)
        self.model, self.letters = self.whole.model, byte_letters()
        self.letters = {chr(b): c for b, c in self.letters.items()}
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.four = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]

    def _word(self, word: str) -> bytes:
        """Ids of one word as the tokenizer cuts it, in lower case, so that the word as a chunk has the same ids; ASCII
        characters stand for themselves in its alphabet."""
        piece = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode().decode("latin-1")))
        ids = self.chunks[word] = b"".join([self.four[t.id] for t in self.model.tokenize(piece)])
        return ids

    def _chunk(self, chunk: str) -> bytes:
        body = chunk.rstrip(_MARKS)
        word = body.lower()
        if word.isalpha() and (chunk.isascii() or _PLAIN.fullmatch(chunk)):  # most chunks: a run of letters, then marks
            known, tail = self.chunks.get, chunk[len(body) :]
            ids = known(word) or self._word(word)
            return ids + (known(tail) or self._word(tail)) if tail else ids
        if _PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.special):
            known = self.chunks.get
            return b"".join([known(w) or self._word(w) for w in _WORDS.findall(chunk.lower())])
        ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        if len(self.chunks) > self.kept:
            self.chunks.clear()
        # str.split() takes some separators for spaces that the tokenizer doesn't.
        parts = [x for x in _SPACES.split(text) if x] if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))


class _Chunks(dict):
    """Ids of chunks, found when they are first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.encode(chunk)
        return ids


class PieceIds:
    """Ids of words under a byte-level BPE file: a plain word's pieces are encoded once each, other words as a whole."""

    def __init__(self, path: str, kept: int = KEPT):
        self.whole, self.kept, self.pieces = load(path), kept, {}
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.four = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > self.kept:
            self.pieces = {}
        mapped = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode().decode("latin-1")))
        ids = self.pieces[piece] = b"".join([self.four[t.id] for t in self.whole.model.tokenize(mapped)])
        return ids

    def encode(self, word: str) -> bytes:
        known, core = self.pieces.get, word[word[:1] == " " :]
        body = core.rstrip(_MARKS)
        if body.isalpha() and (core.isascii() or _PLAIN.fullmatch(core)):  # a run of letters, then marks
            first, tail = word[: len(word) - len(core) + len(body)], core[len(body) :]
            ids = known(first) or self._piece(first)
            return ids + (known(tail) or self._piece(tail)) if tail else ids
        if _PLAIN.fullmatch(core) and not any(s in word for s in self.special):
            return b"".join([known(x) or self._piece(x) for x in self.cut(word)])
        return b"".join([self.four[i] for i in self.whole.encode(word, add_special_tokens=False).ids])


_ODD_SPACE = re.compile("[\x1c-\x1f]")


@cache
def word_ids(path: str) -> WordIds:
    """One for each worker process and file."""
    return WordIds(path)
