"""Token ids as the tokenizers library gives them, with caches for repeated words.

A byte-level BPE with the usual word pattern never lets a token cross an isolated space, so a
text falls into chunks that encode independently. Chunks and words repeat; each distinct one is
encoded by the library's own model once per Python worker. Chunks with characters beyond the
plain Latin ranges, and texts that hold an added token, go through the library's full encoder.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import regex
from tokenizers import Tokenizer

# Fixed value: the word pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Characters on which this module's patterns and the library's surely agree.
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
ISOLATED_SPACE = re.compile("(?<! ) (?! )")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in keep}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


BYTE_TABLE = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})


def to_byte_chars(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(BYTE_TABLE)


#: Bytes, about, that the cached words of an encoder take, and its cached chunks.
CACHE_BYTES = 64_000_000
#: Bytes of a dictionary's entry besides its key and value.
ENTRY_BYTES = 110


class Cache(dict):
    """A dictionary that computes what it lacks and stops growing at ``room`` bytes. Values are bytes, or a list or tuple of numbers."""

    def __init__(self, make, room: int = CACHE_BYTES):
        super().__init__()
        self.make, self.left = make, room

    def __missing__(self, key):
        value = self.make(key)
        if self.left > 0 and len(key) < 64:
            self.left -= ENTRY_BYTES + sys.getsizeof(key) + sys.getsizeof(value) + (0 if isinstance(value, bytes) else 32 * len(value))
            self[key] = value
        return value


class ByteLevelEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str, room: int = CACHE_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.by_chunk = (
            spec["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and not pre.get("add_prefix_space")
        )
        self.words = Cache(self._word, room)
        self.chunks = Cache(self._chunk, room)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(to_byte_chars(word))]).tobytes()

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _text(self, text: str) -> bytes:
        if not (text.isascii() and text.isprintable()) and not PLAIN.fullmatch(text):
            return self._library(text)
        return b"".join(map(self.words.__getitem__, BYTE_LEVEL_WORDS.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and max(chunk) <= "ɏ":
            return self.words[" " + chunk]
        return self._text(" " + chunk)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or any(a in text for a in self.added):
            return self._library(text)
        parts = ISOLATED_SPACE.split(text) if "  " in text else text.split(" ")
        head = self._text(parts[0])
        return head + b"".join(map(self.chunks.__getitem__, parts[1:]))


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """The encoder of this Python worker for one vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]
