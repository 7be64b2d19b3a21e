"""Whole-text encoding as the tokenizers library does it, by chunk with a bounded memo where the tokenizer allows that.

The result is that of Tokenizer.encode(text, add_special_tokens=False): the string of a special token in a text is that
token's id. A text with such a string, and any text for a tokenizer of another kind than plain byte-level BPE, goes
through the library in one piece.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

#: Chunks remembered by each Python worker before the memo starts anew.
MEMO = 1_000_000
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Chunks start only where a token must start, as the tokenizer's own split pattern never joins white space to a character
#: before it that is not white space, nor a letter to punctuation after it: a word of Latin letters before space or
#: punctuation, the punctuation, a single line end before a letter, or white space and all up to the next.
_CHUNK = re.compile(rf"(?> ?[{_L}]+)(?=[ \n.,;:!?]|\Z)|[.,;:!?]+(?=[ \n]|\Z)|\n(?=[{_L}])|[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: White space other than these three may stand next to a cut; such a text is encoded in one piece.
_ODD = re.compile("[\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Bytes that a byte-level vocabulary writes as themselves; the others follow from 256 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = {b: chr(b if b in _PLAIN else 256 + k) for k, b in enumerate(sorted(set(range(256)) - _PLAIN))} | {b: chr(b) for b in _PLAIN}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _by_chunk(made: dict) -> bool:
    """Whether a tokenizer (as its own JSON) splits texts by the byte-level pattern that chunks are cut for, and has no more steps."""
    model, split = made["model"], made["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and not any(made[k] for k in ("normalizer", "truncation", "padding")) and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)


class Encoder(dict):
    """Memo of chunk -> its ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        self.by_chunk = _by_chunk(made)
        self.added = [t["content"] for t in made["added_tokens"]]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():  # one piece of the split pattern: the model can have it at once
            written = chunk.encode().decode("latin-1").translate(_WRITTEN)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
        else:
            found = self.whole(chunk)
        self[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        if not text:
            return b""
        if not self.by_chunk or _ODD.search(text) or any(x in text for x in self.added):
            return self.whole(text)
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


@cache
def encoder(path: str) -> Encoder:
    """One for each process."""
    return Encoder(path)


@contextmanager
def no_collections() -> Iterator[None]:
    """Encoding makes many small objects and no cycles; collections would only look at them again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
