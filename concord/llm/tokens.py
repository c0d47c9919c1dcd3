"""Token ids of texts by a public tokenizer, with a bounded memory of words already encoded."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import public_tokenizers

from concord.llm.common import held

#: Words that one Python worker remembers.
CACHE = 600_000

#: A run of Latin letters before white space or a stop, else all up to white space.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[ \t\n\r.,;:!?|]|\Z)|[^ \t\n\r]+")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: If a tokenizer's model gives for these what the whole tokenizer gives, it gets letters directly.
_PROBES = ["The", "reading", "ÉCOLE", "straße", "à", "ùÿñ", "Qxzzyvkj"]


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character by which byte-level tokenizers write each byte: itself if it is visible, else the next from 256 on."""
    visible = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    hidden = iter(range(256, 512))
    return [chr(b if seen else next(hidden)) for b, seen in enumerate(visible)]


def encoder(path: str, special_as_text: bool = False) -> Callable[[str | None], bytes]:
    """Function from a text to its ids as little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space and keep letters apart from stops: a text's ids are then
    those of its words in order, and each different word is encoded once. special_as_text reads
    the strings of special tokens as ordinary text. A worker keeps the words between its tasks.
    """
    return held(("tokens", path, special_as_text), lambda: _encoder(path, special_as_text))


def _encoder(path: str, special_as_text: bool) -> Callable[[str | None], bytes]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    model, written = tokenizer.model, byte_characters()

    def whole(word: str) -> list[int]:
        return tokenizer.encode(word, add_special_tokens=False).ids

    def letters(word: str) -> list[int]:
        low = word.lower()
        return [t.id for t in model.tokenize(low if low.isascii() else "".join([written[b] for b in low.encode()]))]

    direct = all(whole(w) == letters(w) for w in _PROBES)

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            ids = np.array(letters(word) if direct and _LETTERS.fullmatch(word) else whole(word), "<u4").tobytes()
            if len(self) < CACHE:
                self[word] = ids
            return ids

    known = Words()
    return lambda text: b"".join(map(known.__getitem__, _WORD.findall(text or "")))
