"""Token ids of whole texts by the tokenizers library, with a bounded memory of words in each worker.

A text is cut before each single space. With a byte-level BPE or a BPE with word ends no token spans such a cut, so the
ids of a text are those of its words in a row; a word that a worker has met already costs one look-up. A word
that the memory lacks is cut further into pre-tokens, and each new pre-token goes through the library's BPE model.
Where the cut would not be exact (runs of white space, in a byte-level model) the library gets the whole text.
"""

from __future__ import annotations

import gc
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

assert sys.byteorder == "little" and array("I").itemsize == 4
#: Bytes of words that a worker remembers (of each of up to three memories), and the longest word, in characters, that it does.
MOST_BYTES, LONGEST = 96 << 20, 64
#: The pre-token patterns that the two tokenizer files state.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_ENDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Punctuation that both patterns put in one pre-token of its own after letters; no apostrophe, which may start a contraction.
_TAIL = ".,;:!?%$#&*|)(-+/\"_=<>[]{}~@^`"
_SHOWN: dict[int, str] = {}


def _visible(text: str) -> str:
    """A text's UTF-8 bytes in the byte-level alphabet: printable Latin-1 as it is, the other bytes from U+0100 on."""
    if not _SHOWN:
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        _SHOWN.update({b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(kept)))})
    return text.encode().decode("latin-1").translate(_SHOWN)


_encoders: dict[str, WordEncoder] = {}
_COLLECT = gc.get_threshold()


def rest_collector(rest: bool) -> None:
    """Let Python's collector come less often while words are remembered: they hold no references, it would walk them in vain."""
    gc.set_threshold(*((1 << 17, 50, 100) if rest else _COLLECT))


def _odd(c: str) -> bool:
    """Whether a character may count as white space, so that a run of it might go over a cut."""
    return c.isspace() or unicodedata.category(c)[0] == "C"


class Memory(dict):
    """What `make` gives for a key, remembered in about `most_bytes`; long keys (texts without spaces, say) are not kept."""

    def __init__(self, make: Callable, most_bytes: int = MOST_BYTES):
        self.make, self.most_bytes, self.bytes = make, most_bytes, 0

    def forget(self) -> None:
        self.clear()
        self.bytes = 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            # An estimate: key and value with their headers, and the table's share.
            self.bytes += 220 + 4 * len(key)
            if self.bytes > self.most_bytes:
                self.forget()
            self[key] = value
        return value


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit integers, end ids not included."""

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.bpe = self.model.tokenize
        self.word_ends = bool(self.model.end_of_word_suffix)
        self.pattern = regex.compile(WORD_ENDS if self.word_ends else BYTE_LEVEL)
        self.tokens = Memory(self._token, most_bytes)
        self.first = Memory(lambda w: self._word(w, "", ""), most_bytes)
        self.later = self.first if self.word_ends else Memory(lambda w: self._word(w, " ", "\u0120"), most_bytes)

    def _token(self, text: str) -> bytes:
        """ids of one pre-token, in the byte-level alphabet, by the library's BPE model."""
        ids = [t.id for t in self.bpe(text)]
        return ids[0].to_bytes(4, "little") if len(ids) == 1 else array("I", ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, w: str, lead: str, shown_lead: str) -> bytes | None:
        """ids of what stands between two spaces, with the space before it; None where the cut is not exact."""
        body = w.rstrip(_TAIL)
        if body.isalpha():  # by far most words: letters, then perhaps punctuation
            shown = ""
            if body.isascii():
                shown = body.lower() if self.word_ends else shown_lead + body
            elif max(body) <= "ɏ" and "İ" not in body:  # Latin letters with accents: composed, and one pre-token too
                shown = _visible(body.lower() if self.word_ends else lead + body)
            if shown:
                if len(body) == len(w):  # remembered as a word; as a pre-token only what stands beside punctuation is
                    return self.tokens.get(shown) or self._token(shown)
                return self.tokens[shown] + self.tokens[w[len(body) :]]
        if not w:
            return b"" if self.word_ends or not lead else None
        if not self.word_ends and (_odd(w[0]) or _odd(w[-1])):
            return None
        if "<|" in w or not w.isascii() and any(c > "ɏ" or c == "İ" for c in w):
            return self._whole(w if self.word_ends else lead + w)
        parts = self.pattern.findall(unicodedata.normalize("NFC", w).lower() if self.word_ends else lead + w)
        return b"".join([self.tokens[_visible(x)] for x in parts])

    def forget(self) -> None:
        """Free what was remembered: at the end of a task, as workers are used again for other work."""
        for memory in (self.tokens, self.first, self.later):
            memory.forget()
        rest_collector(False)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; a null text has those of the empty one."""
        rest_collector(True)
        first, later = self.first.__getitem__, self.later.__getitem__
        for t in texts:
            words = (t or "").split(" ")
            try:
                yield first(words[0]) + b"".join(map(later, words[1:]))
            except TypeError:  # a cut that would not be exact
                yield self._whole(t or "")


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
