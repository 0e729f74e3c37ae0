"""Whole texts to token ids with the tokenizers library, word by word with a bounded memory of words."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex

# Fixed value: how the vocabulary's pre-tokenizer cuts normalised text.
_PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SLICE = 1000
_TOGETHER = 100_000
#: A mark after a letter is always a pre-token of its own at the end of a word.
_MARKS = frozenset(",.;:!?")


_ENDS = regex.compile(r"(?<=\p{L})[,.;:!?](?=[ \n]|$)")


def split_marks(text: str) -> list[str]:
    """Words between blanks and line ends, with the mark that ends a word after a letter as a word of its own."""
    return _ENDS.sub(r" \g<0>", _lowered(text)).replace("\n", " ").split(" ")


def _lowered(text: str) -> str:
    """The text in lower case where that gives the same ids, so that fewer words differ."""
    if "<|" in text or "Σ" in text:
        return text
    lower = text.lower()
    same = text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower))
    return lower if same else text


class WordEncoder:
    """Encodes texts at their blanks and line ends, where no token can cross.

    A word is encoded once while it is remembered. Two generations of at most ``remember`` words are kept;
    the older one goes when the newer is full, so memory is bounded and the result never depends on it.
    """

    def __init__(self, path: str, remember: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 2**16 else "<u4")
        ends = np.zeros(size, bool)
        for piece, i in self.library.get_vocab().items():
            ends[i] = piece.endswith("</w>")
        self.ends = ends
        self.remember = remember
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The ids of the text as packed unsigned integers of ``dtype``."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The packed ids of each text; new words are looked up for some texts at a time."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(_lowered(text).replace("\n", " ").split(" ") if text else [])
            size += len(waiting[-1])
            if size >= _TOGETHER:
                yield from self._join(waiting)
                waiting, size = [], 0
        yield from self._join(waiting)

    def _join(self, waiting: list[list[str]]) -> Iterator[bytes]:
        unknown = set().union(*waiting).difference(self.new)
        if unknown:
            self._learn(unknown)
        for words in waiting:
            yield b"".join(map(self.new.__getitem__, words))
        if len(self.new) > self.remember:
            self.old, self.new = self.new, {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word; nothing is remembered."""
        found: dict[str, bytes] = {}
        for k in range(0, len(words), _SLICE):
            self._encode(words[k : k + _SLICE], found)
        return [found[w] for w in words]

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, unknown: set[str]) -> None:
        known = unknown & self.old.keys()
        for w in known:
            self.new[w] = self.old[w]
        rest = unknown - known
        ended = {w for w in rest if w[-1:] in _MARKS and w[-2:-1].isalpha()}
        stems = ({w[:-1] for w in ended} | {w[-1] for w in ended} | (rest - ended)).difference(self.new)
        for w in stems & self.old.keys():
            self.new[w] = self.old[w]
        plain = list(stems.difference(self.new))
        for k in range(0, len(plain), _SLICE):
            self._encode(plain[k : k + _SLICE], self.new)
        for w in ended:
            self.new[w] = self.new[w[:-1]] + self.new[w[-1]]

    def _encode(self, words: list[str], into: dict[str, bytes]) -> None:
        """Plain words in one call, cut again where a pre-token ends; the others one by one."""
        together, counts, odd = [], [], []
        for w in words:
            if "<|" in w:
                odd.append(w)
            else:
                together.append(w)
                simple = w.isascii() and w.isalpha()
                counts.append(1 if simple else len(_PRE_TOKENS.findall(unicodedata.normalize("NFC", w).lower())))
        ids = np.array(self._ids(" ".join(together)), self.dtype)
        stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        last = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        if last[-1] == len(stops) - 1 and stops[-1] == len(ids):
            cuts, packed, wide = stops[last].tolist(), ids.tobytes(), self.dtype.itemsize
            for i, w in enumerate(together):
                into[w] = packed[cuts[i] * wide : cuts[i + 1] * wide]
        else:
            odd += together
        for w in odd:
            into[w] = np.array(self._ids(w), self.dtype).tobytes()


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, **sizes: int) -> WordEncoder:
    """One per Python worker, vocabulary and size, so that what it remembers serves later tasks too."""
    key = (path, *sizes.items())
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, **sizes)
    return _encoders[key]
