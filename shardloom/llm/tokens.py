"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The vocabulary's pre-tokenizer cuts a text into words before any merge, so a
word's ids don't depend on its neighbours. Texts in Latin-1 are cut here by the
same rule and each distinct word is encoded once per worker; other texts are
cut at white space, and texts that hold a special token's string are encoded
whole. Results equal ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import islice

import numpy as np

# Latin-1's letters, digits and the rest, after lower-casing, as the file's own pattern names them.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = r" \t-\r\x85\xa0"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BLANK = re.compile(r"[ \t-\r]+")
#: Words that a worker remembers at most, some 50 MB; then all but the first ``KEEP`` go, which are mostly the frequent ones.
REMEMBER = 1 << 18
KEEP = 1 << 16


class WordCache:
    """Ids (little-endian unsigned 32-bit) of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        todo = list(words)
        for i in range(0, len(todo), 512):
            part = todo[i : i + 512]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            at = np.array(e.word_ids, dtype=np.int64)
            ids = np.array(e.ids, dtype="<u4")
            if len(at) and at[-1] + 1 == len(part) and len(np.unique(at)) == len(part):
                ends = np.searchsorted(at, np.arange(len(part)), side="right").tolist()
                raw, a = ids.tobytes(), 0
                for w, b in zip(part, ends, strict=True):
                    self.known[w] = raw[4 * a : 4 * b]
                    a = b
            else:  # some are more than one word, or none
                for w, one in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                    self.known[w] = np.array(one.ids, dtype="<u4").tobytes()

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            out: list[str] = []
            for chunk in _BLANK.split(text):
                try:
                    chunk.encode("latin-1")
                except UnicodeEncodeError:
                    out.append(chunk)
                else:
                    out += _WORD.findall(chunk.lower())
            return out
        return _WORD.findall(text.lower())

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; words that are new in any of them are learned together."""
        cut = [None if any(s in t for s in self.special) else self._words(t) for t in texts]
        every = set().union(*(w for w in cut if w is not None))
        new = every.difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self.known = dict(islice(self.known.items(), KEEP))
            new = every.difference(self.known)
        self._learn(new)
        known = self.known.__getitem__
        return [self._whole(t) if w is None else b"".join(map(known, w)) for t, w in zip(texts, cut, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def grouped(texts: list[str], most: int = 1 << 17) -> list[list[str]]:
    """Runs of texts of about ``most`` characters at most together (a longer text is alone)."""
    out: list[list[str]] = []
    size = 0
    for t in texts:
        if not out or size + len(t) > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


@cache
def words(path: str) -> WordCache:
    """The worker's cache for a vocabulary file."""
    return WordCache(path)
