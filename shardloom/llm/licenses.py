"""License scans: winnowed templates pick candidates, banded alignment reports them.

Templates (a bounded list, given as a parameter) are cut into words; the least
hash of every window of word grams goes into an inverted index. A text's grams
are looked up in it; meetings on nearby diagonals make a candidate, whose
region of the text is aligned with the template in a band around its diagonal.
A match reports the share of the template's words that are aligned to equal
words, and its span in the text. One pass over the texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shardloom.llm.common import name_package

GRAM = 3
#: Grams in a window of which the least hash is kept; spans of GRAM + WINDOW - 1 words are always met.
WINDOW = 4
#: Half width of the alignment band, in words; more for long templates.
BAND = 8
#: Share of a template's words that must be aligned. Templates of SHORT words or fewer must stand whole and unbroken.
COVERAGE = 0.8
SHORT = 12
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Match(NamedTuple):
    license: str
    start: int
    end: int
    matched: int
    coverage: float


class Index:
    """Words, winnowed fingerprints and places of all templates."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.gram, self.names = gram, list(templates)
        self.vocabulary: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for text in templates.values():
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _WORD.findall(text.lower())]
            self.words.append(np.array(ids, dtype=np.int64))
        for t, ids in enumerate(self.words):
            h = self.grams(ids)
            # short templates keep every gram; of equal least hashes the rightmost is kept
            at = range(len(h)) if len(h) < window else sorted({i + window - 1 - int(h[i : i + window][::-1].argmin()) for i in range(len(h) - window + 1)})
            for i in at:
                self.places[int(h[i])].append((t, i))
        self.hashes = np.array(sorted(self.places), dtype=np.uint64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.gram):
            h = (h ^ ids[k : k + n].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched, start, end) of the longest common subsequence of words within the band.

    ``diagonal``: place in the text less place in the template. Ties: the
    alignment that starts last, so that spans are short.
    """
    width = 2 * band + 1
    score = np.zeros((len(template) + 1, width + 1), dtype=np.int32)
    # row i: cell j stands for text place i + diagonal + j - band; first[i, j]: where its alignment starts
    first = np.full((len(template) + 1, width + 1), -1, dtype=np.int64)
    last = np.full((len(template) + 1, width + 1), -1, dtype=np.int64)
    for i in range(1, len(template) + 1):
        for j in range(width):
            at = i - 1 + diagonal + j - band
            best = (score[i - 1, j + 1], first[i - 1, j + 1], last[i - 1, j + 1])  # template word left out
            if j and (score[i, j - 1], first[i, j - 1]) > best[:2]:  # text word left out
                best = (score[i, j - 1], first[i, j - 1], last[i, j - 1])
            if 0 <= at < len(text) and text[at] == template[i - 1]:
                s = score[i - 1, j]
                here = (s + 1, first[i - 1, j] if s else at, at)
                if here[:2] > best[:2]:
                    best = here
            score[i, j], first[i, j], last[i, j] = best
    j = max(range(width), key=lambda j: (score[-1, j], first[-1, j]))
    return int(score[-1, j]), int(first[-1, j]), int(last[-1, j]) + 1


def scan(text: str | None, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[Match]:
    """Matches in order of their start; spans are word numbers of the whole text, end exclusive.

    Of matches of one template that overlap only the best stays (ties: the
    first); different templates may overlap.
    """
    if not text:
        return []
    found_words = _WORD.findall(text.lower())
    ids = np.fromiter(map(index.vocabulary.get, found_words, repeat(0)), dtype=np.int64, count=len(found_words))
    known = np.nonzero(ids)[0]
    if len(known) < index.gram:
        return []
    h = index.grams(ids)
    hit = np.nonzero(np.isin(h, index.hashes))[0]
    meetings: dict[int, set[int]] = defaultdict(set)
    for p in hit.tolist():
        for t, i in index.places[int(h[p])]:
            meetings[t].add(p - i)
    out: list[Match] = []
    for t, diagonals in meetings.items():
        own, found = index.words[t], []
        need = len(own) if len(own) <= SHORT else int(np.ceil(coverage * len(own)))
        wide = 0 if len(own) <= SHORT else band + len(own) // 20
        group: list[int] = []
        for d in [*sorted(diagonals), None]:
            if group and (d is None or d - group[0] > wide):
                middle = (group[0] + group[-1]) // 2
                matched, start, end = align(ids, own, middle, wide)
                if matched >= need:
                    found.append(Match(index.names[t], start, end, matched, matched / len(own)))
                group = []
            if d is not None:
                group.append(d)
        found.sort(key=lambda m: (-m.matched, m.start))
        kept: list[Match] = []
        for m in found:
            if all(m.end <= k.start or m.start >= k.end for k in kept):
                kept.append(m)
        out += kept
    return sorted(out, key=lambda m: (m.start, m.end, m.license))


def license_matches(docs: DataFrame, templates: dict[str, str], coverage: float = COVERAGE, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: id, license, word_start, word_end, matched, coverage.

    Null and empty texts, texts without a match and an empty table have no
    rows; repeated rows are answered each; other columns are not read. The
    templates must be few enough for every task to hold (they are sent along).
    """

    name_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for r, t in enumerate(b.column(1)):
                for m in scan(t.as_py(), index, coverage, band):
                    for col, v in zip(rows, (r, *m), strict=True):
                        col.append(v)
            ids = b.column(0).take(pa.array(rows[0], pa.int64()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(rows[1:], kinds, strict=True))], names=[id_col, "license", "word_start", "word_end", "matched", "coverage"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, license string, word_start long, word_end long, matched long, coverage double")
