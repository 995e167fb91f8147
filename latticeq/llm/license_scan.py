"""Licence scans by patience alignment of texts with the wording of notices.

Words that are unique both in a stretch of text and in a notice anchor the alignment; the longest increasing subsequence of the anchors is
kept, and the gaps between anchors are aligned in the same way, down to gaps without common unique words, of which common beginnings and ends
are taken. Coverage is the part of the notice's words that are aligned. Stretches to align are found by runs of three words of a notice
anywhere in the text, so whole texts are scanned, in time that grows with their length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import terms
from .license_texts import NOTICES

LEAST_COVERAGE = 0.8
RUN = 3


def patience_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of a and b, increasing in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, n = gaps.pop()
        while i < j and k < n and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            found.append((j, n))
        if i == j or k == n:
            continue
        one, other = Counter(a[i:j]), Counter(b[k:n])
        place = {word: at for at, word in enumerate(b[k:n], k) if other[word] == 1}
        anchors = [(at, place[word]) for at, word in enumerate(a[i:j], i) if one[word] == 1 and word in place]
        last = (i, k)
        for at, to in _increasing(anchors):
            found.append((at, to))
            gaps.append((last[0], at, last[1], to))
            last = (at + 1, to + 1)
        if last != (i, k):
            gaps.append((last[0], j, last[1], n))
    return sorted(found)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence that increases in the second place, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, to) in enumerate(pairs):
        pile = bisect_left(tops, to)
        tops[pile : pile + 1] = [to]
        piles[pile : pile + 1] = [k]
        before.append(piles[pile - 1] if pile else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


@dataclass(frozen=True)
class Notice:
    license_id: str
    keys: frozenset
    words: list

    @classmethod
    def of(cls, license_id: str, keys: str, text: str) -> Notice:
        return cls(license_id, frozenset(terms(keys)), terms(text))


class Scanner:
    """Finds notices in texts."""

    def __init__(self, notices: list[tuple[str, str, str]], least: float = LEAST_COVERAGE) -> None:
        self.notices, self.least = [Notice.of(*x) for x in notices], least
        self.word = {w: k for k, w in enumerate(sorted({w for x in self.notices for w in x.words}))}
        self._of_run: dict[int, list[int]] = {}
        self._offsets: dict[tuple[int, int], list[int]] = {}  # where a notice has a run
        for number, notice in enumerate(self.notices):
            ids = [self.word[w] for w in notice.words]
            for i in range(len(ids) - RUN + 1):
                offsets = self._offsets.setdefault((number, self._code(*ids[i : i + RUN])), [])
                offsets.append(i)
                if len(offsets) == 1:
                    self._of_run.setdefault(self._code(*ids[i : i + RUN]), []).append(number)
        self._codes = np.array(sorted(self._of_run), np.int64)

    def _code(self, a: int, b: int, c: int) -> int:
        return (a * len(self.word) + b) * len(self.word) + c

    def scan(self, texts: list[str | None]) -> Iterator[list[tuple[str, int, int, float]]]:
        """For each text, (identifier, first word, end, coverage) of the notices in it; of overlapping ones, the one that aligns most words stays."""
        split = [terms(text) for text in texts]
        lengths = np.array([len(words) for words in split], np.int64)
        ids = np.fromiter(chain.from_iterable(map(self.word.get, words, repeat(-1)) for words in split), np.int64, lengths.sum())
        doc = np.repeat(np.arange(len(split)), lengths)
        hits: list[list[tuple[int, int]]] = [[] for _ in split]
        if len(ids) >= RUN and len(self._codes):
            ok = (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0) & (doc[:-2] == doc[2:])
            at = np.flatnonzero(ok)
            codes = self._code(ids[at], ids[at + 1], ids[at + 2])
            place = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
            first = np.cumsum(lengths) - lengths
            for k, code in zip(at[self._codes[place] == codes].tolist(), codes[self._codes[place] == codes].tolist(), strict=True):
                hits[doc[k]].append((k - int(first[doc[k]]), code))
        for words, own in zip(split, hits, strict=True):
            yield self._notices(words, own) if own else []

    def _notices(self, words: list[bytes], hits: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
        by_notice: dict[int, list[tuple[int, int]]] = {}
        for at, code in hits:
            for number in self._of_run[code]:
                by_notice.setdefault(number, []).append((at, code))
        found = []
        for number, own in by_notice.items():
            notice = self.notices[number]
            size = len(notice.words)
            for low, high in self._windows(number, own, len(words)):
                pairs = patience_pairs(words[low:high], notice.words)
                aligned = {notice.words[to] for _, to in pairs}
                if len(pairs) >= self.least * size and notice.keys <= aligned:
                    found.append((len(pairs), len(pairs) / size, low + pairs[0][0], low + pairs[-1][0] + 1, notice.license_id))
        out: list[tuple[int, int, str, float]] = []  # accepted spans in order: they do not overlap, so only neighbours can meet a new one
        for _, coverage, low, high, license_id in sorted(found, key=lambda x: (-x[0], -x[1], x[3] - x[2], x[2], x[4])):
            at = bisect_left(out, (low,))
            if (at == 0 or out[at - 1][1] <= low) and (at == len(out) or high <= out[at][0]):
                out.insert(at, (low, high, license_id, coverage))
        return [(license_id, low, high, coverage) for low, high, license_id, coverage in out]

    def _windows(self, number: int, hits: list[tuple[int, int]], n_words: int) -> set[tuple[int, int]]:
        """What of a text to align with a notice: stretches of hits with some room around, and the places where single copies must lie.

        A stretch may hold adjacent copies, in which no word is unique. So each hit also tells where its copy begins, from where the notice
        has that run, and most of a copy agree; beginnings within a quarter of the notice are one copy, edited, and its window is as long as the notice and they need.
        """
        size, places = len(self.notices[number].words), [at for at, _ in hits]
        room = size // 2 + size // 4  # half a notice without a run, and what was put in
        out = set()
        start = 0
        for k in range(1, len(places) + 1):  # stretches of hits no further apart than half a notice
            if k < len(places) and places[k] - places[k - 1] <= RUN + size // 2 and places[k] - places[start] <= size + size // 2:
                continue
            out.add((max(0, places[start] - room), min(n_words, places[k - 1] + RUN + room)))
            start = k
        votes = Counter(at - offset for at, code in hits for offset in self._offsets[number, code])
        begins = sorted(at for at, n in votes.items() if n >= size // 20)  # a run that a notice has twice tells a wrong beginning too, with few votes
        start = 0
        for k in range(1, len(begins) + 1):
            if k == len(begins) or begins[k] - begins[start] > size // 4:
                out.add((max(0, begins[start]), min(n_words, begins[k - 1] + size)))
                start = k
        return out


SPANS = "doc_id bigint, license_id string, start_word bigint, end_word bigint, coverage double"


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str, str]] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """A row for each notice in each row of docs (doc_id, text): SPANS, in words without punctuation.

    Null and empty texts have none; repeated rows give theirs each; a null doc_id stays null; an empty table gives an empty table; other
    columns are left out. Of overlapping notices the one that aligns most words stays; of those that align as many, the one with more coverage, then
    the shorter, then the earlier span, then the first identifier. Texts of any length are scanned whole. The notices are a fixed list, some kilobytes, and travel
    with the tasks.
    """
    wanted = NOTICES if notices is None else notices
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, least)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [(doc, *span) for doc, spans in zip(part.column(0).to_pylist(), scanner.scan(part.column(1).to_pylist()), strict=True) for span in spans]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license_id", "start_word", "end_word", "coverage"])

    return source.mapInArrow(run, SPANS)
