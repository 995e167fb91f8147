"""Best-fit packing by minimum bin slack.

Documents are tokenised on the executors; only the histogram of piece lengths (at most `capacity` numbers) reaches the driver.
There, bin after bin, a bitset subset-sum over the lengths still available finds the fullest combination that holds the longest one
left; as long as the counts allow the same combination again, all those bins are laid at once. The layout goes back as runs over the
rank of a piece among those of its length, so placing a piece is a lookup by (length, rank). Ranks are taken within (length, salt),
with offsets from counts, so that one common length is not one task.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored, worker_cache

CAPACITY = 2048
END_ID = 0
#: Words kept by a worker's cache of token ids; beyond that it starts anew. Bounds memory, not results.
CACHE_WORDS = 800_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit, from a cache of the ids of lower-case words.

    Exact for tokenizers that drop white space, lower-case letter by letter and split runs of letters from other characters, which
    word_bpe_49k does: a blank between a letter or digit and a mark changes nothing there, so marks are set apart first. Texts with an
    added token, or with characters that Python splits or lower-cases otherwise, are encoded whole.
    """

    #: A full stop or comma after something else than a letter, a digit or white space may belong to a longer token.
    _RUN = re.compile("[^a-z0-9\\sÀ-ÖØ-öø-ɏ][.,]")
    _MARK = re.compile(r"(?<=[^\W\d_])(?=[^\w\s])")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        ids = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(ids.values()) + 1, bool)
        self._ends[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self._whole = ["\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ", *(token.content for token in self._tokenizer.get_added_tokens_decoder().values())]
        self._words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str] | None:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if any(x in text for x in self._whole):
            return None
        text = text.lower()
        if self._RUN.search(text):
            return self._MARK.sub(" ", text).split()
        return text.replace(".", " .").replace(",", " ,").split()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        split = [self._split(text) for text in texts]
        if len(self._words) > CACHE_WORDS:
            self._words.clear()
        known = self._words
        self._learn({word for words in split if words for word in words if word not in known})
        for text, words in zip(texts, split, strict=True):
            yield self.whole(text) if words is None else b"".join(map(known.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        letters = [word for word in words if word.isalpha()]
        for i in range(0, len(letters), 4000):  # each run of letters is one pre-token, so it ends where a word-end token stands
            part = letters[i : i + 4000]
            ids = np.array(self._tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(part):
                self._words.update((word, self.whole(word)) for word in part)
                continue
            data = ids.tobytes()
            self._words.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        self._words.update((word, self.whole(word)) for word in words.difference(letters))


def tokenizer(path: str) -> WordTokenizer:
    """One per worker and path."""
    return worker_cache(("tokenizer", path), lambda: WordTokenizer(path))


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece of a document: place, length and crc32 of its ids, and the ids if asked for. Null text is empty."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(ids), 256):
                rows: list[list] = [[] for _ in range(6)]
                part = [text or "" for text in texts.slice(low, 256).to_pylist()]
                for doc, data in zip(ids[low : low + 256], encoder.batch(part), strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        for column, value in zip(rows, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                            column.append(value)
                arrays = [pa.array(column, kind) for column, kind in zip(rows, types, strict=False)]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [*names, *["ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that holds the longest length left: {length: how often}. Among equals, longer lengths first."""
    longest = max(counts)
    room = capacity - longest
    taken = {longest: 1}
    if not room:
        return taken
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        times = 1
        while left > 0:  # binary parts of the count
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= reach << (length * times) & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + times
            total -= length * times
    return taken


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many alike, {length: how often in each}) that use up the counts."""
    left = {length: n for length, n in counts.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a length must be from 1 to the capacity")
    bins = []
    while left:
        one = fullest(left, capacity)
        alike = min(left[length] // times for length, times in one.items())
        bins.append((alike, one))
        for length, times in one.items():
            left[length] -= alike * times
            if not left[length]:
                del left[length]
    return bins


def _runs(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, per bin, first offset), sorted by length and rank."""
    rows, used, first = [], {}, 0
    for alike, one in bins:
        offset = 0
        for length in sorted(one, reverse=True):
            rows.append((length, used.get(length, 0), first, one[length], offset))
            used[length] = used.get(length, 0) + alike * one[length]
            offset += length * one[length]
        first += alike
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. Equal rows are told apart by their rank alone."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_width(spark))))
    cells = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {row["length"]: row["n"] for row in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs = _runs(minimum_bin_slack(histogram, capacity))
    before = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1).drop("_salt", "_before")
    names = pieces.columns
    shared = spark.sparkContext.broadcast(runs)  # bounded by the number of different lengths, whatever the number of documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "_rank"))
            own = runs[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            n = rank - own[:, 1]
            arrays = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(own[:, 2] + n // own[:, 3]), pa.array(own[:, 4] + n % own[:, 3] * length)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack every document (doc_id, text) into sequences of at most `capacity` tokens, as few as minimum bin slack finds.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for. Only documents longer
    than a sequence are cut. A null or empty text gives the end id alone; a null doc_id stays null; repeated rows are packed each;
    an empty table gives an empty table; other columns are left out, whatever their names.
    """
    return place(stored(tokenized_pieces(docs, path, capacity, end_id, with_ids)), capacity)
