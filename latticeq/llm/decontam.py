"""Benchmark decontamination: a BM25 inverted index of test items, searched with every passage by block-max WAND.

The terms are pairs of neighbouring words: single words of common prose meet in too many items for any bound on scores to tell passages
apart. Each item has its own threshold: the least BM25 score that a passage can have which holds the parts of question and answer that
verification asks for. So the search retrieves all that can be verified. Impacts are divided by that score, which makes 1 the threshold
of every item. A passage is two blocks of words as long as the longest item, and passages advance by one block, so every item-sized span lies
whole in some passage. Passages whose terms' greatest impacts cannot reach the threshold, which are nearly all, are passed over by vector
operations; the rest run the search, and what it retrieves is verified by the overlap of question and answer.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import handing_back, stored

K1, B = 1.2, 0.75
#: Least parts of the question's and the answer's word runs that the passage must hold.
QUESTION, ANSWER = 0.6, 0.6
BLOCK = 64
#: Characters of items in one index; a larger set of items is searched index by index, so that what is broadcast stays bounded.
INDEX_CHARS = 16_000_000

_TABLE = bytes(32 if chr(i) in string.punctuation or chr(i) in string.whitespace else i for i in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation, as UTF-8."""
    return (text or "").lower().encode().translate(_TABLE).split()


def pairs(words: list[bytes]) -> list[bytes]:
    """The index's terms: neighbouring words, joined by a blank."""
    return [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def _runs(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


class Item:
    """The answer is what follows the last 'Answer:' or 'A:' at the start of a line, else the last quarter of the words, three at least. Where neither side has two words, all is the answer."""

    def __init__(self, item_id: int, text: str | None) -> None:
        self.item_id, self.words = item_id, terms(text)
        self.terms = pairs(self.words)
        lines = (text or "").split("\n")
        marked = [k for k, line in enumerate(lines) if line.lstrip().lower().startswith(("answer:", "a:"))]
        n = len(terms("\n".join(lines[: marked[-1]]))) if marked else len(self.words) - max(3, len(self.words) // 4)
        n = max(0, min(n, len(self.words)))
        if max(n, len(self.words) - n) < 2:
            n = 0
        self.question, self.answer = _runs(self.words[:n], 5), _runs(self.words[n:], 3)

    def least_score(self, weights: dict[bytes, float]) -> float:
        """No passage that holds the asked parts of question and answer has terms of less weight in all.

        A passage with a run has the pair of words at any one place of it, and a pair is there for so many runs of the side at most. So the
        cheapest pairs, by weight for each run, bound the weight from below, the last one in part; the place that gives most is taken. A pair of both
        sides counts half for each.
        """
        within = [{pair for run in side for pair in pairs(list(run))} for side in (self.question, self.answer)]
        half = within[0] & within[1]
        total = 0.0
        for side, share in ((self.question, QUESTION), (self.answer, ANSWER)):
            best = 0.0
            for k in range(max((len(run) for run in side), default=1) - 1):
                there = Counter(run[k] + b" " + run[k + 1] for run in side)
                need, weight = math.ceil(share * len(side) - 1e-9), 0.0
                for cost, pair in sorted((weights[pair] * (0.5 if pair in half else 1) / n, pair) for pair, n in there.items()):
                    weight += cost * min(need, there[pair])
                    need -= min(need, there[pair])
                best = max(best, weight)
            total += best
        return total

    def overlap(self, passage: list[bytes]) -> tuple[float, float]:
        """The parts of the question's and of the answer's runs that the passage holds; 1 for a side without words."""
        out = []
        for own, size in ((self.question, 5), (self.answer, 3)):
            size = min(size, max((len(x) for x in own), default=size))
            there = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
            out.append(len(own & there) / len(own) if own else 1.0)
        return out[0], out[1]


class Index:
    """Postings by term: item numbers in order, impacts, and the greatest impact of each block of postings."""

    def __init__(self, items: list[Item], df: dict[bytes, int], n: int, average: float, longest: int) -> None:
        self.items = [item for item in items if item.terms]
        self.block = max(16, longest)
        weights: dict[bytes, list[tuple[int, float]]] = {}
        for number, item in enumerate(self.items):
            counts = Counter(item.terms)
            norm = K1 * (1 - B + B * len(item.terms) / average)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in counts.items()}
            least = item.least_score(raw)
            item.least = least / math.fsum(raw.values())
            for t, w in raw.items():
                weights.setdefault(t, []).append((number, w / least))
        self.number = {t: k for k, t in enumerate(weights)}
        self.word = {w: k for k, w in enumerate(sorted({w for t in weights for w in t.split(b" ")}))}
        codes = np.array([self.word[a] * len(self.word) + self.word[b] for a, b in (t.split(b" ") for t in weights)], np.int64)
        self._order = np.argsort(codes)
        self._codes = codes[self._order]
        self.postings = [([i for i, _ in p], [w for _, w in p], [max(w for _, w in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)]) for p in weights.values()]
        self.most = np.array([max(blocks) for _, _, blocks in self.postings], np.float64)

    def search(self, query: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """Block-max WAND: all items with a score of at least threshold for the distinct terms of query, as (number, score)."""
        threshold -= 1e-9
        found = []
        cursors = [[self.postings[t][0][0], 0, t] for t in query]  # item, position, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead, bound = math.inf, 0.0
            for at, position, t in cursors[: pivot + 1]:  # the blocks in which the pivot would stand
                ids, _, blocks = self.postings[t]
                block = position // BLOCK
                while at < item and (block + 1) * BLOCK <= len(ids) and ids[(block + 1) * BLOCK - 1] < item:
                    block += 1
                if block < len(blocks):
                    bound += blocks[block]
                    ahead = min(ahead, ids[min((block + 1) * BLOCK, len(ids)) - 1] + 1)
            if bound >= threshold:
                if cursors[0][0] == item:
                    score = math.fsum(self.postings[t][1][position] for at, position, t in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:  # no item before the nearest end of these blocks can reach it
                target = max(item + 1, ahead if pivot + 1 == len(cursors) else min(ahead, cursors[pivot + 1][0])) if ahead < math.inf else item + 1
            kept = []
            for cursor in cursors:
                at, position, t = cursor
                ids = self.postings[t][0]
                while at < target:
                    position += 1
                    if position == len(ids):
                        break
                    at = ids[position]
                if position < len(ids):
                    kept.append([at, position, t])
            cursors = kept
        return found

    def leaks(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, float, float, float]]]:
        """For each text, the verified (item id, passage's first word, score, question and answer overlap): of each item its best passage, the first of equals. The score is a part of the item's own."""
        get = self.word.get
        split = [terms(text) for text in texts]
        lengths = np.array([len(words) for words in split])
        known = np.fromiter(chain.from_iterable(map(get, words, repeat(-1)) for words in split), np.int64, lengths.sum())
        n_blocks = -(-lengths // self.block) + 1  # one more stays empty, so passages of two texts never touch
        first_word, first_block = np.cumsum(lengths) - lengths, np.cumsum(n_blocks) - n_blocks
        doc = np.repeat(np.arange(len(split)), lengths)
        block = first_block[doc] + (np.arange(len(known)) - first_word[doc]) // self.block
        at = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0) & (doc[:-1] == doc[1:]))  # where a pair of words starts
        codes = known[at] * len(self.word) + known[at + 1]
        place = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
        hit = self._codes[place] == codes
        width = len(self.most)
        hits = np.unique(block[at[hit]] * width + self._order[place[hit]])
        sums = np.bincount(hits // width, self.most[hits % width], minlength=int(n_blocks.sum()) + 1)
        promising = np.flatnonzero(sums[:-1] + sums[1:] >= 1 - 1e-9)
        where = np.searchsorted(first_block, promising, "right") - 1
        out: list[dict[int, tuple]] = [{} for _ in split]
        for at, k in zip(promising.tolist(), where.tolist(), strict=True):
            low, high = np.searchsorted(hits, [at * width, (at + 2) * width])
            start = (at - int(first_block[k])) * self.block
            passage = None
            for number, score in self.search(sorted({int(x) for x in hits[low:high] % width})):
                if passage is None:
                    passage = split[k][start : start + 2 * self.block]
                question, answer = self.items[number].overlap(passage)
                score *= self.items[number].least
                if question >= QUESTION and answer >= ANSWER and (number not in out[k] or out[k][number][2] < score):
                    out[k][number] = (self.items[number].item_id, start, score, question, answer)
        for found in out:
            yield [found[number] for number in sorted(found)]


def indexes(items: DataFrame, chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes over (item_id, text), each of about `chars` characters at most, with statistics over all items. Null ids are left out."""
    source = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    total = source.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-total // chars) or 1
    if shards == 1:
        own = [Item(row["item_id"], row["text"]) for row in source.collect()]  # at most `chars` characters
        yield from _index(own, Counter(t for item in own for t in set(item.terms)), own)
        return

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [terms(text) for text in batch.column(1).to_pylist()]
            own = [sorted(set(pairs(words))) for words in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in split], pa.int64()), pa.array(own, pa.list_(pa.binary()))], ["item_id", "n", "terms"])

    split = stored(source.mapInArrow(words, "item_id bigint, n bigint, terms array<binary>"))
    n, average, longest = split.where("n > 1").agg(F.count("n"), F.avg(F.col("n") - 1), F.max("n")).first()
    frequencies = stored(split.select("item_id", F.explode("terms").alias("term")).groupBy("term").count())
    for shard in range(shards):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard
        own = [Item(row["item_id"], row["text"]) for row in source.where(mine).collect()]
        needed = split.where(mine).select(F.explode("terms").alias("term")).distinct()
        df = {bytes(row["term"]): row["count"] for row in frequencies.join(needed, "term", "left_semi").collect()}
        yield from _index(own, df, own, n, average, longest)


def _index(items: list[Item], df: dict[bytes, int], every: list[Item], n: int = 0, average: float = 0.0, longest: int = 0) -> Iterator[Index]:
    """Statistics are those given, or else those of every."""
    lengths = [len(item.terms) for item in every if item.terms]
    if any(item.terms for item in items):
        yield Index(items, df, n or len(lengths), average or sum(lengths) / len(lengths), longest or max(lengths) + 1)


def _slices(batch: pa.RecordBatch, texts: pa.Array, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows), texts.slice(low, rows).to_pylist()


LEAKS = "doc_id bigint, item_id bigint, start_word bigint, score double, question_overlap double, answer_overlap double"


def benchmark_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each item (item_id, text) that a document (doc_id, text) holds, with its best passage, the first of equal ones: LEAKS.

    Every passage of every text, however long, is searched. Null and empty texts hold nothing, nor is an item of fewer than two words or with
    a null id found; items of one text are found each; repeated documents give their rows each; a null doc_id stays null; empty tables give an empty
    table; other columns are left out.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], LEAKS)
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in _slices(batch, batch.column(1)):
                    rows = [(doc, *leak) for doc, leaks in zip(part.column(0).to_pylist(), shared.value.leaks(texts), strict=True) for leak in leaks]
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in LEAKS.split(", ")])

        out = out.unionByName(source.mapInArrow(handing_back(run), LEAKS))
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (text) without the rows that hold an item (item_id, text); all columns stay, nothing is shuffled.

    Null and empty texts hold nothing and stay; repeated rows stay or go alike; without items all stay; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in _slices(batch, batch.column(batch.schema.get_field_index("text"))):
                    yield part.filter(pa.array([not leaks for leaks in shared.value.leaks(texts)], pa.bool_()))

        docs = docs.mapInArrow(handing_back(run), docs.schema)
    return docs
