"""Brown class-based bigrams: exchange clustering assigns words to classes; class transitions and word emissions give smoothed scores.

Counts cover every training text and stay distributed, by 64-bit hashes of words. Tables of a fixed size reach the driver, the counts of at
most KNOWN frequent words, the bigram counts of UNITS units, and the classes of the words seen LEAST_SEEN times, of the CLASSED most frequent ones at
most. A unit is one of the most frequent words, or all other words of one group of endings; exchange moves units between
classes. Then every other one of these words goes to the class that its own neighbours make likeliest, the classes being fixed;
the counts of (word, neighbouring class) stay distributed. Rarer and unknown words have the class of their ending. Transitions
between classes are smoothed by Witten-Bell with the class frequencies. Within a class, words are discounted absolutely, and what is taken
off is the probability of an unknown word. A text's score splits into a part that the tables give on the spot and the emissions of its
rarer words, whose counts come from a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, chunks, crc_bucket, mixed, stored

WORDS, ENDINGS = 1000, 256
UNITS = WORDS + ENDINGS + 1
END = UNITS - 1
CLASSES = 64
#: A word seen so often is clustered by its own neighbours, however many such words there are.
LEAST_SEEN = 20
#: Frequent words whose counts are broadcast at most; those of all other words are joined.
KNOWN = 500_000
#: Words whose classes are gathered and broadcast at most, the most frequent ones, some 12 bytes each; all other words have the class of their ending.
CLASSED = 2_000_000
PASSES = 12
#: The hash of the end token, which no word is given.
END_HASH = -1


class Units:
    """Hashes and units of the words of texts. frequent: sorted hashes of the words that are units of their own."""

    def __init__(self, frequent: np.ndarray, numbers: np.ndarray) -> None:
        self._hasher, self._frequent, self._numbers = WordHasher(), frequent, numbers

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each run of texts: the hashes of all tokens, their units, and where each text ends; every text ends with the end token."""
        data = [(text or "").encode().lower() for text in texts]
        for i, j in chunks(data):
            part = data[i:j]
            joined = b" ".join(part)
            starts, ends, hashes = self._hasher.spans(joined)
            words = hashes.view(np.int64)
            words[words == END_HASH] = 0
            codes = np.frombuffer(joined + b"\0", np.uint8)
            tail = np.zeros(len(starts), np.uint64)
            for k in range(1, 4):
                at = ends - k
                tail = tail * np.uint64(256) + np.where(at >= starts, codes[at], 0).astype(np.uint64)
            units = (mixed(tail) % np.uint64(ENDINGS)).astype(np.int64) + WORDS
            if len(self._frequent) and len(words):
                at = np.minimum(np.searchsorted(self._frequent, words), len(self._frequent) - 1)
                hit = self._frequent[at] == words
                units[hit] = self._numbers[at[hit]]
            cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in part]))
            yield np.insert(words, cuts, END_HASH), np.insert(units, cuts, END), cuts + np.arange(1, len(part) + 1)


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(keys, return_counts=True)
    return values, counts.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, ending and n of every distinct token of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            hashes, endings = [], []
            for own, unit, _ in units.tokens(batch.column(0).to_pylist()):
                hashes.append(own)
                endings.append(unit)
            if not hashes:
                continue
            values, first, counts = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.concatenate(endings)[first].astype(np.int32)), pa.array(counts.astype(np.int64))], ["hash", "ending", "n"])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "hash bigint, ending int, n bigint")
    return partial.groupBy("hash").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def unit_bigrams(docs: DataFrame, frequent: np.ndarray, numbers: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """The matrix of how often a unit, or with classes a class, follows another, texts starting after an end token. Its size does not depend on the corpus."""
    size, end = (UNITS, END) if classes is None else (CLASSES, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(frequent, numbers)
        for batch in batches:
            own = (own if classes is None else classes[own] for _, own, _ in units.tokens(batch.column(0).to_pylist()))
            pairs = [np.append(end, x[:-1]) * size + x for x in own]
            if pairs:
                values, counts = _tallied(np.concatenate(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["pair", "n"])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pair bigint, n bigint")
    found = partial.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)
    matrix[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return matrix.reshape(size, size)


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _values(grid: np.ndarray, right: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray, itself: float, n_right: float, n_left: float) -> np.ndarray:
    """For each class, what a unit adds to the likelihood there; a, b: its successors and predecessors by class. grid, right and left leave it out."""
    base = _gain(grid)
    rows = (_gain(grid + a) - base).sum(1)
    columns = (_gain(grid + b[:, None]) - base).sum(0)
    diagonal = grid.diagonal()
    corner = _gain(diagonal + a + b + itself) - _gain(diagonal + a) - _gain(diagonal + b) + base.diagonal()
    value = rows + columns + corner - _gain(right + n_right) + _gain(right) - _gain(left + n_left) + _gain(left)
    value[0] = -np.inf
    return value


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """A class for each unit; the last unit, the end token, is alone in class 0. Each pass moves every unit to the class that most raises the likelihood of the bigrams."""
    n = len(bigrams)
    total = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-total, kind="stable")
    order = order[order != n - 1]
    own = np.zeros(n, np.int64)
    own[order] = np.arange(len(order)) % (classes - 1) + 1
    member = np.eye(classes)[own]
    after, before = bigrams @ member, bigrams.T @ member  # of each unit: class counts of successors and predecessors
    grid = member.T @ after
    rights, lefts = bigrams.sum(1), bigrams.sum(0)
    right, left = member.T @ rights, member.T @ lefts
    for _ in range(passes):
        moved = 0
        for w in order:
            if not total[w]:
                continue
            k, itself = own[w], bigrams[w, w]
            a, b = after[w].copy(), before[w].copy()
            a[k] -= itself
            b[k] -= itself
            grid[k] -= a
            grid[:, k] -= b
            grid[k, k] -= itself
            right[k] -= rights[w]
            left[k] -= lefts[w]
            value = _values(grid, right, left, a, b, itself, rights[w], lefts[w])
            best = int(value.argmax())
            if value[best] <= value[k] + 1e-9:
                best = int(k)
            grid[best] += a
            grid[:, best] += b
            grid[best, best] += itself
            right[best] += rights[w]
            left[best] += lefts[w]
            if best != k:
                moved += 1
                own[w] = best
                after[:, k] -= bigrams[:, w]
                after[:, best] += bigrams[:, w]
                before[:, k] -= bigrams[w]
                before[:, best] += bigrams[w]
        if not moved:
            break
    return own


def likeliest(grid: np.ndarray, after: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """For each word, the class in use, but for the end token's, under which its neighbours are likeliest, the classes' counts being fixed.

    after, before: how often classes follow and precede a word (a row each); now: the class that its own counts are part of in grid, and are taken from.
    """
    smooth = np.log(grid + 0.5)
    n = after.sum(1)
    size = np.log(np.maximum(grid.sum(1), 1)) + np.log(np.maximum(grid.sum(0), 1))
    value = after @ smooth.T + before @ smooth - n[:, None] * size
    rows, columns = np.maximum(grid[now] - after, 0), np.maximum(grid[:, now].T - before, 0)
    without = np.log(np.maximum(rows.sum(1), 1)) + np.log(np.maximum(columns.sum(1), 1))
    value[np.arange(len(now)), now] = (after * np.log(rows + 0.5)).sum(1) + (before * np.log(columns + 0.5)).sum(1) - n * without
    unused = grid.sum(1) == 0
    unused[0] = True
    value[:, unused] = -np.inf
    best = value.argmax(1)
    return np.where(np.isfinite(value.max(1)), best, now)


def later_classes(docs: DataFrame, frequent: np.ndarray, numbers: np.ndarray, classes: np.ndarray, grid: np.ndarray, later: np.ndarray, now: np.ndarray) -> np.ndarray:
    """A class for each word of later (sorted hashes), which now counts in class `now`: of those in use, the one that its neighbours make likeliest."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, numbers, classes, grid, later, now))
    width = 2 * CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, numbers, classes, _, later, _ = shared.value
        units = Units(frequent, numbers)
        for batch in batches:
            found = []
            for hashes, own, _ in units.tokens(batch.column(0).to_pylist()):
                kinds = classes[own]
                at = np.minimum(np.searchsorted(later, hashes), len(later) - 1)
                rows = np.flatnonzero(later[at] == hashes)  # never the last token, an end
                found += [at[rows] * width + kinds[rows + 1], at[rows] * width + CLASSES + np.append(0, kinds[:-1])[rows]]
            if found:
                values, counts = _tallied(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["pair", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, grid, _, now = shared.value
        for batch in batches:
            words = batch.column(0).to_numpy()
            both = np.zeros((len(words), width))
            at = np.repeat(np.arange(len(words)), batch.column(1).value_lengths().to_numpy())
            both[at, batch.column(1).flatten().to_numpy() % width] = batch.column(2).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(likeliest(grid, both[:, :CLASSES], both[:, CLASSES:], now[words]), pa.int32())], ["word", "class"])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "pair bigint, n bigint")
    tallied = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    words = tallied.groupBy(F.floor(F.col("pair") / width).alias("word")).agg(F.collect_list(F.struct("pair", "n")).alias("x"))  # 2 * CLASSES values at most
    found = words.select("word", F.col("x.pair").alias("pairs"), F.col("x.n").alias("counts")).mapInArrow(choose, "word bigint, class int").toArrow()
    out = now.copy()
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return out


class Model:
    """Tables of units and classes, log transitions, class sizes, and the counts of frequent words."""

    def __init__(self, frequent, numbers, classes, transitions, tokens, types, discount, known, counts, total, distinct) -> None:
        self.frequent, self.numbers, self.classes, self.transitions = frequent, numbers, classes, transitions
        self.tokens, self.types, self.discount = tokens, types, discount
        self.known, self.counts, self.total, self.distinct = known, counts, total, distinct

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's share in its class: discounted if it is known, all that was taken off if it is not."""
        size = np.maximum(self.tokens[classes], 1)
        lost = np.where(self.tokens[classes] > 0, self.discount * self.types[classes], 1)
        taken = np.where(classes == 0, 0, self.discount)
        return np.log10(np.where(counts > 0, np.maximum(counts - taken, 1e-300), lost) / size)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _least_scale(sizes: dict, room: int) -> int | None:
    """The least scale of counts such that no more than `room` words have it or a greater one; None if the greatest scale has more."""
    least = None
    for s in sorted(sizes, reverse=True):
        room -= sizes[s]["k"]
        if room < 0:
            break
        least = s
    return least


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """A model of the texts of training (text), and the table of all counts (hash, n)."""
    counts = stored(word_counts(training))
    scale = F.floor(F.log2("n") * 16).cast("int")
    sizes = {row["s"]: row for row in counts.groupBy(scale.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}  # some hundred rows
    least = _least_scale(sizes, KNOWN)
    top = counts.where(scale >= least).select("hash", "n").toArrow() if least is not None else None  # KNOWN rows at most
    known = top.column("hash").to_numpy() if top is not None else np.zeros(0, np.int64)
    often = top.column("n").to_numpy() if top is not None else np.zeros(0, np.int64)
    order = np.argsort(known)
    known, often = known[order], often[order]
    ranked = [k for k in np.lexsort((known, -often)).tolist() if known[k] != END_HASH][:WORDS]
    chosen = np.array(sorted(ranked), np.int64)
    frequent, numbers = known[chosen], np.arange(len(chosen))
    bigrams = unit_bigrams(training, frequent, numbers)
    classes = exchange(bigrams)
    member = np.eye(CLASSES)[classes]
    grid = member.T @ bigrams @ member
    classed = _least_scale(sizes, CLASSED)
    often_seen = counts.where((F.col("n") >= LEAST_SEEN) & (F.col("hash") != END_HASH) & (scale >= F.lit(classed))).select("hash", "ending").toArrow()  # CLASSED rows at most
    later, endings = often_seen.column("hash").to_numpy(), often_seen.column("ending").to_numpy()
    rest = np.flatnonzero(~np.isin(later, frequent))
    rest = rest[np.argsort(later[rest])]
    if len(rest):
        later, now = later[rest], classes[endings[rest]]
        own = later_classes(training, frequent, numbers, classes, grid, later, now)
        frequent, numbers = np.append(frequent, later), np.append(numbers, UNITS + own).astype(np.int32)  # a unit for each class behind the others
        order = np.argsort(frequent)
        frequent, numbers, classes = frequent[order], numbers[order], np.append(classes, np.arange(CLASSES))
        grid = unit_bigrams(training, frequent, numbers, classes)
    single = (grid.sum(0) + 0.5) / (grid.sum() + 0.5 * CLASSES)
    kinds = np.maximum((grid > 0).sum(1), 1)
    transitions = np.log10((grid + kinds[:, None] * single) / (grid.sum(1) + kinds)[:, None])

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            own = _classes(hashes, batch.column(1).to_numpy().astype(np.int64), frequent, numbers, classes)
            sums = [np.bincount(own, w, CLASSES) for w in (n, np.ones(len(n)), n == 1, n == 2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *(pa.array(x.astype(np.int64)) for x in sums)], ["class", "tokens", "types", "once", "twice"])

    found = counts.select("hash", "ending", "n").mapInArrow(by_class, "class bigint, tokens bigint, types bigint, once bigint, twice bigint")
    rows = found.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tokens", "types", "once", "twice"))).collect()  # CLASSES rows
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in rows:
        tokens[row["class"]], types[row["class"]] = row["tokens"], row["types"]
    once, twice = sum(row["once"] for row in rows), sum(row["twice"] for row in rows)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    return Model(frequent, numbers, classes, transitions, tokens, types, discount, known, often, float(tokens.sum()), float(types.sum())), counts.select("hash", "n")


def _classes(hashes: np.ndarray, endings: np.ndarray, frequent: np.ndarray, numbers: np.ndarray, classes: np.ndarray) -> np.ndarray:
    units = endings.copy()
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hit = frequent[at] == hashes
        units[hit] = numbers[at[hit]]
    return classes[units]


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text), learnt from those where training holds.

    A null text is empty: its only token is the end. Without training texts, every token is unknown, and both scores are 0 for the
    base and the transitions' alone for the model. Texts of any length are scored whole. Repeated rows are counted and scored each; words of equal counts are taken
    in the order of their hashes; null ids stay null; an empty table gives an empty table; other columns are left out.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, counts = fit(docs.where(training))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        units = Units(model.frequent, model.numbers)
        names = ["doc_id", "n_tokens", "n_known", "base", "score", "rare", "packed"]
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                columns: list[list] = [[] for _ in range(6)]
                for hashes, own, cuts in units.tokens(part.column(1).to_pylist()):
                    classes = model.classes[own]
                    steps = model.transitions[np.append(0, classes[:-1]), classes]
                    at = np.minimum(np.searchsorted(model.known, hashes), max(0, len(model.known) - 1))
                    hit = model.known[at] == hashes if len(model.known) else np.zeros(len(hashes), bool)
                    n = model.counts[at[hit]] if hit.any() else np.zeros(0, np.int64)
                    base, score = np.zeros(len(hashes)), steps.copy()
                    base[hit] = model.base(n)
                    score[hit] += model.emission(n, classes[hit])
                    starts = np.append(0, cuts[:-1])
                    columns[0] += (cuts - starts).tolist()
                    columns[1] += np.add.reduceat(hit.astype(np.int64), starts).tolist()
                    columns[2] += np.add.reduceat(base, starts).tolist()
                    columns[3] += np.add.reduceat(score, starts).tolist()
                    rare = np.flatnonzero(~hit)
                    ends = np.searchsorted(rare, cuts)
                    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                        mine = rare[a:b]
                        values, first, times = np.unique(hashes[mine], return_index=True, return_counts=True)
                        columns[4].append(values)
                        columns[5].append(classes[mine[first]] << 40 | times)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, packed array<bigint>"
    local = stored(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = local.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "packed")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.packed").alias("packed"))
    looked = rare.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    times, kind = F.col("packed").bitwiseAND((1 << 40) - 1), F.shiftright("packed", 40).cast("int")
    tables = [F.array(*(F.lit(float(x)) for x in values)) for values in (np.maximum(model.tokens, 1), np.where(model.tokens > 0, model.discount * model.types, 1.0))]
    size, lost = F.get(tables[0], kind), F.get(tables[1], kind)
    emission = F.log10(F.when(F.col("n") > 0, F.col("n") - F.lit(float(model.discount))).otherwise(lost) / size)
    base = F.log10((F.col("n") + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    sums = looked.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, times).otherwise(0)).alias("more"), F.sum(times * base).alias("more_base"), F.sum(times * emission).alias("more_score"))
    joined = local.drop("rare", "packed").join(sums, "row", "left")
    add = lambda a, b, zero: F.col(a) + F.coalesce(F.col(b), F.lit(zero))
    return joined.select("doc_id", "n_tokens", add("n_known", "more", 0).alias("n_known"), F.lit(int(model.total)).cast("bigint").alias("train_tokens"), add("base", "more_base", 0.0).alias("base_score"), add("score", "more_score", 0.0).alias("score"))


def in_training(folds: int = 5, held_out: int = 1) -> Column:
    """Rows whose crc32(doc_id as text) modulo folds is not held_out; a null id is in training."""
    return F.coalesce(crc_bucket("doc_id", folds) != held_out, F.lit(True))
