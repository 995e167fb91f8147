import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from latticeq.llm import class_ngram


def texts(n, seed=3):
    rng = random.Random(seed)
    tongues = [[f"{x}{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] for x in ("uno", "zwo", "tri")]
    out = []
    for _ in range(n):
        own = rng.choice(tongues)
        out.append(" ".join(own[min(rng.randrange(100), rng.randrange(100))].upper() if rng.random() < 0.1 else rng.choice(own) + ("x" * rng.randrange(0, 60) if rng.random() < 0.05 else "") for _ in range(rng.randrange(5, 60))))
    return out


@pytest.mark.parametrize("known", [500_000, 40])
def test_scores_equal_plain_counts(spark, monkeypatch, known):
    monkeypatch.setattr(class_ngram, "KNOWN", known)
    rows = list(enumerate(texts(300))) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "unoak " * 40_000), (1003, "unoak " * 40_000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, score int")
    out = class_ngram.score_texts(docs, class_ngram.in_training()).collect()
    assert len(out) == len(rows)
    split = lambda t: [*(t or "").lower().split(), None]
    counts = Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1 for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    by_id = dict(rows)
    held = []
    for r in out:
        own = split(by_id[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 1 and r.doc_id < 1000:
            held.append((r.score, r.base_score))
    assert sum(a for a, _ in held) > sum(b for _, b in held) * 0.95


def test_known_bound_changes_no_score(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(200))), "doc_id long, text string")
    scores = []
    for known in (500_000, 1200):
        monkeypatch.setattr(class_ngram, "KNOWN", known)
        scores.append({r.doc_id: r.score for r in class_ngram.score_texts(docs, class_ngram.in_training()).collect()})
    assert scores[0].keys() == scores[1].keys() and all(math.isclose(scores[0][k], scores[1][k], rel_tol=1e-9) for k in scores[0])


def test_scores_equal_plain_loops_over_the_classes(spark, monkeypatch):
    """The classes are the model's; transitions, emissions, discount and sums are computed again, word by word."""
    monkeypatch.setattr(class_ngram, "KNOWN", 60)
    rows = [*enumerate(texts(250)), (900, "unoak NEVERSEEN " * 30_000), (901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1]
    model, _ = class_ngram.fit(docs.where(class_ngram.in_training()))
    units = class_ngram.Units(model.frequent, model.numbers)
    split = lambda t: [*(t or "").lower().split(), None]
    kinds = {}
    for _, text in rows:
        for word in split(text):
            if word not in kinds:
                kinds[word] = int(model.classes[next(units.tokens([word or ""]))[1][0]])
    n = class_ngram.CLASSES
    follows, tokens, seen = Counter(), Counter(), Counter()
    for _, text in training:
        last = kinds[None]
        for word in split(text):
            follows[last, kinds[word]] += 1
            tokens[kinds[word]] += 1
            seen[word] += 1
            last = kinds[word]
    types = Counter(kinds[w] for w in seen)
    left = Counter()
    for (a, _), c in follows.items():
        left[a] += c
    once, twice = sum(c == 1 for c in seen.values()), sum(c == 2 for c in seen.values())
    discount = min(0.95, max(0.05, once / (once + 2 * twice)))
    everything = sum(follows.values())

    def step(a, b):
        followers = max(1, sum(x == a for x, _ in follows))
        single = (sum(c for (_, y), c in follows.items() if y == b) + 0.5) / (everything + 0.5 * n)
        return math.log10((follows[a, b] + followers * single) / (left[a] + followers))

    def emission(word):
        k = kinds[word]
        if seen[word]:
            return math.log10((seen[word] - (discount if k else 0)) / tokens[k])
        return math.log10((discount * types[k] if tokens[k] else 1) / max(tokens[k], 1))

    steps = {(a, b): step(a, b) for a in {*kinds.values()} for b in {*kinds.values()}}
    emissions = {w: emission(w) for w in kinds}
    for r in class_ngram.score_texts(docs, class_ngram.in_training()).collect():
        own = split(dict(rows)[r.doc_id])
        expected = sum(steps[kinds[a], kinds[b]] for a, b in zip([None, *own], own)) + sum(emissions[w] for w in own)
        assert math.isclose(r.score, expected, rel_tol=1e-9), (r.doc_id, r.score, expected)


def test_likeliest_class_equals_plain_sums():
    rng = np.random.default_rng(7)
    grid = rng.integers(0, 50, (6, 6)).astype(float)
    grid[4] = grid[:, 4] = 0
    after, before = rng.integers(0, 4, (20, 6)).astype(float), rng.integers(0, 4, (20, 6)).astype(float)
    now = rng.integers(1, 4, 20)
    for w, k in enumerate(class_ngram.likeliest(grid, after, before, now).tolist()):
        values = {}
        for c in (1, 2, 3, 5):
            rows, columns = (np.maximum(grid[c] - after[w], 0), np.maximum(grid[:, c] - before[w], 0)) if c == now[w] else (grid[c], grid[:, c])
            values[c] = sum(a * math.log(g + 0.5) for a, g in zip(after[w], rows)) + sum(b * math.log(g + 0.5) for b, g in zip(before[w], columns)) - after[w].sum() * (math.log(max(rows.sum(), 1)) + math.log(max(columns.sum(), 1)))
        assert k == max(values, key=values.get)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(list(enumerate(texts(100))), "doc_id long, text string")
    model, counts = class_ngram.fit(docs)
    table = counts.collect()
    everything = {r["hash"]: r["n"] for r in table}
    assert np.allclose((10**model.transitions).sum(1), 1)
    mass = np.zeros(class_ngram.CLASSES)
    units = class_ngram.Units(model.frequent, model.numbers)
    seen = {}
    for hashes, own, _ in units.tokens([r.text for r in docs.collect()]):
        seen |= dict(zip(hashes.tolist(), model.classes[own].tolist()))
    for h, n in everything.items():
        mass[seen[h]] += 10 ** model.emission(np.array([n]), np.array([seen[h]]))[0]
    for c in range(1, class_ngram.CLASSES):
        if model.tokens[c]:
            assert abs(mass[c] + 10 ** model.emission(np.array([0]), np.array([c]))[0] - 1) < 1e-9
    assert abs(mass[0] - 1) < 1e-9


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    assert class_ngram.score_texts(docs.limit(0), class_ngram.in_training()).count() == 0
    from pyspark.sql import functions as F

    out = class_ngram.score_texts(docs, F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out} == {(3, 0, 0, 0.0), (2, 0, 0, 0.0)}


def test_exchange_finds_groups():
    rng = np.random.default_rng(0)
    n = 31
    group = np.arange(n - 1) % 3
    matrix = np.zeros((n, n))
    for i in range(n - 1):
        for j in range(n - 1):
            if (group[i] + 1) % 3 == group[j]:
                matrix[i, j] = rng.integers(5, 30)
    matrix[n - 1, 0] = matrix[0, n - 1] = 5
    own = class_ngram.exchange(matrix, classes=4)
    assert own[n - 1] == 0 and all(len(set(own[:-1][group == g])) == 1 for g in range(3)) and len(set(own)) == 4


def test_words_beyond_the_most_frequent_are_clustered_by_their_neighbours(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(class_ngram, "KNOWN", 12)
    one, other = ([f"{x}{k}zzz" for k in range(30)] for x in "ab")
    pick = lambda words: words[rng.randrange(2)] if rng.random() < 0.5 else rng.choice(words)
    docs = spark.createDataFrame([(k, " ".join(f"left {pick(one)} up right {pick(other)} down" for _ in range(30))) for k in range(100)], "doc_id long, text string")
    model, _ = class_ngram.fit(docs)
    units = class_ngram.Units(model.frequent, model.numbers)
    a, b = (set(model.classes[next(units.tokens([" ".join(words)]))[1][:-1]].tolist()) for words in (one, other))
    assert len(model.frequent) == 64 and not a & b


def test_gathered_tables_have_a_bound(monkeypatch):
    sizes = {s: {"k": k} for s, k in ((10, 5), (12, 3), (20, 2))}
    assert [class_ngram._least_scale(sizes, room) for room in (1, 2, 4, 5, 9, 10, 99)] == [None, 20, 20, 12, 12, 10, 10] and class_ngram._least_scale({}, 5) is None


def test_words_beyond_the_bound_have_the_class_of_their_ending(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(60))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(class_ngram, "CLASSED", 0)
    model, _ = class_ngram.fit(docs)
    assert len(model.frequent) == 40 and model.total == 60 * 61  # the words of the exchange alone; all tokens count
