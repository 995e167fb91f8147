import random

from latticeq.llm import decontam


def words(rng, n, k=300):
    return " ".join(f"w{min(rng.randrange(k), rng.randrange(k))}" for _ in range(n))


def test_search_equals_brute_force():
    rng = random.Random(2)
    items = [decontam.Item(i, words(rng, rng.randrange(4, 40), 25)) for i in range(400)]
    index = next(decontam._index(items, decontam.Counter(t for x in items for t in set(x.terms)), items))
    for _ in range(60):
        query = sorted({index.number[t] for t in decontam.pairs(decontam.terms(words(rng, 90, 25))) if t in index.number})
        scores = {}
        for t in query:
            for i, w in zip(*index.postings[t][:2]):
                scores[i] = scores.get(i, 0) + w
        for threshold in (0.2, 0.35, 0.6):
            assert sorted(i for i, _ in index.search(query, threshold)) == sorted(i for i, s in scores.items() if s >= threshold)


def test_every_passage_that_overlaps_is_retrieved():
    """Against all passages and items, each by its overlaps alone: items are planted with words changed, so that many are near the limits."""
    rng = random.Random(6)
    items = [decontam.Item(i, words(rng, rng.randrange(6, 50), 60 if i % 2 else 3000) + ("\nAnswer: " + words(rng, rng.choice([1, 2, 3, 9]), 40) if i % 3 == 0 else "")) for i in range(120)]
    items += [decontam.Item(200, "yes no"), decontam.Item(201, "a b a b a b a b a b a b"), decontam.Item(202, "q\nA: r"), decontam.Item(203, items[5].words and b" ".join(items[5].words).decode())]
    index = next(decontam._index(items, decontam.Counter(t for x in items for t in set(x.terms)), items))
    texts = []
    for _ in range(150):
        text = []
        for _ in range(rng.randrange(1, 4)):
            own = [w.decode() for w in rng.choice(items).words]
            for _ in range(rng.randrange(0, 1 + len(own) // 5)):
                own[rng.randrange(len(own))] = f"z{rng.random()}"
            text += words(rng, rng.randrange(0, 200), 3000).split() + own
        texts.append(" ".join(text))
    texts += ["a b " * 30, "yes no", "", None, items[1].words and b" ".join(items[1].words * 3).decode()]
    found = limits = 0
    for text, leaks in zip(texts, index.leaks(texts), strict=True):
        own = decontam.terms(text)
        expected = set()
        for item in items:
            for start in range(0, max(1, len(own)), index.block):
                question, answer = item.overlap(own[start : start + 2 * index.block])
                if item.terms and question >= decontam.QUESTION and answer >= decontam.ANSWER:
                    expected.add(item.item_id)
                    limits += min(question, answer) < 0.8
        assert {x[0] for x in leaks} == expected
        found += len(expected)
    assert found > 100 and limits > 30


def test_leaks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randrange(15, 60), 4000)) for i in range(60)] + [(90, None), (91, ""), (None, "some words here")]
    rows = [(0, words(rng, 5000, 4000) + "\n" + items[7][1].upper().replace(" ", ", ") + words(rng, 3000, 4000)), (1, items[8][1]), (2, None), (3, ""), (4, words(rng, 800, 4000)), (1, items[8][1])]
    rows += [(5, " ".join(items[9][1].split()[:-8]) + " but another end of it"), (None, items[10][1] + " x " + items[11][1])]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted([(0, 7), (1, 8), (1, 8), (-1, 10), (-1, 11)])

    def found():
        return sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in decontam.benchmark_leaks(docs, bench).collect())

    assert found() == expected
    scores = {(r.doc_id, r.item_id): r.score for r in decontam.benchmark_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam.indexes, "__defaults__", (4000,))  # several indexes, same scores
    assert len(list(decontam.indexes(bench))) > 2 and found() == expected
    again = {(r.doc_id, r.item_id): r.score for r in decontam.benchmark_leaks(docs, bench).collect()}
    assert scores.keys() == again.keys() and all(abs(scores[k] - again[k]) < 1e-9 for k in scores)
    monkeypatch.undo()
    clean = decontam.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    assert decontam.benchmark_leaks(docs.limit(0), bench).count() == 0 and decontam.benchmark_leaks(docs, bench.limit(0)).count() == 0
