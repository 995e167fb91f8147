import random

import numpy as np

from latticeq.llm import near_dup


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(key, shingles(text)) for key, text in rows if key is not None]
    root = {key: key for key, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {key: find(key) for key, _ in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"g{group}_{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, max(2, len(base) // 12)))) for k in range(25)]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "  \n", "one two", "One TWO", "one two three", " ".join(map(str, range(30_000))), " ".join(map(str, range(29_999)))])]
    rows += [(3, rows[3][1]), (None, rows[3][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, digest int")
    out = near_dup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    expected = brute(rows)
    texts = dict(rows)
    for row in out:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
            continue
        assert row.component_id == expected[row.doc_id] and row.kept == (row.doc_id == row.component_id)
        assert row.n_shingles == len(shingles(texts[row.doc_id]))
    assert len({expected[k] for k in expected}) < len(expected) - 20
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.keep_one(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in expected if expected[k] == k}


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = near_dup.super_min_hash(pool[:300], 256), near_dup.super_min_hash(pool[100:], 256)
    assert abs((a == b).mean() - 0.5) < 0.1
    whole = near_dup.super_min_hash(pool, 64)
    assert (whole == np.minimum(near_dup.super_min_hash(pool[:170], 64), near_dup.super_min_hash(pool[170:], 64))).all()
    small = near_dup.super_min_hash(pool[:3], 16)
    assert len({int(x) >> 32 for x in small}) > 1 and (small != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000 + i, 999) for i in range(1, 50)], "a long, b long").repartition(7)
    found = {r.id: r.component for r in near_dup.components(edges).collect()}
    assert found == {i: 0 for i in range(301)} | {i: 999 for i in range(999, 1050) if i != 1000}


def test_blocks_of_crowded_buckets_equal_brute_force(spark, monkeypatch):
    """Buckets of many members that no centre unites go through many small blocks, in every combination of largest part and rest."""
    rng = random.Random(11)
    rows = []
    for group in range(3):  # near copies around a text that is not there, some of them of each other
        base = [f"c{group}_{rng.randrange(500)}" for _ in range(90)]
        for _ in range(40):
            own = edited(rng, base, rng.randrange(1, 4)).split()
            rows += [(len(rows) + k, edited(rng, own, rng.randrange(0, 2))) for k in range(rng.choice([1, 1, 3]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert 3 < len(set(expected.values())) < len(rows)
    for block, crowd in ((8, 16), (8, 10_000), (1024, 16)):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "CROWD", crowd)
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == expected


def test_postings_count_common_elements():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40), dtype=np.uint64)) for _ in range(30)]
    postings = near_dup._Postings(sets)
    for own in sets:
        assert postings.common(own).tolist() == [len(np.intersect1d(own, other)) for other in sets]


def test_other_bands(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(400)}" for _ in range(100)]
    rows = [(k, edited(rng, base, rng.randrange(0, 6))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, bands=40, rows=3).collect()} == brute(rows)
