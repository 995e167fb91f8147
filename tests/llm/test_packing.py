import zlib

import numpy as np
import pytest

from latticeq.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_cache_gives_the_tokenizers_ids():
    texts = ["", "The cat's hat, isn't it?", "a.b,c 12 x3y <|endoftext|> end", "Éá ΣΑΣ ﬁ x\x1cy", "'s' don't'. ...!!! a's.", "naïve café é.", "日本語 テスト。 a​b", "İstanbul ISTANBUL"]
    encoder = packing.WordTokenizer(PATH)
    assert list(encoder.batch(texts)) == [encoder.whole(text) for text in texts]


def first_fit_decreasing(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = next((k for k, room in enumerate(rooms) if room >= length), None)
            if k is None:
                rooms.append(capacity)
                k = len(rooms) - 1
            rooms[k] -= length
    return len(rooms)


def test_fullest_bins_use_up_the_counts():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 60, 12), rng.integers(1, 30, 12))}
        used: dict[int, int] = {}
        bins = packing.minimum_bin_slack(dict(counts), 60)
        for alike, one in bins:
            assert sum(k * n for k, n in one.items()) <= 60
            for k, n in one.items():
                used[k] = used.get(k, 0) + alike * n
        assert used == counts
        assert sum(alike for alike, _ in bins) <= first_fit_decreasing(counts, 60)


def test_fullest_is_the_best_subset():
    assert packing.fullest({50: 1, 30: 1, 29: 1, 21: 1}, 100) == {50: 1, 29: 1, 21: 1}
    assert packing.fullest({7: 20}, 50) == {7: 7}


def test_fullest_equals_plain_enumeration():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        capacity = rng.randrange(max(counts), 90)
        sums = (sum(k * n for k, n in zip(counts, ns)) for ns in itertools.product(*(range(n + 1) for n in counts.values())) if ns[[*counts].index(max(counts))])
        own = packing.fullest(counts, capacity)
        assert sum(k * n for k, n in own.items()) == max(x for x in sums if x <= capacity)
        assert own[max(counts)] >= 1 and all(n <= counts[k] for k, n in own.items())


def test_pack_documents(spark):
    rows = [(1, "a b c", "x", 1), (2, None, "x", 1), (3, "", "y", 2), (4, "word " * 5000, "y", 2), (5, "a b c", None, None), (5, "a b c", None, None), (None, "null id", "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int")
    out = packing.pack_documents(docs, PATH, with_ids=True).toPandas()
    encoder = packing.WordTokenizer(PATH)
    assert len(out) == 3 + 3 + 2 + 1
    for key, text in ((1, "a b c"), (2, ""), (4, "word " * 5000)):
        ids = encoder.whole(text) + bytes(4)
        own = out[out.doc_id == key].sort_values("piece")
        assert [*own.start] == list(range(0, len(ids) // 4, 2048))
        assert b"".join(np.asarray(x, "<u4").tobytes() for x in own.ids) == ids
        assert [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in own.ids] == [*own.ids_crc32]
    for _, bin_ in out.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert [*bin_.offset] == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= 2048
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
