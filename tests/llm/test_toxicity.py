import random

from latticeq.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    part = ["ba", "lo", "mi", "ter", "un", "gra", "shi", "po"]
    rows, labels = [], []
    for i in range(n):
        own = ["".join(rng.choice(part) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(["wretch", "fiend", "cretin"]) + rng.choice(["", ",", "!"])
        rows.append((i, " ".join(own), "x", 0.5))
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark):
    rows, labels = corpus(900)
    rows += [(5000, None, "x", 0.5), (5001, "", "x", 0.5), (None, "you wretch, you fiend, you cretin " * 3, "x", 0.5), (0, rows[0][1], "x", 0.5), (5002, "lo mi ba " * 50_000, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    marks = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1), (0, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_on(docs, marks)
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == len(rows)
    truth = {i: bool(t) for i, t, _ in labels}
    import zlib

    held = [(r.score >= 0.3, truth[r.doc_id]) for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum(a == b for a, b in held) / len(held)
    assert right > 0.9, right
    by_id = {r.doc_id: r.score for r in out}
    assert by_id[5000] == by_id[5001] < 0.3 <= by_id[None] and by_id[5002] < 0.3 and all(0 <= r.score <= 1 for r in out)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and None not in [r.doc_id for r in kept.collect()]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    empty = toxicity.fit_on(docs, marks.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.0}


def test_dictionaries_hold_what_sets_toxic_texts_apart():
    rows, labels = corpus(600)
    texts = [(toxicity._joined(toxicity.words(text)), bool(label)) for (_, text, *_), (_, label, _) in zip(rows, labels)]
    scores = toxicity.scores_of_runs(texts)
    assert toxicity.stretches(b" lo mi you wretch fiend ba ", scores, 5.0) and not toxicity.stretches(b" lo mi ter un gra shi ", scores, 5.0) and not toxicity.stretches(b"", scores, 5.0)
    samples = [x for own, kind in texts if kind for x in toxicity.stretches(own, scores, 5.0)]
    trained = toxicity._dictionary(samples, 512, 8)
    assert len(trained) <= 512 and all(word in trained for word in (b"wretch", b"fiend", b"cretin"))
    assert toxicity._dictionary([b" a few "], 512, 8) == b" a few "


def test_equal_texts_score_alike_and_one_class_scores_the_prior():
    rows, labels = corpus(300)
    toxic, ordinary = ([text for (_, text, *_), (_, label, _) in zip(rows, labels) if label == kind] for kind in (1, 0))
    model = toxicity.fit(toxic, ordinary)
    compressors = model.compressors()
    score = lambda text: model.score(model.share(model.differences(toxicity.words(text), compressors)))
    assert score("You WRETCH, fiend! cretin ...") == score("you wretch fiend cretin") and score("") == score(None) == score(" .,; ")
    assert toxicity.fit([], ordinary).scores == [0.0] and toxicity.fit(toxic, []).scores == [1.0] and toxicity.fit([], []).scores == [0.0]


def test_scores_equal_a_plain_scorer(spark):
    import zstandard

    rows, labels = corpus(300, 8)
    rows = [(i, text) for i, text, *_ in rows] + [(900, "you wretch " + "ba lo mi " * 40_000), (901, "..."), (902, None)]
    model = toxicity.fit([t for (_, t), (_, kind, _) in zip(rows, labels) if kind], [t for (_, t), (_, kind, _) in zip(rows, labels) if not kind])
    longest = max(map(len, model.toxic))

    def size(content, window):
        options = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, hash_log=17, chain_log=17, window_log=17, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options).compress(window))

    import numpy as np

    for row in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").where("doc_id % 25 = 0 or doc_id >= 900"), model).collect():
        own = toxicity.words(dict(rows)[row.doc_id])
        over = n = 0
        for i in range(0, min(len(own), 4000), toxicity.WINDOW):  # of the long text, whose windows repeat, the first
            window = b" " + b" ".join(own[i : i + toxicity.WINDOW]) + b" "
            gain = sum(size(model.ordinary + bytes(longest), window) - size(model.ordinary + bytes(longest - len(x)) + x, window) for x in model.toxic)
            over, n = over + (gain >= model.threshold), n + 1
        if row.doc_id != 900:
            assert abs(row.score - np.interp(over / (n + 10), model.shares, model.scores)) < 1e-12
        else:
            assert row.score < 0.3  # one window of 12,000 at most
