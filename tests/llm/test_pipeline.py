import random
from collections import Counter

import pytest

import corpus_pipeline
from latticeq.llm import decontam, packing, site_lines, toxicity
from latticeq.llm.queries import tokenizer_path
from tests.llm.test_near_dup import brute
from tests.llm.test_toxicity import corpus

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = corpus(400, 5)
    docs = []
    items = [" ".join(f"q{rng.randrange(900)}" for _ in range(30)) for _ in range(5)]
    for i, text, _, _ in rows:
        lines = [text, f"Own line {i}."]
        if i % 2:
            lines.insert(0, "This site uses a header.")
        if i % 50 == 1:
            lines.append(items[(i // 50) % 5])
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
    docs += [(1000 + k, docs[5][1] + " More.", "en", "s1", 0) for k in range(4)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def plain(spark, path, docs, items):
    """The first four stages by plain loops over the same model and rules."""
    model = toxicity.fit_on(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    compressors = model.compressors()
    score = lambda t: model.score(model.share(model.differences(toxicity.words(t), compressors)))
    kept = [d for d in docs if score(d[1]) < toxicity.THRESHOLD]
    pages = {(d[3] or "", d[1]) for d in kept if d[1] is not None}
    totals = Counter(host for host, _ in pages)
    counts = Counter((host, line) for host, text in pages for line in {x.strip(" ") for x in text.split("\n")} if line)
    drop = {key for key, n in counts.items() if n - 1 > site_lines.RATIO * (totals[key[0]] + site_lines.PRIOR) or n - 1 > site_lines.LONG_RATIO * (totals[key[0]] + site_lines.LONG_PRIOR) and len(key[1].split()) > site_lines.LONG_WORDS}
    texts = [(d[0], None if d[1] is None else "\n".join(x for x in d[1].split("\n") if ((d[3] or ""), x.strip(" ")) not in drop)) for d in kept]
    root = brute(texts)
    texts = [(k, t) for k, t in texts if root[k] == k]
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(decontam.terms, items)]

    def leaks(text):
        w = decontam.terms(text)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(len(own & r) > 0.8 * len(r) for r in runs)

    return len(kept), [(k, t) for k, t in texts if not leaks(t)]


def test_stages_equal_plain_loops(spark, folder):
    path, docs, items = folder
    n_kept, texts = plain(spark, path, docs, items)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        frame = corpus_pipeline.stored(stage(spark, frame, path))
        assert frame.columns == columns
        if number == 0:
            assert frame.count() == n_kept < len(docs)
    assert sorted((r.doc_id, r.text) for r in frame.collect()) == sorted(texts, key=lambda x: x[0])
    assert {2000, 2001} <= {k for k, _ in texts} and not {1000, 1001, 1002, 1003} & {k for k, _ in texts}
    assert all(r.n_chars == len(r.text) for r in frame.where("text is not null").collect())


def test_run_packs_what_is_left(spark, folder):
    path, docs, items = folder
    _, texts = plain(spark, path, docs, items)
    out = corpus_pipeline.run(spark, path).collect()
    encoder = packing.WordTokenizer(tokenizer_path())
    assert {r.doc_id: r.length for r in out} == {k: len(encoder.whole(t or "")) // 4 + 1 for k, t in texts}
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) == -(-total // 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]
