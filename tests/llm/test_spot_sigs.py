import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from latticeq.llm import queries, spot_sigs

SF = "/root/testdata/sf0.001"
CLASHES = ["own_words", "part", "h", "x", "key"]


def spots(text):
    """The spots of a text as tuples, one word after another."""
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    common = set(spot_sigs.ANCHORS)
    out = set()
    for i, word in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in common][: spot_sigs.CHAIN]
        anchor = word in common or not common & set(words[max(0, i - spot_sigs.GAP) : i])
        if anchor and len(chain) == spot_sigs.CHAIN:
            out.add((word, *chain))
    return out or ({tuple(words)} if words else {text} if text.strip() else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b) if min(len(a), len(b)) >= spot_sigs.LEAST * max(len(a), len(b)) else 0.0


def check(docs, found):
    """docs: (id, text) in order of ids. Every column of found, against a plain version."""
    texts = [t or "" for _, t in docs]
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(docs)
    for k, (doc_id, _) in enumerate(docs):
        text, after, row = texts[k], texts[(k + 1) % len(texts)], got[doc_id]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, changed, following = map(spots, (text, edited, after))
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.n_signatures == len(own) and len(row.fingerprint) == 8 * len(own) and len(row.edited_fingerprint) == 8 * len(changed)
        assert row.near_edited == pytest.approx(jaccard(own, changed), abs=1e-12) and row.near_next == pytest.approx(jaccard(own, following), abs=1e-12)
    prints = {}
    for doc_id, text in docs:
        assert prints.setdefault(text or "", got[doc_id].fingerprint) == got[doc_id].fingerprint
    return got


def test_query_equals_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = check(docs, queries.op12_spot_signatures(spark, SF))
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.97 * len(got)


def test_edges_and_clashing_names(spark):
    texts = [None, "", " \n\t ", "###", "one", "The the of", "Ünïcode wörds 漢字 ohne Trennung", "same text of two words and more", "same text of two words and more", "the quick brown fox of the hill " * 3000, "x" * 70_000]
    docs = [(k * 7 - 14, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name in CLASHES:
        table = table.withColumn(name, F.lit(1))
    got = check(docs, spot_sigs.fingerprints(table))
    assert got[-14].fingerprint == got[-7].fingerprint == got[0].fingerprint == "" and got[7].fingerprint != ""
    assert got[35].near_next == 1.0


def test_order_of_repeated_and_null_keys_empty_and_single_tables(spark):
    schema = "doc_id string, text string"
    assert spot_sigs.fingerprints(spark.createDataFrame([], schema)).count() == 0
    single = spot_sigs.with_next(spark.createDataFrame([("a", "alone")], schema)).collect()
    assert [tuple(r) for r in single] == [("a", "alone", "alone")]
    rows = [(None, "n"), ("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), ("c", "w")]
    found = [tuple(r) for r in spot_sigs.with_next(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(map(str, (r[:2] for r in found))) == sorted(map(str, rows))
    after = {(key, text): nxt for key, text, nxt in found if key != "a"}
    assert after[None, "n"] == "x" and after["c", "w"] == "n" and {after["b", "y"], after["b", "z"]} == {"w", "z"} or {after["b", "y"], after["b", "z"]} == {"w", "y"}
    assert sorted(nxt for key, _, nxt in found if key == "a")[0] == "x"


def test_search_finds_all_near_sets(spark):
    base = [f"the {a} river of {b} stones and {c} trees in a {a}{b} wood near {c}{a} hills" for a in ("red", "old", "cold", "wide") for b in ("grey", "small") for c in ("tall", "green", "dry")]
    texts = [" ".join(base[k : k + 9]) for k in range(12)] + [" ".join(base[k : k + 8]) for k in range(12)] + [" ".join(base[:9])] * 3 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["query"], r["match"]): r["near"] for r in spot_sigs.search(docs.where("doc_id % 5 = 0"), docs, threshold=0.6).collect()}
    sets = {k: spots(t) for k, t in enumerate(texts) if t}
    least = {frozenset(s): k for k, s in reversed(sets.items())}
    wanted = {}
    for query in {min(k for k in sets if k % 5 == 0 and sets[k] == s) for s in (sets[k] for k in sets if k % 5 == 0)}:
        for s, match in least.items():
            if jaccard(sets[query], s) >= 0.6:
                wanted[query, match] = jaccard(sets[query], s)
    assert found.keys() == wanted.keys() and all(math.isclose(found[k], wanted[k]) for k in wanted) and len(wanted) > 10
