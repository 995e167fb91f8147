from latticeq.llm import line_quality, site_lines


def test_site_lines(spark):
    page = "Common header.\nOwn line {0} here.\n\nOther {0}."
    rows = [(i, page.format(i), "a", 7) for i in range(10)]
    rows += [(100 + i, "Copied page.\nAll of it.", "a", 7) for i in range(30)]  # copies of one page are one page
    rows += [(200, None, "a", 7), (201, "", None, 7), (202, "Common header.", "b", None), (0, page.format(0), "a", 7), (None, "Common header.", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    out = {(r.doc_id, r.source): r for r in site_lines.drop_site_lines(docs).collect()}
    assert out[3, "a"].text == "Own line 3 here.\n\nOther 3." and (out[3, "a"].n_lines, out[3, "a"].n_dropped) == (4, 1)
    assert out[105, "a"].text == "Copied page.\nAll of it."
    assert out[200, "a"].text is None and out[200, "a"].n_lines == 0
    assert out[201, None].text == "" and out[202, "b"].text == "Common header."
    assert out[None, "a"].text == ""
    assert site_lines.drop_site_lines(docs).count() == len(rows)
    long = "word " * 60_000
    rows = [(i, f"{long}\nOwn {i}", "a" if i < 5 else "b") for i in range(7)]  # on five pages of one host and two of another
    out = {r.doc_id: r.text for r in site_lines.drop_site_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i] == (f"Own {i}" if i < 5 else f"{long}\nOwn {i}") for i in range(7))
    assert site_lines.drop_site_lines(docs.limit(0)).count() == 0


def test_repeated_lines_of_small_and_hot_sources_go(spark):
    import corpus_pipeline

    passage = {(host, k): " ".join(f"{host}{k}w{i}" for i in range(60)) for host in ("hot", "small") for k in range(8)}
    rows = [(i, f"Own line {i}.\nSeen {i // 2} twice.", "hot", 0) for i in range(3000)] + [(10_000 + i, f"Small line {i}.", "small", 0) for i in range(40)]
    holding = []
    for (host, k), line in passage.items():  # each in three different texts, of 3,000 and of 40
        for i in range(3):
            at = k * 3 + i + (3000 if host == "small" else 0)
            rows[at] = (*rows[at][:1], rows[at][1] + "\n " + line, *rows[at][2:])
            holding.append(rows[at][0])
    rows = [(k, text + "\nRead more." if host == "hot" and k % 50 == 0 else text, host, n) for k, text, host, n in rows]  # on 2 % of the pages
    rows += [(20_000 + i, rows[0][1], "hot", 0) for i in range(5)] + [(30_000, None, "hot", 0), (30_001, "Read more.", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_site_lines(spark, docs, "").collect()}
    assert len(out) == len(rows)
    assert all(out[k] == (f"Own line {k}.\nSeen {k // 2} twice." if k < 3000 else f"Small line {k - 10_000}.") for k in holding)
    assert not any("Read more." in (out[k] or "") for k in range(3000)) and out[30_001] == "Read more." and out[30_000] is None
    assert out[20_003] == out[0] and out[2999] == "Own line 2999.\nSeen 1499 twice."


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_line_quality(spark):
    clean = "This is a proper sentence about nothing much.\nAnd this is another one, with a comma."
    texts = [clean, None, "", "a b c d e", "x " * 30_000, "one two three four five six " * 3, clean + "\n" + clean, "a | b | c | d | e | f | g | h | i | j | k | l", "STOP!! NOW!! " * 9, "é ü 日本 #|\x0b\x0c\r\n \n\t\n#", "\n".join(f"{i} un deux trois" for i in range(3000)) + "\nfin de six mots ou sept mots"]
    texts.append("Every line says something.\nNone of them repeats what others said.\nThat makes a clean text.\nAll rights reserved.")
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, clean, "k"), (None, clean, None)], "doc_id long, text string, kept string")
    rows = line_quality.clean_lines(docs).collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        own = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert own == brute(row.text)
        assert row.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
    verdict = {row.doc_id: row.kept for row in rows}
    assert verdict[0] and verdict[11] and not any(verdict[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9))
    assert next(r for r in rows if r.doc_id == 11).clean_text.count("\n") == 2
    assert line_quality.clean_lines(docs.limit(0)).count() == 0


def test_columns_with_names_of_inner_ones_keep_their_values(spark):
    names = ["row", "host", "page", "line", "long", "drop", "kept_", "x", "n", "pages", "_page", "_drop", "_kept", "_h", "_t", "_words", "_row", "_good", "a.b"]
    rows = [(i, f"Header on all.\nOwn line {i} says something.", "s", *([f"v{i}"] * len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for found, results in ((site_lines.drop_site_lines(docs), {"n_lines", "n_dropped"}), (line_quality.clean_lines(docs), None)):
        own = found.collect()
        assert len(own) == 12 and all(row[name] == f"v{row['doc_id']}" for row in own for name in names)
        assert results is None or {r["text"] for r in own} == {f"Own line {i} says something." for i in range(12)} and {*found.columns} == {"doc_id", "text", "source", *names} | results
