import random

from latticeq.llm import license_scan, license_texts


def test_patience_pairs_are_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghijklmn") for _ in range(rng.randrange(0, 25))] for _ in range(2))
        pairs = license_scan.patience_pairs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < n for (i, j), (k, n) in zip(pairs, pairs[1:]))
    words = [f"w{i}" for i in range(200)]
    assert len(license_scan.patience_pairs(words, words[:50] + ["x"] + words[50:])) == 200


def test_every_notice_is_found_in_whole_texts(spark):
    rng = random.Random(7)

    def prose(n):
        return " ".join(f"w{rng.randrange(5000)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and", "license", "software"]) for _ in range(n))

    rows = [(k, f"{prose(3000)}\n{text.upper() if k % 2 else text}\n{prose(500)}", "x") for k, (_, _, text) in enumerate(license_texts.NOTICES)]
    edited = license_texts.NOTICES[0][2].split()
    edited[10:12] = ["some", "other", "words"]
    rows += [(100, " ".join(edited), "x"), (101, None, "x"), (102, "", "x"), (103, prose(50_000), "x"), (None, "All rights reserved.", "x"), (1, rows[1][1], "x"), (104, "Released under the License.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coverage string")
    out = license_scan.scan_licenses(docs).collect()
    spans = {}
    for r in out:
        spans.setdefault(r.doc_id, []).append(r)
    for k, (license_id, _, text) in enumerate(license_texts.NOTICES):
        own = [r for r in spans[k] if r.license_id == license_id and r.start_word == 3000]
        assert own and own[0].coverage == 1.0 and own[0].end_word - own[0].start_word == len(license_scan.terms(text)), (k, spans[k])
    assert [(r.license_id, r.coverage < 1) for r in spans[100]] == [("MIT", True)]
    assert len(spans[1]) == 2 and spans[None][0].license_id.endswith("reserved") and not {101, 102, 103, 104} & spans.keys()
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_adjacent_copies_of_a_notice_are_all_found():
    scanner = license_scan.Scanner(license_texts.NOTICES)
    for license_id, _, text in license_texts.NOTICES:
        n = len(license_scan.terms(text))
        edited = text.split()
        edited[len(edited) // 2 : len(edited) // 2] = ["xx", "yy"][: n // 8]
        for copies in ([text] * 2, [text] * 3, [" ".join(edited), text]):
            (out,) = scanner.scan(["foo bar.\n" + "\n".join(copies) + "\nbaz qux."])
            more = len(copies[0].split()) - len(text.split())
            expected = [2 + k * n + (more if k else 0) for k in range(len(copies))]
            assert [x[1] for x in out if x[0] == license_id] == expected, (license_id, out)


def test_patience_pairs_against_the_quadratic_table():
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(13)
    for _ in range(150):
        a, b = (rng.sample(range(30), rng.randrange(0, 20)) for _ in range(2))  # every word is unique: anchors are a longest common subsequence
        assert len(license_scan.patience_pairs(a, b)) == lcs(a, b)
        c, d = ([rng.randrange(6) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        assert len(license_scan.patience_pairs(c, d)) <= lcs(c, d)


def test_of_equal_notices_the_first_identifier_stays():
    text = "one two three four five six seven"
    scanner = license_scan.Scanner([("B", "one", text), ("A", "one", text), ("C", "one", text + " eight nine")])
    (both, longer, none) = scanner.scan([f"x {text} y {text}", f"x {text} eight nine", "one two three x four"])
    assert both == [("A", 1, 8, 1.0), ("A", 9, 16, 1.0)] and longer == [("C", 1, 10, 1.0)] and none == []


def test_many_notices_in_one_text_take_seconds():
    import time

    scanner = license_scan.Scanner(license_texts.NOTICES)
    began = time.perf_counter()
    (out,) = scanner.scan(["\n".join(f"All rights reserved. Item {k} goes on here for some words." for k in range(100_000))])
    assert len(out) == 100_000 and time.perf_counter() - began < 60


def test_scan_against_the_alignment_of_every_window():
    """Brute force: each notice aligned with every window of the text of about its length, without looking for runs first."""
    rng = random.Random(21)
    notices = [(f"L{n}", f"w{n}x0", " ".join(f"w{n}x{k}" for k in range(size))) for n, size in enumerate((6, 9, 14))]
    scanner = license_scan.Scanner(notices)
    for _ in range(60):
        text = []
        for _ in range(3):
            text += [f"p{rng.randrange(50)}" for _ in range(rng.randrange(12, 25))]
            own = license_scan.terms(rng.choice(notices)[2])
            own = [w.decode() for w in own]
            for _ in range(rng.randrange(3)):  # edits
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = ["edit"] * rng.randrange(2)
            text += own
        words = license_scan.terms(" ".join(text))
        best = {}
        for notice in scanner.notices:
            size = len(notice.words)
            for low in range(len(words)):
                pairs = license_scan.patience_pairs(words[low : low + size + 3], notice.words)
                runs = any(len({pairs[k + j][0] - j for j in range(3)}) == 1 == len({pairs[k + j][1] - j for j in range(3)}) for k in range(len(pairs) - 2))
                if len(pairs) >= scanner.least * size and notice.keys <= {notice.words[to] for _, to in pairs} and runs:
                    best[notice.license_id, low + pairs[0][0]] = max(best.get((notice.license_id, low + pairs[0][0]), (0,)), (len(pairs), low + pairs[-1][0] + 1))
        (found,) = scanner.scan([" ".join(text)])
        assert {(name, low) for name, low, _, _ in found} == set(best), (text, found, best)
        assert all(best[name, low][1] == high for name, low, high, _ in found), str([(x, best[x[:2]], b" ".join(words[x[1] - 2 : x[1] + 20]).decode()) for x in found if best[x[:2]][1] != x[2]])
