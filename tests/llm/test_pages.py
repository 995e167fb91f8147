import math

from latticeq.llm import page_diff, url_model


def test_blocks_read_what_is_text():
    source = """<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><!-- no --><div class="top ad">Buy</div>
    <article><h1>A &amp; B</h1><p><b>One  two<br>three &lt;x&gt;<p>Four<script>var t="</p>";</script> five</p><div id="comments"><p>Me too</p></div><p>six</article>
    <footer>&copy; me</footer><p>plain &eacute;"""
    assert page_diff.blocks(source) == [(1, "A & B"), (1, "One two three <x>"), (1, "Four five"), (1, "six"), (0, "plain é")]
    assert page_diff.blocks(None) == page_diff.blocks("") == [] and page_diff.blocks("a < b <p") == [(0, "a < b")]


def test_marks_are_whole_and_tags_are_parsed():
    text = lambda source: [x for _, x in page_diff.blocks(source)]
    assert text('<main class="no-sidebar"><article><p>Body</p></article></main>') == ["Body"]
    assert text('<article class="post related-science"><p>Body</p></article>') == ["Body"]
    assert text('<article data-id="comment-box"><p>Body</p></article><main id=comments><p>too') == ["Body", "too"]
    assert text('<p title="a > b">Body</p>') == ["Body"] and text("<p title='x>y' class=a>Body") == ["Body"]
    assert text('<p title="open>Body</p><p class="b">More</p>') == ["Body", "More"]
    assert text('<div class="no-sidebar has-comments"><p>Body</p></div><div data-class="ad" title="class=ad">too') == ["Body", "too"]
    for name in ('class="ad"', "class='x site-nav'", "id=commentList", 'role="navigation"', 'class="ad-300x250"', 'class="post_comments"', 'CLASS="sidebar"'):
        assert text(f"<div {name}><p>Out</p></div><p>In</p>") == ["In"], name
    assert text("<p " + 'a="b" ' * 30_000) == [] and text("<p " + 'a="b" ' * 30_000 + ">In") == ["In"]


def test_main_text_of_random_sites_equals_plain_loops(spark):
    import random

    rng = random.Random(12)
    rows = []
    for host in range(5):
        template = [f"Template {host} {k} {'and more words ' * 3}" for k in range(4)]
        for k in range(rng.randrange(3, 30)):
            lines = template[:2] + [f"Story {host} {k} {j} {'is rather long. ' * 8}" for j in range(rng.randrange(1, 6))] + template[2:]
            lines = [x for x in lines if rng.random() < 0.9]
            rows.append((len(rows), f"http://h{host}.org/{rng.choice('abc')}/{rng.randrange(1000)}", "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"))
    rows.append((len(rows), "http://h0.org/long", "<p>" + "</p><p>".join(f"Line {k} of a very long page" for k in range(20_000))))
    by_host = {}
    for row in rows:
        by_host.setdefault(row[1].split("/")[2], []).append((row[1].split("/", 3)[3], row[0], [x for _, x in page_diff.blocks(row[2])]))
    expected = {}
    for pages in by_host.values():
        pages.sort()
        for k, (path, page, lines) in enumerate(pages):
            near = [pages[i] for i in (k - 1, k + 1) if 0 <= i < len(pages)]
            near.sort(key=lambda x: -next((n for n, (a, b) in enumerate(zip(path, x[0])) if a != b), min(len(path), len(x[0]))))
            far = [x for x in near if sum(len(y) for y in lines if y in x[2]) <= page_diff.COPY_SHARE * sum(map(len, lines))]
            thin = not far and len(near) == 2 and all(set(lines) - set(x[2]) and set(x[2]) - set(lines) for x in near)
            expected[page] = "\n\n".join(x for x in lines if not (far and x in far[0][2] or thin and all(x in y[2] for y in near)))
    found = page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
    assert {r.page_id: r.text for r in found} == expected and sum("Template" in x for x in expected.values()) < len(rows) / 3


def test_common_lines_is_a_longest_common_subsequence():
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    import random

    rng = random.Random(4)
    for _ in range(50):
        a, b = rng.sample(range(20), 12), rng.sample(range(20), 15)
        own = [x for x in page_diff.common_lines(a, b) if x >= 0]
        assert len(own) == lcs(a, b) and own == sorted(own)
    assert page_diff.common_lines([1, 1, 2], [1, 2]) == [0, -1, 1]


def test_common_lines_with_repeated_lines(monkeypatch):
    import random

    assert page_diff.common_lines([7, 1], [1, 7, 1]) == [1, 2]
    rng = random.Random(8)
    for room in (page_diff.ROOM, 6):
        monkeypatch.setattr(page_diff, "ROOM", room)
        for _ in range(200):
            a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 14))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            own = page_diff.common_lines(a, b)
            pairs = [(i, k) for i, k in enumerate(own) if k >= 0]
            assert len(pairs) == best[-1][-1] and all(a[i] == b[k] for i, k in pairs) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_main_text(spark):
    plain = "<html><body><p>Site header</p><p>Story {0} begins.</p><p>Story {0} ends, after a long while.</p><p>Call us</p></body></html>"
    marked = "<body><p>Site header</p><article><h1>Title {0}</h1><p>Common saying.</p><p>Body {0}.</p><p>Share this.</p></article><footer>f</footer></body>"
    rows = [(i, f"http://a.org/x/{i:03}?q", plain.format(i), "k") for i in range(40)] + [(100 + i, f"http://b.org/{i:03}", marked.format(i), "k") for i in range(9)]
    rows += [(200, None, plain.format(1), "k"), (201, "http://c.org/", None, "k"), (202, "http://C.org/1", "", None), (None, "http://d.org", "<p>x", "k"), (0, "http://a.org/x/000?q", plain.format(0), "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = page_diff.main_text(pages.repartition(5)).collect()
    assert len(out) == len(rows)
    text = {r.page_id: r.text for r in out}
    assert all(text[i] == f"Story {i} begins.\n\nStory {i} ends, after a long while." for i in range(1, 40))
    assert all(text[100 + i] == f"Title {i}\n\nCommon saying.\n\nBody {i}.\n\nShare this." for i in range(9))  # what an article holds is its text
    assert text[200].startswith("Site header") and text[201] == text[202] == "" and text[None] == "x"
    assert page_diff.main_text(pages.limit(0)).count() == 0


def test_runs_of_copies_hide_no_neighbour(spark):
    html = "<body><p>Site header</p><p>Story {0} is long enough.</p><p>Call us</p></body>"
    rows = [(i, f"http://a.org/{i:03}", html.format(i if i < 20 or i > 40 else 20)) for i in range(60)]  # a run of 21 copies
    rows += [(100, "http://b.org/1", html.format(1)), (101, "http://b.org/2", html.format(1))]  # of another host, and only copies
    out = {r.page_id: r.text for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == f"Story {i if i < 20 or i > 40 else 20} is long enough." for i in range(60))
    assert out[100] == out[101] == "Site header\n\nStory 1 is long enough.\n\nCall us"


def test_articles_keep_every_block():
    import random

    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 8)
        roles, sizes = [rng.randrange(2) for _ in range(n)], [rng.randrange(1, 50) for _ in range(n)]
        partners = [([rng.choice([-1, k]) for k in range(n)], n + rng.randrange(3)) for _ in range(rng.randrange(3))]
        assert all(keep for role, keep in zip(roles, page_diff.kept_blocks(roles, sizes, partners), strict=True) if role == page_diff.ARTICLE)


def test_thin_pages_of_a_template_lose_it(spark):
    html = "<p>A long header that stands on every page of this site, with its many words.</p><p>Item {0}.</p><p>A footer as long as the header, which says who made the site and when.</p>"
    rows = [(k, f"http://a.org/{k:03}", html.format(k)) for k in range(12)]
    out = {r.page_id: r.text for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"Item {k}." for k in range(1, 11))


def test_markov_model_sums_to_one():
    model = url_model.MarkovModel(3)
    for x in (b"abcab", b"abd", b"bca"):
        model.learn(x)
    for context in (b"", b"a", b"ab", b"zab", b"q"):
        total = sum(math.exp(model.logs(context + bytes([c])) - model.logs(context)) for c in range(256))
        assert abs(total - 1) < 1e-9


def test_urls(spark):
    rules = [url_model.Rule.of(*x) for x in (("allow", "org/"), ("block", "bad.org/"), ("block", "bad.org/x"), ("allow", "com/fr/"))]
    rows = [(i, f"https://WWW.good{i}.org/article/{i}", "k") for i in range(300)] + [(1000 + i, f"http://bad.org/buy-pills-{i}?x#y", "k") for i in range(300)]
    rows += [(5000, "http://n.net/article/77", "k"), (5001, "http://n.net/buy-pills-9", "k"), (5002, None, "k"), (5003, "", None), (5004, "no scheme", "k"), (5005, "http://bad.org", "k"), (None, "ftp://a.b.com/fr/x?://z/", "k"), (0, rows[0][1], "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    out = {r.page_id: r for r in url_model.judge_urls(pages, rules).collect()}
    assert url_model.judge_urls(pages, rules).count() == len(rows) and url_model.judge_urls(pages.limit(0), rules).count() == 0
    assert (out[3].host, out[3].path, out[3].rule, out[3].verdict) == ("www.good3.org", "/article/3", "org/", "allow")
    assert (out[1003].path, out[1003].rule, out[1003].verdict) == ("/buy-pills-3", "bad.org/", "block")
    assert out[5000].verdict == "allow" and out[5001].verdict == "block" and out[5000].rule is None
    assert [out[k].host + out[k].path for k in (5002, 5003, 5004)] == ["", "", ""] and out[5003].ratio == 0
    assert (out[5005].host, out[5005].path, out[5005].rule) == ("bad.org", "", None)
    assert (out[None].host, out[None].path, out[None].rule) == ("a.b.com", "/fr/x", "com/fr/")


def test_long_urls_are_learnt_whole():
    url = "http://n.net/" + "a/" * 220 + "?{0}={1}"
    model = url_model.fit([url.format("article", i) for i in range(60)], [url.format("buypills", i) for i in range(60)])
    assert model.ratio(url.format("article", 77)) > model.threshold > model.ratio(url.format("buypills", 77))
    assert sum(model.accepted.counts[b"artic"].values()) > 0


def test_ratios_and_verdicts_equal_plain_counts(spark):
    """Witten-Bell blending, calibration and verdicts from plain counts of every context."""
    import random
    import zlib

    rng = random.Random(9)
    rows = [(i, f"http://{rng.choice(['a', 'bb', 'ccc'])}.{'org' if i % 2 else 'net'}/{''.join(rng.choice('abcdef' if i % 2 else 'uvwxyé') for _ in range(rng.randrange(3, 12)))}") for i in range(120)]
    rows += [(500 + i, f"http://x.de/{''.join(rng.choice('abcdefuvwxy') for _ in range(8))}") for i in range(60)] + [(700, "http://x.de/" + "abc" * 3000), (701, ""), (702, "http://x.de/equal"), (703, "http://x.de/equal")]
    rules = [url_model.Rule.of("allow", "org/"), url_model.Rule.of("block", "net/")]

    def learnt(urls):
        counts = {}
        for url in urls:
            data = url.encode()
            for i in range(len(data)):
                for k in range(min(i, 6) + 1):
                    after = counts.setdefault(data[i - k : i], {})
                    after[data[i]] = after.get(data[i], 0) + 1
        return counts

    def logs(counts, data):
        total = 0.0
        for i in range(len(data)):
            p = 1 / 256
            for k in range(min(i, 6) + 1):
                after = counts.get(data[i - k : i])
                if not after:
                    break
                n, kinds = sum(after.values()), len(after)
                p = n / (n + kinds) * after.get(data[i], 0) / n + kinds / (n + kinds) * p
            total += math.log(p)
        return total

    by_kind = {kind: {url for _, url in rows if "://" in url and url.split("/")[2].endswith(end)} for kind, end in (("allow", ".org"), ("block", ".net"))}
    models = {kind: learnt(url for url in urls if zlib.crc32(url.encode()) % 5) for kind, urls in by_kind.items()}
    ratio = lambda url: (logs(models["allow"], url.encode()) - logs(models["block"], url.encode())) / len(url.encode()) if url else 0.0
    left = {kind: [ratio(url) for url in urls if zlib.crc32(url.encode()) % 5 == 0] for kind, urls in by_kind.items()}
    right = lambda t: sum(x >= t for x in left["allow"]) / len(left["allow"]) + sum(x < t for x in left["block"]) / len(left["block"])
    out = url_model.judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(3), rules).collect()
    assert len(out) == len(rows)
    threshold = url_model.fit([*by_kind["allow"]], [*by_kind["block"]]).threshold
    assert math.isclose(right(threshold), max(right(t) for values in left.values() for x in values for t in (x, x + 1e-9)))
    for row in out:
        url = dict(rows)[row.page_id]
        assert math.isclose(row.ratio, ratio(url), rel_tol=1e-9, abs_tol=1e-12)
        assert row.verdict == ("allow" if url in by_kind["allow"] else "block" if url in by_kind["block"] else "allow" if row.ratio >= threshold else "block")
    judged = {r.verdict for r in out if r.page_id >= 500}
    assert judged == {"allow", "block"}
