"""Line deduplication by site-relative frequency: lines on more than a set part of a host's pages are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A line goes if its part of the host's pages, shrunk, is more than this. The shrunken part is (n - 1) / (pages + PRIOR): one page says nothing, and a host of few
#: pages little, so that about five of a hundred pages, and in the end 1 % of a large host's, make boilerplate.
RATIO, PRIOR = 0.01, 300
#: A line of more than LONG_WORDS words does not recur by chance: a smaller part is enough, on a small host three pages.
LONG_WORDS, LONG_RATIO, LONG_PRIOR = 50, 0.0003, 3500
_BLANKS = r"[\x20\x09-\x0D]+"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def drop_site_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, prior: float = PRIOR, long_words: int = LONG_WORDS, long_ratio: float = LONG_RATIO, long_prior: float = LONG_PRIOR) -> DataFrame:
    """docs with the boilerplate lines of each host taken out of the text, plus n_lines and n_dropped.

    Pages are different texts of a host: copies of one page count once, both among the pages with a line and in the host's total, so that
    a page is not boilerplate for being copied. Lines are compared without outer spaces; blank lines are neither counted nor dropped. A null
    host is the host ''; a null text stays null with 0 lines; repeated rows are cleaned each; a document whose every line is dropped keeps an
    empty text; a line of any length is one line; an empty table gives an empty table; columns of docs keep their values, whatever their names, but
    n_lines and n_dropped, which are replaced. No array is made for each host, as the number of long lines grows with it: every page meets its own lines'
    verdicts, by joins on (host, line) and then (host, page), so that a hot host is dealt to many tasks.
    """
    # the caller's other columns travel in one struct, so that no name can clash
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).alias("none")]
    source = docs.select(F.struct(*others).alias("row"), _host(f"`{host}`").alias("host"), F.xxhash64(f"`{text}`").alias("page"), F.col(f"`{text}`").alias("text"))
    pages = source.where(F.col("text").isNotNull()).select("host", "page", "text")
    totals = pages.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines("text"), lambda line: F.trim(line) != ""), lambda line: F.struct(_key(line).alias("line"), _is_long(line, long_words).alias("long"))))
    lines = stored(pages.select("host", "page", F.explode(keys).alias("x")).select("host", "page", F.col("x.line").alias("line"), F.col("x.long").alias("long")).distinct())
    common = lines.groupBy("host", "line", "long").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    part = lambda n, own, least: (n - 1) > F.lit(float(least)) * (F.col("pages") + F.lit(float(own)))
    frequent = part(F.col("n"), prior, ratio) | F.col("long") & part(F.col("n"), long_prior, long_ratio)
    chosen = common.join(totals, "host").where(frequent).select("host", "line")
    dropped = stored(lines.join(stored(chosen), ["host", "line"]).groupBy("host", "page").agg(F.collect_list("line").alias("drop")))  # lines of one page
    # dropped grows with the pages, so texts move once to meet it at every size; of copies of one page, Spark splits the side of the texts
    return _cleaned(source.join(dropped.hint("merge"), ["host", "page"], "left"), docs.columns, text)


def _is_long(line: Column, words: int) -> Column:
    """Whether a line has more words; words are split only where the length allows so many."""
    return F.when(F.length(line) > 2 * words, F.size(F.split(F.trim(line), _BLANKS, -1)) > words).otherwise(False)


def _cleaned(joined: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns in `row` with the lines whose hash is in `drop` taken out of the text, plus n_lines and n_dropped."""
    kept = F.when(F.col("drop").isNull(), _lines("text")).otherwise(F.filter(_lines("text"), lambda line: ~F.array_contains(F.col("drop"), _key(line)) | (F.trim(line) == "")))
    cleaned = joined.withColumn("kept", kept)
    counted = [F.coalesce(F.size(_lines("text")), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size(_lines("text")) - F.size("kept"), F.lit(0)).cast("bigint").alias("n_dropped")]
    own = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns if c not in ("n_lines", "n_dropped")]
    return cleaned.select(*own, *counted)


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
lines AS (SELECT DISTINCT host, text, trim(unnest(string_split(text, chr(10)))) AS line FROM docs WHERE text IS NOT NULL),
totals AS (SELECT host, count(DISTINCT text) AS pages FROM docs WHERE text IS NOT NULL GROUP BY host),
boiler AS (SELECT l.host, l.line FROM lines l JOIN totals t ON l.host = t.host WHERE l.line <> ''
           GROUP BY l.host, l.line, t.pages HAVING count(*) - 1 > CAST({RATIO} AS DOUBLE) * (t.pages + {PRIOR})
           OR count(*) - 1 > CAST({LONG_RATIO} AS DOUBLE) * (t.pages + {LONG_PRIOR}) AND len(string_split_regex(l.line, '{_BLANKS}')) > {LONG_WORDS}),
placed AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM docs WHERE text IS NOT NULL),
kept AS (SELECT p.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
         coalesce(string_agg(p.line, chr(10) ORDER BY p.place) FILTER (WHERE b.line IS NULL), '') AS text
         FROM placed p LEFT JOIN boiler b ON p.host = b.host AND trim(p.line) = b.line GROUP BY p.doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped FROM docs d LEFT JOIN kept k USING (doc_id)
"""
