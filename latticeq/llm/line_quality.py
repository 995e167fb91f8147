"""Line-first cleaning: rules on punctuation, navigation and boilerplate for each line, then a verdict on what the document has lost."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A document is kept if its good lines hold this part of the characters of its lines at least.
LEAST_KEPT = 0.5
#: Phrases of boilerplate, looked for in short lines.
BOILERPLATE = ("all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service", "javascript", "subscribe", "sign in", "sign up", "click here", "powered by", "licensed under", "released under")
#: Lines as long as this are not taken for boilerplate phrases or menus.
SHORT_LINE = 200
MENU_ENTRY = 20
_BLANKS = " \t\n\x0b\x0c\r"


def _count(text: Column, characters: str) -> Column:
    """How often characters occur. One search for each: a byte search is many times faster than a look-up of every character."""
    left = functools.reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), characters, text)
    return F.length(text) - F.length(left)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) != ""


def good_lines(lines: Column, any_symbol: Column) -> Column:
    """Of an array of lines those that break no rule. any_symbol: whether a line may have a symbol at all; most texts have none, so no line is searched.

    Punctuation: a tenth of its characters or more are symbols, a twentieth or more (and three at least) are exclamation marks, or it is
    shouted: 20 characters or more with letters, none of them lower case. Navigation: it has two bars or more, or under 20 characters
    and no sentence mark. Boilerplate: under 200 characters and with a stock phrase. What several rules read is made once for each line.
    """

    def fails(x: Column) -> Column:
        line, lower, long, shouts = x["line"], x["lower"], x["long"], x["shouts"]
        punctuation = (any_symbol & (_count(line, SYMBOLS) * 10 >= long)) | ((shouts >= 3) & (shouts * 20 >= long)) | ((long >= 20) & (lower != line) & (F.upper(line) == line))
        navigation = (any_symbol & (_count(line, "|") >= 2)) | ((long < MENU_ENTRY) & ~line.rlike("[.!?:;…]"))
        boilerplate = (long < SHORT_LINE) & functools.reduce(lambda a, b: a | b, (F.contains(lower, F.lit(phrase)) for phrase in BOILERPLATE))
        return punctuation | navigation | boilerplate

    read = F.transform(lines, lambda line: F.struct(line.alias("line"), F.lower(line).alias("lower"), F.length(line).alias("long"), _count(line, "!").alias("shouts")))
    return F.transform(F.filter(read, lambda x: ~fails(x)), lambda x: x["line"])


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of the base rules, clean_text (the good lines, a repeated line once), base_failed and kept.

    A line counts if it has a word; a line equal to an earlier one fails. A document is kept if it passes the base rules and its good
    lines hold half of the characters of its lines. A null or empty text has no words, so it fails the base rules; repeated rows are judged
    each; a text of any length is read whole; an empty table gives an empty table; columns of docs keep their values, but those with names of the results,
    which are replaced. All is done within a row: no shuffle, no Python. Windows are compared by 64-bit hashes within a text.
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
    own = [c for c in docs.columns if c not in results]
    # the caller's columns travel in one struct, so that no name can clash
    row = F.struct(*(F.col(f"`{c}`") for c in own)) if own else F.struct(F.lit(None).alias("none"))
    step = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    # words and their hashes; each later column is read more than once, so Catalyst keeps the projections apart and computes each once
    spaced = functools.reduce(lambda x, blank: F.replace(x, F.lit(blank), F.lit(" ")), _BLANKS[1:], F.col("_t"))
    step = step.withColumn("_words", F.split(spaced, " ", -1))
    step = step.withColumn("_h", F.array_remove(F.transform("_words", lambda word: F.xxhash64(word)), F.xxhash64(F.lit(""))))
    step = step.withColumn("_lines", F.filter(F.split("_t", "\n", -1), _has_word))
    h = F.col("_h")
    # a window's hash from those of two pairs of words and a word: 64-bit hashes of words, each shifted by its place
    both = lambda k: lambda x, y: x.bitwiseXOR(F.shiftleft(y, k))
    shifted = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
    word_twice = (F.size(h) > WINDOW) & (F.size(F.array_distinct(h)) < F.size(h))
    step = step.withColumn("_2", F.when(word_twice, F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), shifted(h, 1), both(1))))
    pairs = F.col("_2")
    pair_twice = F.size(F.array_distinct(pairs)) < F.size(pairs)  # else no window can be there twice, nor if no run of four is
    step = step.withColumn("_4", F.when(pair_twice, F.zip_with(F.slice(pairs, 1, F.greatest(F.size(pairs) - 2, F.lit(0))), shifted(pairs, 2), both(2))))
    fours = F.col("_4")
    window = F.zip_with(F.slice(fours, 1, F.greatest(F.size(fours) - 1, F.lit(0))), shifted(h, WINDOW - 1), both(WINDOW - 1))
    four_twice = F.size(F.array_distinct(fours)) < F.size(fours)
    step = step.withColumn("_w", F.when(four_twice, window).otherwise(F.array().cast("array<bigint>"))).withColumn("_unique", F.array_distinct("_lines"))
    w = F.col("_w")
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))  # many times faster than array_sort, whose comparator is a lambda
    step = step.withColumn("_s", F.when(F.size(F.array_distinct(w)) < F.size(w), placed))
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["x"] == x["x"]) | (F.coalesce(F.get(s, i + 1)["x"] == x["x"], F.lit(False))))
    step = step.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    unique = F.col("_unique")
    step = step.withColumn("n_symbols", _count(F.col("_t"), SYMBOLS).cast("bigint"))
    good = good_lines(unique, F.col("n_symbols") > 0)
    step = step.withColumns(
        {
            "n_words": F.size(h).cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(unique)).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
            "_good": good,
            "_all": F.aggregate("_lines", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)),
        }
    )
    left = F.aggregate("_good", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    step = step.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    step = step.withColumn("kept", ~F.col("base_failed") & (left >= F.lit(LEAST_KEPT) * F.col("_all"))).withColumn("clean_text", F.array_join("_good", "\n"))
    return step.select(*(F.col("_row").getField(c).alias(c) for c in own), *results)


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, string_split(t, chr(10)) AS l FROM docs),
placed AS (SELECT doc_id, i, CAST(list_slice(w, i, i + {WINDOW - 1}) AS VARCHAR[]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM placed) WHERE n > 1),
covered AS (SELECT doc_id, CAST(sum(least({WINDOW}, i - coalesce(last, i - {WINDOW}))) AS BIGINT) AS n FROM twice GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(l) AS line FROM words) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
uniq AS (SELECT doc_id, line, count(*) AS times, length(line) AS long, length(line) - length(replace(line, '!', '')) AS shouts FROM lines GROUP BY doc_id, line),
judged AS (SELECT doc_id, CAST(sum(times) - count(*) AS BIGINT) AS n_dup_lines, sum(times * long) AS total,
  coalesce(sum(long) FILTER (WHERE NOT (
    (long - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 10 >= long OR (shouts >= 3 AND shouts * 20 >= long) OR (long >= 20 AND upper(line) = line AND lower(line) <> line)
    OR long - length(replace(line, '|', '')) >= 2 OR (long < {MENU_ENTRY} AND NOT regexp_matches(line, '[.!?:;…]'))
    OR (long < {SHORT_LINE} AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')))), 0) AS good
  FROM uniq GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(j.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  coalesce(j.total, 0) AS total, coalesce(j.good, 0) AS good
  FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN judged j USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND good >= CAST({LEAST_KEPT} AS DOUBLE) * total AS kept FROM base
"""
