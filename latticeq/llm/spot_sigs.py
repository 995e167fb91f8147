"""SpotSigs fingerprints: signatures of content words that follow common words, compared as sets within partitions of set length.

A spot is a common word (the anchor) with the chain of content words that follow it; what stands between them, other anchors and
punctuation, is passed over. Where no common word stands among the few words before a content word, in lists, names and other languages, that
word is an anchor itself, so that every part of a text has spots and an edit touches only those around it. Texts are near when their sets of
spots are: lengths tell at once when a likeness cannot be reached, so sets are partitioned by length and only neighbouring partitions meet.
All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sampling

#: Common words of several languages, after which spots begin.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or our she that the their there they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella es esta este la las lo los más no o para pero por se su sus un una y "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht oder sich sie sind und von war wie wir zu zum zur "
    "ao com da dos e em foi mais na nas nem nos não os pela pelo que seu um uma "
    "che dei della delle di gli ha ho il nel nella non per più sono una "
    "aan dat een en het ik je maar met naar niet of ook op te van voor wat zijn"
).split()
#: Content words in a chain.
CHAIN = 2
#: A content word is an anchor if there is none among so many words before it.
GAP = 4
#: Likenesses under this are not told apart where the lengths of the sets exclude more.
LEAST = 0.05
#: Likeness of near copies.
NEAR = 0.75


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the sorted set of a text's signatures, 32-bit hashes of its spots, as the array column `out`.

    A text with words but without any spot has one signature, of all its words in order, one with other characters than blanks only one of
    them all; null, empty and blank texts have none. Texts are read whole. Columns that start with `out` and an underscore are made and taken away.
    """
    w, p, a, c, s = (f"{out}_{k}" for k in ("words", "placed", "anchors", "content", "spots"))
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}\p{M}]+", " "))
    step = df.withColumn(w, F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1)))
    step = step.withColumn(p, F.transform(w, lambda word, i: F.struct(i.alias("i"), word.alias("word"))))
    step = step.withColumn(c, F.filter(p, lambda x: ~x["word"].isin(*ANCHORS))).withColumn(a, F.filter(p, lambda x: x["word"].isin(*ANCHORS)))
    content = F.col(c)
    # a chain is known by the content words before it: i - j before the j-th anchor at place i, m + 1 before what follows the m-th content word
    chain = lambda word, n: F.when(n + CHAIN <= F.size(content), F.hash(word, *(F.get(content, n + k)["word"] for k in range(CHAIN))))
    lonely = lambda x, m: F.when(m < GAP, x["i"] == m).otherwise(F.get(content, m - GAP)["i"] == x["i"] - GAP)  # noqa: E731  the words before are content words
    spots = F.concat(F.transform(a, lambda x, j: chain(x["word"], x["i"] - j)), F.transform(c, lambda x, m: F.when(lonely(x, m), chain(x["word"], m + 1))))
    step = step.withColumn(s, F.array_compact(spots))
    words = F.col(w)
    alone = F.when(F.size(words) > 0, F.array(F.hash(F.array_join(words, " ")))).when(F.trim(F.regexp_replace(whole, r"\s+", " ")) != "", F.array(F.hash(whole))).otherwise(F.array().cast("array<int>"))
    return step.withColumn(out, F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(alone)).drop(w, p, a, c, s)


def fingerprint(signatures: str) -> Column:
    """The set as text: eight hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def partition_of(size: Column, threshold: float = NEAR) -> Column:
    """The partition of a set's length: sets of a likeness of at least the threshold are in the same or in neighbouring partitions."""
    return F.floor(F.log(size.cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")


def likeness(a: str, b: str, least: float = LEAST) -> Column:
    """Jaccard's measure of two sets of signatures; 0 without a look at them where the lengths exclude `least`, 1 for equal sets, two empty ones among them."""
    one, other = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when(F.col(a) == F.col(b), 1.0).when(F.least(one, other) < F.greatest(one, other) * least, 0.0).otherwise(common / (one + other - common))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and next_text, the text of the document with the next key; after the last comes the first. A null text is empty.

    Rows with equal keys follow each other in the order of their texts' hashes, null keys come first. Rows move once, to ranges of (key, hash); the first
    row of each range is dealt to the range before it as well.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    placed = sampling.ranged(own, ["key", "h"], "part", ties=False)
    firsts = placed.groupBy("part").agg(F.min(F.struct("key", "h")).alias("first"))
    ring = Window.orderBy("part")  # a row for each range
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy(F.lit(1)))))
    joined = placed.join(F.broadcast(firsts), "part")
    ends = F.when(F.col("first") == F.struct("key", "h"), F.struct(F.col("before").alias("part"), F.lit(1).alias("end")))
    dealt = joined.select("key", "text", "h", F.explode(F.array_compact(F.array(F.struct("part", F.lit(0).alias("end")), ends))).alias("x"))
    order = Window.partitionBy("x.part").orderBy("x.end", "key", "h")
    return dealt.select("key", "text", F.lead("text").over(order).alias("next_text"), F.col("x.end").alias("end")).where("end = 0").select("key", "text", "next_text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint and partition of every text, the fingerprint of the same text after an edit, and how near it is to that and to the next one.

    The edit replaces the last quarter of a text's characters by the first as many of the next document's. A null text is empty: it has an
    empty fingerprint, which equals only that of texts without any character but blanks. Repeated rows are fingerprinted each; a table of one
    row is its own next; an empty table gives no rows; other columns are not looked at.
    """
    step = with_next(docs, key, text)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    step = step.withColumns({"n_chars": n.cast("bigint"), "edited": F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))})
    for name, out in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        step = with_signatures(step, name, out)
    size = F.size("own").cast("bigint")
    return step.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"), size.alias("n_signatures"), F.when(size > 0, partition_of(size)).alias("partition"),
    )


def search(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = NEAR) -> DataFrame:
    """query, match and near: the least key of each different set of signatures in docs that is at least as near to a query as the threshold.

    Equal sets are one class, known by its least key, so copies are not compared. Sets of that likeness share a signature among the first
    n - threshold * n + 1 of either, and lie in neighbouring partitions: rows meet on both, then whole sets decide. Texts without signatures match nothing.
    """
    def sets(df: DataFrame) -> DataFrame:
        signed = with_signatures(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "s").where(F.size("s") > 0)
        return signed.groupBy("s").agg(F.min("key").alias("key")).withColumn("p", partition_of(F.size("s"), threshold))

    def heads(df: DataFrame, name: str, reach: tuple[int, ...]) -> DataFrame:
        first = F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * threshold - 1e-9).cast("int") + 1)
        placed = df.select(F.col("key").alias(name), first.alias("first"), F.explode(F.array(*(F.col("p") + r for r in reach))).alias("p"))
        return placed.select(name, "p", F.explode("first").alias("x"))

    classes = sets(docs)
    asked = sets(queries)
    pairs = heads(asked, "query", (-1, 0, 1)).join(heads(classes, "match", (0,)), ["x", "p"]).select("query", "match").distinct()
    full = pairs.join(asked.select(F.col("key").alias("query"), F.col("s").alias("a")), "query").join(classes.select(F.col("key").alias("match"), F.col("s").alias("b")), "match")
    return full.withColumn("near", likeness("a", "b", threshold)).where(F.col("near") >= threshold).select("query", "match", "near")
