"""URL filter: rules on hosts and paths, and for all other URLs the ratio of two variable-order Markov models of characters.

The models are learnt from the URLs that rules accept and reject. A character's probability blends all orders: at each order the counts
after the context are interpolated with the lower order by Witten-Bell weights, down to a uniform choice. A URL is accepted if the
log-likelihood under the accepted model less that under the rejected one, per character, reaches a threshold calibrated on URLs left out
of the models.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of context at most.
ORDER = 6
#: URLs of each verdict that the models are fitted on at most, each whole. Judging has no bounds.
SAMPLE = 20_000
ALPHABET = 256


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and the paths that start with a path."""

    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty for a null url or one without '://'."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class MarkovModel:
    """Counts of bytes after contexts of every length up to an order."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}

    def learn(self, text: bytes) -> None:
        for i, byte in enumerate(text):
            for k in range(min(i, self.order) + 1):
                after = self.counts.setdefault(text[i - k : i], {})
                after[byte] = after.get(byte, 0) + 1

    def logs(self, text: bytes) -> float:
        """Log-likelihood; an unseen context passes its weight on to the shorter one."""
        total, counts, order = 0.0, self.counts, self.order
        for i, byte in enumerate(text):
            p = 1 / ALPHABET
            for k in range(min(i, order) + 1):
                after = counts.get(text[i - k : i])
                if after is None:
                    break
                seen = after.get(-1)
                kinds, seen = (len(after), sum(after.values())) if seen is None else (len(after) - 1, seen)
                p = (after.get(byte, 0) + kinds * p) / (seen + kinds)
            total += math.log(p)
        return total


@dataclass
class UrlModel:
    accepted: MarkovModel = field(default_factory=MarkovModel)
    rejected: MarkovModel = field(default_factory=MarkovModel)
    threshold: float = 0.0

    def ratio(self, url: str | None) -> float:
        """Log-likelihood difference per character; 0 for an empty url."""
        text = (url or "").encode()
        return (self.accepted.logs(text) - self.rejected.logs(text)) / len(text) if text else 0.0


def fit(accepted: list[str], rejected: list[str], order: int = ORDER) -> UrlModel:
    """Models from four fifths of the URLs, by crc32, and the threshold that judges most of the rest rightly, both verdicts weighing alike."""
    model = UrlModel(MarkovModel(order), MarkovModel(order))
    left: list[tuple[str, bool]] = []
    for own, urls, kind in ((model.accepted, accepted, True), (model.rejected, rejected, False)):
        for url in sorted(set(urls)):
            if zlib.crc32(url.encode()) % 5:
                own.learn(url.encode())
            else:
                left.append((url, kind))
    values = sorted((model.ratio(url), kind) for url, kind in left)
    n, m = sum(kind for _, kind in values), sum(not kind for _, kind in values)
    if n and m:
        best, at = -1.0, 0.0
        below = [0, 0]
        for k in range(len(values) + 1):
            right = (n - below[1]) / n + below[0] / m
            low = values[k - 1][0] if k else values[0][0] - 0.1
            high = values[k][0] if k < len(values) else values[-1][0] + 0.1
            if right > best + 1e-12 and high > low:
                best, at = right, (low + high) / 2
            if k < len(values):
                below[values[k][1]] += 1
        model.threshold = at
    for own in (model.accepted, model.rejected):
        for after in own.counts.values():
            after[-1] = sum(after.values())  # the total, under a byte that no text has
    return model


def judge_urls(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null), verdict and ratio of every row of pages (page_id, url).

    Of rules of one length, the first given wins. A null or empty url, or one without '://', has no host and no rule; its ratio is 0 if
    it is empty. Without accepted or rejected URLs to learn from, that model knows nothing and gives all characters alike. Repeated rows
    are judged each, equal urls alike, and urls of any length whole; a ratio that equals the threshold is accepted; an empty table gives an empty table; other
    columns are left out.
    """
    host, path = host_and_path(F.col("url"))
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule = F.coalesce(*(F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.text)) for r in sorted(rules, key=lambda r: -len(r.text)))) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(*(F.when(F.col("rule") == r.text, F.lit(r.verdict)) for r in rules)) if rules else F.lit(None).cast("string")
    ruled = source.withColumn("rule", rule).withColumn("ruled", verdict)
    urls = {}
    for kind in ("allow", "block"):
        chosen = ruled.where(F.col("ruled") == kind).select("url").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
        urls[kind] = [row["url"] for row in chosen.collect()]
    model = pages.sparkSession.sparkContext.broadcast(fit(urls["allow"], urls["block"], order))  # grows with the characters of the sampled URLs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            ratios = np.array([own.ratio(url) for url in batch.column(1).to_pylist()], np.float64)
            said = [x if x is not None else "allow" if r >= own.threshold else "block" for x, r in zip(batch.column(5).to_pylist(), ratios, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(said, pa.string()), pa.array(ratios)], ["page_id", "host", "path", "rule", "verdict", "ratio"])

    return ruled.select("page_id", "url", "host", "path", "rule", "ruled").mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, ratio double")
