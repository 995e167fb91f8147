"""Toxicity by compression distance: windows of words compressed with zstandard dictionaries of toxic and of ordinary text.

The ordinary dictionary is trained on the windows of ordinary texts. Toxic dictionaries are trained on toxic texts, and stand behind the ordinary
one's content, so that both compress ordinary prose alike and a window's lengths differ only where toxic material matches. Most of a
toxic text is ordinary prose, so besides its whole windows its stretches that ordinary texts rarely hold are tried as samples: what is covered by runs
of RUN bytes that are in more toxic texts than chance allows. Several toxic dictionaries are trained; those that tell a validation part apart
best are used together. A text's share of windows whose lengths differ by a threshold or more, also chosen there, is calibrated to a
probability by isotonic regression.
"""

from __future__ import annotations

import contextlib
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, handing_back, mixed

#: Words in a window.
WINDOW = 10
#: Labelled texts of each class that a model is fitted on at most, each whole. Scoring has no bounds.
SAMPLE = 3000
ORDINARY_BYTES = 16_384
#: Bytes of a run, and how many times as frequent it is in toxic texts.
RUN, LEAST_LIFT = 8, 5.0
#: (bytes, segment length of the trainer, least z-score of a run or None for whole windows) of the toxic dictionaries that are tried; ENSEMBLE of them are used.
TRIED = (*product((768, 1280, 2048), (8, 10, 12), (5.0, 7.0, 9.0)), (1280, 12, None), (4096, 12, None))
ENSEMBLE = 4
THRESHOLD = 0.3

_TABLE = bytes(32 if chr(i) in string.punctuation + string.whitespace else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TABLE).split()


def windows(own: list[bytes], size: int | None = None) -> list[bytes]:
    size = size or WINDOW
    return [b" " + b" ".join(own[i : i + size]) + b" " for i in range(0, len(own), size)]


@dataclass
class Model:
    """Dictionary contents, the threshold of a window's difference, and the knots of the calibration. Without toxic dictionaries all score `prior`."""

    ordinary: bytes = b""
    toxic: list[bytes] = field(default_factory=list)
    threshold: int = 1
    shares: list[float] = field(default_factory=lambda: [0.0])
    scores: list[float] = field(default_factory=lambda: [0.0])

    def compressors(self) -> tuple[object, list[object]]:
        import zstandard

        longest = max(map(len, self.toxic), default=0)
        options = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, hash_log=17, chain_log=17, window_log=17, write_content_size=False, write_dict_id=False, write_checksum=False)

        def one(content: bytes) -> object:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=raw, compression_params=options)

        return one(self.ordinary + bytes(longest)), [one(self.ordinary + bytes(longest - len(x)) + x) for x in self.toxic]

    def differences(self, own: list[bytes], compressors: tuple) -> np.ndarray:
        ordinary, toxic = compressors[0].compress, [x.compress for x in compressors[1]]
        return np.array([len(toxic) * len(ordinary(w)) - sum([len(f(w)) for f in toxic]) for w in windows(own)], np.int64)

    def share(self, differences: np.ndarray) -> float:
        return float((differences >= self.threshold).sum()) / (len(differences) + 10)

    def score(self, share: float) -> float:
        return float(np.interp(share, self.shares, self.scores))


def _auc(values: np.ndarray, positive: np.ndarray) -> float:
    order, counts = np.unique(values, return_inverse=True)
    size = np.bincount(counts, minlength=len(order))
    rank = (np.cumsum(size) - (size - 1) / 2)[counts]
    n, m = positive.sum(), (~positive).sum()
    return float((rank[positive].sum() - n * (n + 1) / 2) / (n * m)) if n and m else 0.5


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: knots of a rising line through the pooled means."""
    pools: list[list[float]] = []
    for k in np.argsort(x, kind="stable"):
        pools.append([float(x[k]) * weight[k], float(y[k]) * weight[k], float(weight[k])])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]


#: Control characters, which prose does not hold.
_FILLER = bytes(range(1, 9)) + bytes(range(14, 28))


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The best `size` bytes of a trained dictionary's content, without its header, as all windows are coded alike.

    The trainer lays the most useful segments last, and its header pushes bytes off the end. So filler goes first among the samples, as that
    is what ends up last; it is taken out again.
    """
    import zstandard

    samples = sorted(samples, key=zlib.crc32)  # the trainer takes a segment from each stretch
    samples = [samples[k] for k in np.random.default_rng(0).permutation(len(samples))]
    room = max(2048, sum(map(len, samples)) // 2)
    filler = np.frombuffer(_FILLER, np.uint8)[np.random.default_rng(1).integers(0, len(_FILLER), room)].tobytes()
    first = [filler[i : i + 64] for i in range(0, room, 64) for _ in (0, 1)]
    content = b""
    with contextlib.suppress(zstandard.ZstdError):  # too few samples to train on
        trained = zstandard.train_dictionary(2 * size + 1024, first + samples, d=6, k=segment).as_bytes()
        content = trained.partition(b"\1\0\0\0\4\0\0\0\x08\0\0\0")[2].translate(None, _FILLER)[-size:]  # a header ends with three offsets
    return content or b"".join(dict.fromkeys(samples))[-size:]


def _joined(own: list[bytes]) -> bytes:
    return b" " + b" ".join(own) + b" "


#: Bits of the hash of a run: tables of counts have a fixed size.
CELLS = 24


def _cells(text: bytes) -> np.ndarray:
    """A hash of the RUN bytes at each place of a text."""
    codes = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(codes) - RUN + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(RUN):
        runs = runs << np.uint64(8) | codes[k : k + n]
    return (mixed(runs) >> np.uint64(64 - CELLS)).astype(np.int64)


def scores_of_runs(texts: list[tuple[bytes, bool]]) -> np.ndarray:
    """By hash, the z-score of the share of toxic texts with a run against that of ordinary ones; 0 where the lift is too low or but one toxic text has it."""
    counts = {kind: np.zeros(1 << CELLS, np.uint16) for kind in (True, False)}
    for own, kind in texts:
        cells = np.unique(_cells(own))
        counts[kind][cells] += counts[kind][cells] < np.iinfo(np.uint16).max
    n, m = (max(1, sum(kind is label for _, kind in texts)) for label in (True, False))
    out = np.zeros(1 << CELLS, np.float32)
    at = np.flatnonzero(counts[True] > 1)
    a, b = counts[True][at].astype(float), counts[False][at].astype(float)
    p = (a + b) / (n + m)
    out[at] = np.where(a / n >= LEAST_LIFT * b / m, (a / n - b / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12), 0)
    return out


def stretches(text: bytes, scores: np.ndarray, least: float) -> list[bytes]:
    """What is covered by runs that score least or more, runs no further apart than a run in one, with a byte more at both ends."""
    hit = np.flatnonzero(scores[_cells(text)] >= least)
    if not len(hit):
        return []
    cuts = np.flatnonzero(np.diff(hit) > RUN)
    starts, ends = np.append(hit[0], hit[cuts + 1]), np.append(hit[cuts], hit[-1]) + RUN
    return [text[max(0, i - 1) : j + 1] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def fit(toxic: list[str], ordinary: list[str], prior: float | None = None) -> Model:
    """A model from whole texts of both classes; prior: the part of toxic texts among all, if the samples do not show it. Texts of both classes count in both."""
    prior = len(toxic) / max(1, len(toxic) + len(ordinary)) if prior is None else prior
    texts = [(_joined(words(text)), label) for label, group in ((True, toxic), (False, ordinary)) for text in group]
    part = [zlib.crc32(own) % 3 == 0 for own, _ in texts]  # copies fall into one part
    learn, check = [x for x, p in zip(texts, part, strict=True) if not p], [x for x, p in zip(texts, part, strict=True) if p]
    if len({kind for _, kind in learn}) < 2 or len({kind for _, kind in check}) < 2:
        return Model(scores=[prior])
    content = _dictionary([w for own, kind in learn if not kind for w in windows(own.split(), 8)], ORDINARY_BYTES, 24)
    scores = scores_of_runs(learn)
    tried = []
    for least in dict.fromkeys(x for _, _, x in TRIED):  # the samples of one kind at a time
        toxic_texts = [own for own, kind in learn if kind]
        samples = [x for own in toxic_texts for x in (windows(own.split(), 8) if least is None else stretches(own, scores, least))]
        tried += [_dictionary(samples, size, segment) for size, segment, kind in TRIED if kind == least and samples]
    del scores, samples
    tried = [x for x in tried if x]
    if not tried:
        return Model(scores=[prior])
    told = np.array([kind for _, kind in check])
    # all candidates at once, each against the ordinary content
    every = Model(content, list(dict.fromkeys(tried)))
    base, others = every.compressors()
    gains = [np.array([[len(base.compress(w)) - len(f.compress(w)) for w in windows(own.split())] for f in others], np.int16).reshape(len(others), -1) for own, _ in check]
    single = [_auc(np.array([float((g[k] >= 2).sum()) / (g.shape[1] + 10) for g in gains]), told) for k in range(len(others))]
    best = sorted(range(len(others)), key=lambda k: -single[k])[:ENSEMBLE]
    model = Model(content, [every.toxic[k] for k in best])
    sums = [g[best].sum(0) for g in gains]
    del gains

    def shares(threshold: int) -> np.ndarray:
        return np.array([float((s >= threshold).sum()) / (len(s) + 10) for s in sums])

    model.threshold = max(range(1, 6 * len(best)), key=lambda t: _auc(shares(t), told))
    weight = np.where(told, prior / told.mean(), (1 - prior) / (1 - told.mean()))
    x, y = _isotonic(shares(model.threshold), told.astype(float), weight)
    top = max(x[-1], 1.0) + 1e-9
    model.shares, model.scores = [*x, top], [*(min(v, 0.999) for v in y), 1.0]
    return model


def fit_on(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Model:
    """A model fitted on documents whose label (doc_id, toxic 0 or 1) is known and whose crc32(doc_id as text) modulo folds is not held_out.

    At most `sample` labels of each class, by hash of the id, with their whole texts, which the driver holds; the class shares come from all
    labels. Where a document has several labels, the greatest counts; of several rows with one id, the text with the least hash counts, so that two
    samples of texts are all that reaches the driver; null labels, ids and texts and empty texts are left out. Without texts of both classes, the model scores all alike.
    """
    known = labels.where((crc_bucket("doc_id", folds) != held_out) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    chosen = None
    for kind in (0, 1):
        own = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select("doc_id", "text").where(F.length("text") > 0)
    own = texts.join(F.broadcast(chosen), "doc_id")
    rows = own.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()  # two samples at most
    rows = sorted({(row["doc_id"], row["toxic"], row["text"]) for row in rows})
    total = sizes.get(0, 0) + sizes.get(1, 0)
    return fit([t for _, kind, t in rows if kind == 1], [t for _, kind, t in rows if kind != 1], sizes.get(1, 0) / max(1, total))


def _scored(docs: DataFrame, model: Model, schema: str | object, result) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dictionaries of ORDINARY_BYTES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, compressors = shared.value, None
        for batch in batches:
            compressors = compressors or own.compressors()
            texts = batch.column(batch.schema.get_field_index("text"))
            scores: list[float] = []
            for low in range(0, batch.num_rows, 512):
                for text in texts.slice(low, 512).to_pylist():
                    scores.append(own.score(own.share(own.differences(words(text), compressors)) if own.toxic else 0.0))
            yield result(batch, pa.array(scores, pa.float64()))

    return docs.mapInArrow(handing_back(run), schema)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text), from all windows of its whole text.

    The score of a null or empty text is that of a text without any toxic window; equal texts score alike; repeated rows are scored each;
    null ids stay null; an empty table gives an empty table; other columns, whatever their names, are left out.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(source, model, "doc_id bigint, score double", lambda batch, scores: pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (text) without the rows that score threshold or more; all columns stay, nothing is shuffled.

    Null and empty texts score as texts without any toxic window; repeated rows stay or go alike; an empty table gives an empty table.
    """
    import pyarrow.compute as pc

    return _scored(docs, model, docs.schema, lambda batch, scores: batch.filter(pc.less(scores, threshold)))
