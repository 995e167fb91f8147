"""What several operators share: tables in the shared folder, words as bytes, hashes of words and shingles."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words, as in [^\x20\x09-\x0D]+.
WORD = r"[^\x20\x09-\x0D]+"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLDEN = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; in a local session without one, a new temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='latticeq-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Rows that a Python worker gets at once while a table is written: whole texts or sets of shingles, so some megabytes.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_WRITING = threading.Lock()
_writers, _before = 0, None


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """The session's Arrow batches hold BATCH_ROWS rows while any table is written; the last writer restores what was set."""
    global _writers, _before
    with _WRITING:
        if not _writers:
            _before = spark.conf.get(_BATCH, None)
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        _writers += 1
    try:
        yield
    finally:
        with _WRITING:
            _writers -= 1
            if not _writers and _before is None:
                spark.conf.unset(_BATCH)
            elif not _writers:
                spark.conf.set(_BATCH, _before)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives a lost executor. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/latticeq-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


_CACHE: dict[tuple, object] = {}


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that a worker that serves many stages holds no earlier one's."""
    if key not in _CACHE:
        _CACHE.clear()
        hand_back()
        _CACHE[key] = make()
    return _CACHE[key]


def hand_back() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def handing_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over Arrow batches, with the worker's free memory given back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return wrapped


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once: a polynomial over random byte values, from prefix sums modulo 2^64."""

    LIMIT = 1 << 20

    def __init__(self) -> None:
        self._value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
        self._blank = np.zeros(256, bool)
        self._blank[[9, 10, 11, 12, 13, 32]] = True
        base = 0xD1342543DE82EF95
        self._power = self._powers(base, self.LIMIT)
        self._inverse = self._powers(pow(base, -1, 1 << 64), self.LIMIT)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def words(self, data: bytes) -> np.ndarray:
        """A hash for each word of data, in order."""
        return self.spans(data)[2]

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (exclusive) and hash of each word of data."""
        codes = np.frombuffer(data, np.uint8)
        blank = np.concatenate([[True], self._blank[codes], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64)
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # in runs of whole words that fit the tables of powers
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + self.LIMIT, "right")))
            if ends[to - 1] - low > self.LIMIT:
                hashes[at] = self._long(codes[low : ends[at]])
            else:
                part = self._value[codes[low : ends[to - 1]]] * self._power[: ends[to - 1] - low]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
                s, e = starts[at:to] - low, ends[at:to] - low
                hashes[at:to] = mixed((sums[e] - sums[s]) * self._inverse[s] + (e - s).astype(np.uint64))
            at = to
        return starts, ends, hashes

    def _long(self, codes: np.ndarray) -> np.uint64:
        """A single word longer than the tables: its blocks' sums, combined."""
        total = 0
        for k in range(0, len(codes), self.LIMIT):
            block = codes[k : k + self.LIMIT]
            total = (total * GOLDEN + int((self._value[block] * self._power[: len(block)]).sum(dtype=np.uint64))) % (1 << 64)
        return mixed(np.array([(total + len(codes)) % (1 << 64)], np.uint64))[0]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of `size` words; with fewer words, one for the whole sequence; none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(min(len(words), size)))
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            out += words[k : k + n] * np.uint64((GOLDEN * (2 * k + 3)) % (1 << 64) | 1)
        return mixed(out)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about `limit` bytes in all; a longer text stands alone."""
    i, total = 0, 0
    for j, text in enumerate(texts):
        if j > i and total + len(text) > limit:
            yield i, j
            i, total = j, 0
        total += len(text) + 1
    if i < len(texts):
        yield i, len(texts)
