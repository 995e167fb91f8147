"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

Nothing grows on the driver and no bucket emits its pairs. Documents with one shingle set are one class from the start. Each class first
meets the two centres, out of three in each of its buckets, that it shares most buckets with; verified links are united. In crowded buckets
this goes on with other centres, while a round still halves the members outside the largest component of their bucket. What then holds
several components is worked through in blocks of bounded size: a task gets a block of members outside the largest component and another
block of the bucket, with their sets, and compares what lies in different components, each pair in its first common bucket only. So
every candidate pair is either verified on its full sets or already connected. For a bucket of n members, k of them outside its largest
component, about n + k * n / BLOCK rows move: in proportion to n where copies hang together, and with the square of n, divided by BLOCK,
only where many texts share a bucket but are no copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHasher, chunks, handing_back, mixed, shingle_hashes, shuffle_width, stored, worker_cache

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 32 bands of 4: a pair at similarity 0.75 is missed with probability 5e-6, at 0.8 with 5e-8.
BANDS, ROWS = 32, 4
#: Members of a bucket in one block, and bytes of their sets, on average.
BLOCK, BLOCK_BYTES = 512, 8_000_000
#: Buckets of fewer members get no further rounds of centres.
CROWD = 64


def super_min_hash(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash of distinct 64-bit elements: m values, each a rank (high 32 bits) and a fraction (low 32 bits).

    Every element walks a random permutation of the m places, and offers place p_j the value j + r_j. All elements take step j at once;
    a step beyond the largest rank in the signature cannot lower it, so most sets stop after one or two.
    """
    signature = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = np.uint64(0xFFFFFFFF)
    for at in range(0, len(elements), 1 << 14):
        part = elements[at : at + (1 << 14)]
        walks = None
        for j in range(m):
            if j and (int(signature.max()) >> 32) < j:
                break
            drawn = mixed(part + np.uint64((GOLDEN * (j + 1)) % (1 << 64)))
            chosen = (((drawn & low) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
            if j == 0:
                first, place = chosen, chosen
            else:
                if walks is None:
                    walks = np.tile(np.arange(m, dtype=np.uint16), (len(part), 1))
                    rows = np.arange(len(part))
                    walks[rows, first] = 0
                place = walks[rows, chosen].astype(np.int64)
                walks[rows, chosen] = walks[:, j]
            np.minimum.at(signature, place, (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32)))
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, as signed integers."""
    parts = signature.reshape(bands, rows)
    keys = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    for k in range(rows):
        keys = mixed(keys ^ parts[:, k])
    return keys.view(np.int64)


class Shingler:
    """Sorted distinct shingle hashes of texts. A-Z count as a-z; words are split at ASCII white space."""

    def __init__(self, size: int = SHINGLE) -> None:
        self._size, self._hasher = size, WordHasher()

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        data = [(text or "").encode().lower() for text in texts]
        for i, j in chunks(data):
            part = data[i:j]
            starts, _, words = self._hasher.spans(b" ".join(part))
            ends = np.cumsum([len(x) + 1 for x in part])
            cuts = np.searchsorted(starts, ends)
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                yield np.unique(shingle_hashes(words[a:b], self._size))


def _shingler(size: int) -> Shingler:
    return worker_cache(("shingler", size), lambda: Shingler(size))


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, and keys of the bands; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(size)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                ids, counts, digests, keys = batch.column(0).slice(low, 512), [], [], []
                for own in shingler.sets(batch.column(1).slice(low, 512).to_pylist()):
                    counts.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    keys.append(band_keys(super_min_hash(own, bands * rows), bands, rows) if len(own) else None)
                arrays = [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "keys"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(handing_back(run), "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id and the sorted shingle hashes as binary, for docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(size)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                sets = [own.tobytes() for own in shingler.sets(batch.column(1).slice(low, 512).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 512), pa.array(sets, pa.binary())], ["id", "own"])

    return docs.select("id", "text").mapInArrow(handing_back(run), "id bigint, own binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"))
    other = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    return pairs.select("a", "b").join(own, "a").join(other, "b").select("a", "b", "own_a", "own_b").mapInArrow(handing_back(run), "a bigint, b bigint")


def _united(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find with path halving; the root of a group is its least member."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by a star for each group that they join; a block of edges at a time, so memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _united(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            stars = [(x, r) for x, r in found.items() if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(handing_back(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id and component (its least id) of every node of edges (a, b): union-find within partitions, then alternating stars between them.

    Each round hangs every neighbour of a node on the least one; rounds end when every edge leads to a root, after about the logarithm of the
    longest path. Aggregations are minima, combined before the shuffle; edges are written to the shared folder between rounds.
    """
    edges = stored(_forest(edges).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: a node moves from each lesser neighbour to that one's least neighbour
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        # small star: a node and its lesser neighbours move to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(stars).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = stored(small)
        nodes = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        unsettled = nodes.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 or (ups > 0 and root = 0)")
        if not unsettled.limit(1).count():
            roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


class _Postings:
    """Sizes of the intersections of one set with each of many: an inverted index of their elements."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self._sets = sets
        sizes = np.array([len(x) for x in sets])
        elements = np.concatenate(sets)
        order = np.argsort(elements, kind="stable")
        self._elements, self._owners = elements[order], np.repeat(np.arange(len(sets)), sizes)[order]

    def common(self, own: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self._elements, own, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self._owners[at], minlength=len(self._sets))


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between different parts, as (a, b) of parts. members: key, low, high, within, block, part, keys, own; sorted by key, low, high.

    Each task's rows come group by group; a group holds the blocks low and high of a bucket. Members of low are compared with those of
    high, and with each other if the group is also the one in which that is done.
    """

    def links(group: list[dict]) -> Iterator[tuple[int, int]]:
        key, low, high, within = (group[0][x] for x in ("key", "low", "high", "within"))
        part, block = (np.array([x[name] for x in group]) for name in ("part", "block"))
        if part.min() == part.max():
            return
        keys = np.array([x["keys"] for x in group], np.int64)
        sets = [np.frombuffer(x["own"], np.uint64) for x in group]
        n = np.array([len(x) for x in sets])
        postings = None
        joined: dict[int, int] = {}

        def find(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for i in np.flatnonzero(block == low).tolist():
            ok = (part != part[i]) & (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n)
            ok &= (block == high) | (within & (block == low))
            ok[: i + 1] &= block[: i + 1] != low
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            equal = keys[at] == keys[i]
            at = at[keys[i][equal.argmax(1)] == key]
            at = at[[find(int(part[j])) != find(int(part[i])) for j in at.tolist()]] if joined and len(at) else at
            if not len(at):
                continue
            if len(at) < 8:
                linked = np.array([_similar(sets[i], sets[j], percent) for j in at.tolist()])
            else:
                postings = postings or _Postings(sets)
                common = postings.common(sets[i])[at]
                linked = 100 * common >= percent * (n[at] + n[i] - common)
            for j in at[linked].tolist():
                p, q = find(int(part[i])), find(int(part[j]))
                if p != q:
                    joined[max(p, q)] = min(p, q)
                    yield max(p, q), min(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None

        def result() -> pa.RecordBatch:
            found = list(links(group)) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for row in batch.slice(at, 512).to_pylist():
                    own = (row["key"], row["low"], row["high"])
                    if own != last:
                        yield result()
                        group, last = [], own
                    group.append(row)
        yield result()

    return members.mapInArrow(handing_back(run), "a bigint, b bigint")


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = np.concatenate([one, other])
    both.sort(kind="stable")  # merges two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _placed(members: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with their component as part, their id if they have none; and a row for each key of several parts: its largest part, members and bytes of sets there and elsewhere."""
    placed = members.join(known, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("part"))
    size = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")]
    buckets = placed.groupBy("key", "part").agg(*size).groupBy("key").agg(F.max(F.struct("m", "part", "t")).alias("x"), F.sum("m").alias("m"), F.sum("t").alias("t")).where("x.m < m")
    rest = (F.col("m") - F.col("x.m")).alias("m_rest"), (F.col("t") - F.col("x.t")).alias("t_rest")
    return placed, buckets.select("key", F.col("x.part").alias("top"), F.col("x.m").alias("m_top"), F.col("x.t").alias("t_top"), *rest)


def _centre_pairs(members: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """(a, b): for each of members (key, id, n, part, top) two of its buckets' centres, in other parts, that it shares most buckets with.

    A bucket's centres are its least member and two by hash. In later rounds, with a seed, only members outside the bucket's largest part, top, look for
    centres, and two of these are in it.
    """
    pair = F.struct(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
    drawn = [F.min_by(pair, F.xxhash64("id", F.lit(seed), F.lit(k)) if not seed or k == 2 else F.when(F.col("part") == F.col("top"), F.xxhash64("id", F.lit(seed), F.lit(k)))) for k in range(3)]
    centres = members.groupBy("key").agg((drawn[0] if seed else F.min(pair)).alias("c0"), drawn[1].alias("c1"), drawn[2].alias("c2"))
    centres = centres.select("key", F.explode(F.array_distinct(F.array("c0", "c1", "c2"))).alias("c")).select("key", "c.*")
    near = (F.col("n") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("n") * percent)
    looking = members.where("part <> top") if seed else members
    tries = looking.join(centres, "key").where((F.col("part") != F.col("pb")) & near).groupBy("id", "b").agg(F.count(F.lit(1)).alias("k"))
    best = tries.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "b")), asc=False).alias("c"))  # three for each band at most
    return best.select(F.col("id").alias("a"), F.explode(F.slice("c", 1, 2)).alias("c")).select("a", "c.b")


def linked_classes(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """id and component of every class (id, n, keys) that is linked with another one. docs: (id, text) of the classes at least."""
    rows = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    members = stored(rows.join(shared, "key", "left_semi"))
    ids = members.select("id").distinct()
    sets = stored(shingle_sets(docs.join(ids.hint("shuffle_hash"), "id", "left_semi"), size))
    links = stored(verified(_centre_pairs(members.withColumn("part", F.col("id")), percent), sets, percent))  # written first: two Python steps in one stage would need twice the workers
    known = stored(components(links))
    seed, before = 1, None
    while True:
        placed, buckets = _placed(members, known)
        buckets = stored(buckets)
        crowded = buckets.where(F.col("m_top") + F.col("m_rest") >= CROWD)
        outside = crowded.agg(F.sum("m_rest")).first()[0] or 0
        if not outside or before is not None and 2 * outside > before:
            break
        links = stored(verified(_centre_pairs(placed.join(crowded.select("key", "top"), "key"), percent, seed), sets, percent))
        stars = known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        known, seed, before = stored(components(stars.unionByName(links))), seed + 1, outside
    number = [F.ceil(F.greatest(F.col(f"m_{x}") / BLOCK, F.col(f"t_{x}") * 8 / BLOCK_BYTES)).alias(f"{x}s") for x in ("top", "rest")]
    blocks = placed.join(buckets.select("key", "top", *number), "key")
    is_top = F.col("part") == F.col("top")
    block = F.when(is_top, F.col("rests") + F.pmod(F.xxhash64("id"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rests")))
    # blocks of the rest come first; a block of the rest meets the others of the rest and all of the largest part, the first of these together with itself
    other = F.when(is_top, F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("rests") + F.col("tops") - 1))
    blocks = blocks.withColumn("block", block).withColumn("other", F.explode(other)).where("block <> other")
    blocks = blocks.select("key", "id", "part", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.greatest("block", "other") == F.col("rests")).alias("within"))
    full = blocks.join(sets, "id").join(classes.select("id", "keys"), "id")
    grouped = full.repartition(shuffle_width(docs.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = stored(_block_links(grouped, percent))
    top = components(links)
    renamed = top.select(F.col("id").alias("component"), F.col("component").alias("top"))
    moved = known.join(renamed, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return moved.unionByName(top.join(known, "id", "left_anti"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id reachable by links), kept.

    Texts with fewer words than a shingle are one shingle; null, empty and blank texts have none and are linked with nothing. Rows with
    the same doc_id and text give the same row each; with different texts they are one document with the links of all; with a null doc_id, a row has no links, a null component_id and is kept. An empty
    table gives an empty table; other columns are left out.
    """
    signed = stored(signatures(docs, size, bands, rows))
    own = signed.where("digest is not null and doc_id is not null")
    classes = stored(own.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min_by("n_shingles", "doc_id").alias("n"), F.min_by("keys", "doc_id").alias("keys")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    wanted = classes.select("id", "digest")
    component = linked_classes(texts, classes, percent, size)
    found = wanted.join(component, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    alone = F.col("doc_id").isNull() | F.col("digest").isNull()  # no key for a join, so all of them would meet in one task
    without = signed.where(alone).select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    joined = signed.where(~alone).select("doc_id", "n_shingles", "digest").join(found, "digest").drop("digest").unionByName(without)
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) without the near copies: of each group the document with the least doc_id stays, whatever the order of the rows. All columns stay as they are.

    Null, empty and blank texts and null ids are in no group and stay; repeated rows of the kept id all stay; an empty table gives an empty table.
    """
    dropped = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
