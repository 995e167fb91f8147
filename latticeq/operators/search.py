"""All-against-all search, ranked lists, re-ranking and retrieval evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import kernels
from ..functions.udfs import spread
from ..sources.shared import stored
from . import sampling

#: Vectors of a cell of the pruned search, and queries and targets that a task scores at a time.
BLOCK, STRIP, COLUMNS = 8192, 256, 4096
#: Queries of a block of the blocked search: as many blocks as PARALLEL while they hold FEWEST, and never more queries than MOST. Targets come together, as many as GATHERED such blocks hold.
FEWEST, MOST, PARALLEL, GATHERED = 4096, 32768, 24, 4
#: Queries and targets of a row of work where every pair is a row of the result.
ASKING, ANSWERING = 1024, 4096
#: Residues of a block of structures.
RESIDUES = 16384


def top_k(scored: DataFrame, k: int, query: str = "query", target: str = "target", score: str = "score") -> DataFrame:
    """The k best targets of each query but itself, with their rank from 1; ties go to the lesser target. Spark limits each group before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(target))
    return scored.where(F.col(query) != F.col(target)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_pairs(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """query, target and cosine of every pair of (id, vec): the plain form, for a small set of queries.

    Vectors are packed into blocks of queries and of targets, a pair of blocks is one row of work, and scores leave it in strips: rows grow with
    the pairs, memory does not. The score is null where a vector is, holds a null, or is of another length.
    """
    kind = {side: df.schema["id"].dataType for side, df in (("query", queries), ("target", targets))}
    out = StructType([*(StructField(side, k) for side, k in kind.items()), StructField("score", DoubleType())])

    def packed(df: DataFrame, name: str, blocks: int) -> DataFrame:
        row = F.struct(F.col("id"), F.col("vec").cast("array<double>").alias("vec"))
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(name)).agg(F.collect_list(row).alias(f"{name}_rows"))  # a block

    def vectors(rows: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, unit vectors filled with zeros to one length, and their lengths, -1 of those that hold a null."""
        ids, vec = rows.field("id"), rows.field("vec")
        length = np.asarray(vec.value_lengths().fill_null(-1)).copy()
        flat = vec.flatten()
        at = np.repeat(np.arange(len(length)), np.maximum(length, 0))
        values = np.zeros((len(length), max(length.max(initial=0), 1)))
        values[at, np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0), np.maximum(length, 0))] = flat.fill_null(0).to_numpy(zero_copy_only=False)
        length[at[np.asarray(flat.is_null())]] = -1
        return ids, values / (np.sqrt((values**2).sum(1, keepdims=True)) + 1e-9), length

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (ids, a, in_a), (others, b, in_b) = (vectors(batch.column(c)[row].values) for c in (0, 1))
                wide = min(a.shape[1], b.shape[1])  # beyond, one side is filled
                for part in kernels.strips(len(a), len(b)):
                    n = part.stop - part.start
                    score = np.round(a[part, :wide] @ b[:, :wide].T, 6) + 0.0
                    good = (in_a[part, None] == in_b) & (in_b >= 0)
                    column = pa.array(score.ravel(), mask=None if good.all() else ~good.ravel())
                    sides = [ids.take(pa.array(np.repeat(np.arange(part.start, part.stop), len(b)))), others.take(pa.array(np.tile(np.arange(len(b)), n)))]
                    yield pa.RecordBatch.from_arrays([*sides, column], out.names)

    blocks = max(1, -(-targets.count() // ANSWERING))
    a = packed(queries, "a", max(1, -(-queries.count() // ASKING))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return spread(a.join(packed(targets, "b", blocks), "b"), "a", "b").select("a_rows", "b_rows").mapInArrow(scored, out)


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as a matrix of unit rows."""
    vec = np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.zeros((0, 1))
    return vec / (np.sqrt((vec**2).sum(1, keepdims=True)) + 1e-9)


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id among the distinct ids in order, so that ids of any type are compared as numbers."""
    return np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)


def _nearest_of(ids: pa.ChunkedArray, place: np.ndarray, vec: np.ndarray, queries: np.ndarray, targets: np.ndarray, k: int, least: np.ndarray | None = None) -> list[pa.Table]:
    """query, target and score of the k nearest among `targets` of each of `queries`, both numbers of rows; with `least`, only scores that reach the query's own.

    Targets pass in runs of COLUMNS. Single precision tells which can be among a query's k best so far, with a margin for its error and for the rounding of
    scores; only those are scored in double precision.
    """
    out = []
    targets = targets[np.argsort(place[targets], kind="stable")]
    among, single, margin = place[targets], vec[targets].astype(np.float32), 2e-6 + 1.2e-7 * vec.shape[1]
    first = min(len(targets), max(2048, 4 * k))  # a few tell the first bounds
    room, marks = np.empty(STRIP * max(first, COLUMNS), np.float32), np.empty(STRIP * max(first, COLUMNS) + 8, bool)  # one run's scores, and which reach the bounds
    for at in range(0, len(queries) if len(targets) else 0, STRIP):
        q = queries[at : at + STRIP]
        own = vec[q].astype(np.float32)
        own_low, own_high = np.searchsorted(among, place[q], "left"), np.searchsorted(among, place[q], "right")
        bound = np.full(len(q), -np.inf) if least is None else least[q] - margin
        rows, cols, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        parts, waiting, low, high = [], 0, 0, first
        while low < len(targets):
            cells, width = len(q) * (high - low), high - low
            scores = np.matmul(own, single[low:high].T, out=room[:cells].reshape(len(q), width))
            for row in np.flatnonzero((own_low < high) & (own_high > low)):
                scores[row, max(own_low[row] - low, 0) : own_high[row] - low] = -np.inf  # not itself
            if low == 0 and k < width:
                bound = np.fmax(bound, -np.partition(-scores, k - 1, axis=1)[:, k - 1].astype(float) - margin)
            marks[cells : cells + 8] = False
            np.greater_equal(scores, np.maximum(bound, -3).astype(np.float32)[:, None], out=marks[:cells].reshape(len(q), width))
            eights = np.flatnonzero(marks[: -(-cells // 8) * 8].view(np.uint64)) * 8  # few are set, so eight are looked at together
            found = (eights[:, None] + np.arange(8))[marks[: -(-cells // 8) * 8].reshape(-1, 8)[eights // 8]]
            r, c = np.divmod(found, width)
            parts.append((r, c + low, room[found]))
            waiting += len(r)
            low, high = high, min(len(targets), high + COLUMNS)
            if waiting > len(q) * k // 2 or low >= len(targets):  # the bounds rise with what has been found
                rows, cols, values = (np.concatenate([x, *y]) for x, y in zip((rows, cols, values), zip(*parts, strict=True), strict=True))
                parts, waiting = [], 0
                order = np.argsort(rows * 8.0 - values)
                starts, ends = np.searchsorted(rows[order], np.arange(len(q)), "left"), np.searchsorted(rows[order], np.arange(len(q)), "right")
                full = np.flatnonzero(ends - starts >= k)
                bound[full] = np.fmax(bound[full], values[order[starts[full] + k - 1]].astype(float) - margin)
                kept = values >= bound[rows]
                rows, cols, values = rows[kept], cols[kept], values[kept]
        score = np.round(np.clip((vec[q[rows]] * vec[targets[cols]]).sum(1), -1, 1), 6)
        if least is not None:
            kept = score >= least[q[rows]]
            rows, cols, score = rows[kept], cols[kept], score[kept]
        order = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
        rows, cols, score = rows[best], cols[best], score[best]
        out.append(pa.table({"query": ids.take(pa.array(q[rows])), "target": ids.take(pa.array(targets[cols])), "score": score}))
    return out


def _pairs_schema(vectors: DataFrame) -> StructType:
    kind = vectors.schema["id"].dataType
    return StructType([StructField("query", kind), StructField("target", kind), StructField("score", DoubleType())])


def _tables(parts: list[pa.Table], kind: pa.DataType) -> pa.Table:
    return pa.concat_tables(parts) if parts else pa.schema([("query", kind), ("target", kind), ("score", pa.float64())]).empty_table()


def blocked_top_k(vectors: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """The k nearest by cosine of every vector (id, vec): query, target, score, rank. Ids are of any type that has an order.

    Vectors get a block by hash. A group of a task has one block of queries and MOST * GATHERED targets at most on average, multiplies strips of the one with runs of the
    other and keeps k targets a query, so what leaves a task grows with queries and gathered blocks, not with pairs. A vector moves once for each block and
    each gathering of blocks: n * n / MOST rows, and k * n * n / (MOST * GATHERED) hits, when all pairs are compared. Null vectors are left out.
    """
    own = vectors.where("id is not null and vec is not null")
    gathered = -(-(blocks or 0) // GATHERED)
    if not blocks:
        n = own.count()
        blocks, gathered = max(1, -(-n // MOST), min(-(-n // FEWEST), PARALLEL)), max(1, -(-n // (MOST * GATHERED)))
    placed = own.select("id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = placed.select("id", "vec", F.lit(True).alias("asks"), F.col("block").alias("qb"), every(gathered).alias("tb"))
    targets = placed.select("id", "vec", F.lit(False).alias("asks"), every(blocks).alias("qb"), (F.col("block") % gathered).alias("tb"))

    def nearest(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id"), table.column("asks").to_numpy(zero_copy_only=False)
        return _tables(_nearest_of(ids, _places(ids), _unit_rows(table.column("vec")), np.flatnonzero(asks), np.flatnonzero(~asks), k), ids.type)

    return top_k(queries.unionByName(targets).groupBy("qb", "tb").applyInArrow(nearest, _pairs_schema(vectors)), k)


class Pruned(NamedTuple):
    """Hits of a pruned search, and how many pairs of cells were compared of how many there are."""

    hits: DataFrame
    visited: int
    pairs: int


#: Cells of a pruned search hold CELL_ROOT * sqrt(n) vectors on average, BLOCK at most; pivots reach every task, so there are MOST_PIVOTS at most, and cells are parted beyond that.
CELL_ROOT, MOST_PIVOTS = 8, 4096


def pruned_top_k(vectors: DataFrame, k: int, pivots: int | None = None) -> Pruned:
    """As blocked_top_k, with the same rows, but cells that cannot hold a hit are not looked at.

    Angles between unit vectors obey the triangle inequality. Every vector belongs to the cell of its nearest pivot. A first round compares each
    cell with itself and with the nearest cells until they hold k others; the k-th score of a query then bounds what any hit must reach. A
    cell whose pivot is farther from a query than that angle and the cell's radius together holds none. Pairs of cells that some query needs are
    compared in a second round, in which only such queries take part. How much is skipped depends on the data: clustered vectors skip
    most pairs, evenly spread ones of many dimensions none, and then blocked_top_k moves fewer rows. Null vectors are left out.
    """
    spark = vectors.sparkSession
    own = stored(vectors.where("id is not null and vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec")))
    n = own.count()
    pivots = pivots or min(MOST_PIVOTS, max(1, round(n / min(BLOCK, CELL_ROOT * max(n, 1) ** 0.5))))
    chosen = own.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(pivots).select("vec").toArrow()  # MOST_PIVOTS vectors at most
    centre = _unit_rows(chosen.column("vec"))
    kind = vectors.schema["id"].dataType

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = np.clip(_unit_rows(batch.column(1)) @ centre.T, -1, 1)
            cell = cos.argmax(1)
            angle = np.arccos(cos[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "vec", "cell", "angle"])

    schema = StructType([StructField("id", kind), StructField("vec", ArrayType(DoubleType())), StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    placed = own.mapInArrow(assigned, schema) if n else spark.createDataFrame([], schema)
    # a cell of more vectors than a task should hold is parted by hash; its parts have one pivot and radius
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    parted = placed.join(F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))), "cell")  # a row for each pivot
    placed = stored(parted.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts", "angle"))
    cells = {row["cell"]: (row["n"], row["radius"]) for row in sizes.collect()}  # a row for each pivot
    parts = sorted((row["cell"], row["part"]) for row in placed.select("cell", "part").distinct().collect())
    number = {x: i for i, x in enumerate(parts)}
    used = sorted(cells)
    radius = np.array([cells[c][1] for c in used])
    apart = np.arccos(np.clip(centre[used] @ centre[used].T, -1, 1)) if used else np.zeros((0, 0))
    first: set[tuple[int, int]] = set()
    for i, c in enumerate(used):
        held = 0
        for j in np.argsort(apart[i], kind="stable"):
            first.add((c, used[j]))
            held += cells[used[j]][0]
            if held > k:
                break

    def compared(pairs: set[tuple[int, int]], bounds: DataFrame | None) -> DataFrame:
        """query, target and score for the pairs of cells (query's, target's), one task for each pair of parts."""
        rows = [(number[a, pa_], number[b, pb], a, pa_, b, pb) for a, pa_ in parts for b, pb in parts if (a, b) in pairs]
        plan = spark.createDataFrame(rows, "qn int, tn int, a int, pa int, b int, pb int")
        asked = placed if bounds is None else placed.join(bounds, "id")
        queries = asked.join(F.broadcast(plan), (F.col("cell") == F.col("a")) & (F.col("part") == F.col("pa")))  # pairs of cells: no more than the square of MOST_PIVOTS
        targets = placed.join(F.broadcast(plan), (F.col("cell") == F.col("b")) & (F.col("part") == F.col("pb")))
        least = F.lit(-2.0) if bounds is None else F.col("least")
        both = queries.select("qn", "tn", "id", "vec", F.lit(True).alias("asks"), least.alias("least")).unionByName(targets.select("qn", "tn", "id", "vec", F.lit(False).alias("asks"), F.lit(0.0).alias("least")))

        def nearest(table: pa.Table) -> pa.Table:
            ids, asks = table.column("id"), table.column("asks").to_numpy(zero_copy_only=False)
            return _tables(_nearest_of(ids, _places(ids), _unit_rows(table.column("vec")), np.flatnonzero(asks), np.flatnonzero(~asks), k, table.column("least").to_numpy()), ids.type)

        return both.groupBy("qn", "tn").applyInArrow(nearest, _pairs_schema(vectors))

    near = stored(top_k(compared(first, None), k).drop("rank")) if used else compared(first, None)
    reached = near.groupBy("query").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found"))
    bounds = stored(placed.select("id", "vec", "cell").join(reached, F.col("id") == F.col("query"), "left").select("id", "vec", "cell", F.when(F.col("found") >= k, F.col("kth")).otherwise(-2.0).alias("least")))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.arccos(np.clip(_unit_rows(batch.column(0)) @ centre[used].T, -1, 1))
            bound = np.cos(np.maximum(angle - radius, 0)) + 2e-6  # scores are rounded to six places
            row, col = np.nonzero(bound >= batch.column(2).to_numpy()[:, None])
            a, b = batch.column(1).to_numpy()[row], np.array(used, np.int32)[col]
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))], ["a", "b"])

    wanted = bounds.select("vec", "cell", "least").mapInArrow(needs, "a int, b int").distinct() if used else spark.createDataFrame([], "a int, b int")
    second = {(row["a"], row["b"]) for row in wanted.collect()} - first  # pairs of cells
    found = near.unionByName(compared(second, bounds.select("id", "least"))) if second else near
    return Pruned(top_k(found, k), len(first) + len(second), len(used) ** 2)


def block_side(total: int, cells: int) -> int:
    """Residues of a block of structures that have so many in all: a residue moves total / side times for each side of its pairs."""
    return min(RESIDUES, max(1, int(cells**0.5 / 2), -(-total // PARALLEL)))


def matrix_scores(structures: DataFrame, queries: Column | None = None, cells: int = 1 << 24, temperature: float = 0.1) -> DataFrame:
    """query, target and the statistics of their residue matrix for every ordered pair of structures (id, vecs: a vector for each residue).

    The matrix of a pair holds the cosines of all residues of one with all of the other; row_best, row_soft, col_best, col_soft and mean_all are the
    means of its rows' and columns' greatest and softly weighted entries, and of all. Structures are sorted by length and cut into blocks, and a task has one
    block of queries and one of targets, so a structure moves once for each block: blocks hold half of the square root of `cells` residues while they are
    no more than PARALLEL, and never more than RESIDUES, or one longer structure besides. A task multiplies a query with runs of targets that make about `cells`
    entries; the matrix of a longer pair is made in strips. No matrix leaves a task. `queries` says which structures ask; without it, all do. Ids are of
    any type that has an order; structures without residues are left out.
    """
    own = stored(structures.where("id is not null and size(vecs) > 0").select("id", "vecs", F.size("vecs").cast("bigint").alias("length"), (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("asks")))
    total = own.agg(F.sum("length")).first()[0] or 0
    side = block_side(total, cells)  # a block may reach as far again into the next one
    # places in the order of lengths: what lies before a structure tells its block
    ordered = sampling.numbered(own.select("id", "length", "asks"), ["length", "id"], "place")
    placed = stored(sampling.running(ordered, "place", "length", "before").withColumn("block", F.floor((F.coalesce("before", F.lit(0)) + F.col("length") - 1) / side).cast("bigint")))
    blocks = placed.groupBy("block").agg(F.max("asks").alias("asks"))
    plan = blocks.where("asks").select(F.col("block").alias("qb")).join(blocks.select(F.col("block").alias("tb")))  # a row for each task
    located = own.join(placed.select("id", "block"), "id")
    ask = located.where("asks").join(plan, F.col("block") == F.col("qb")).select("qb", "tb", "id", "vecs", F.lit(True).alias("asks"))
    answer = located.join(plan, F.col("block") == F.col("tb")).select("qb", "tb", "id", "vecs", F.lit(False).alias("asks"))
    names = ["row_best", "row_soft", "col_best", "col_soft", "mean_all"]
    kind = structures.schema["id"].dataType
    schema = StructType([StructField("query", kind), StructField("target", kind), *(StructField(name, DoubleType()) for name in names)])

    def scored(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id")
        vecs = table.column("vecs").combine_chunks()
        lengths = np.asarray(vecs.value_lengths())
        unit_ = _unit_rows(vecs.flatten())
        starts = np.cumsum(lengths) - lengths
        targets, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        t = np.concatenate([unit_[starts[k] : starts[k] + lengths[k]] for k in targets]) if len(targets) else unit_[:0]
        width, ends = lengths[targets], np.cumsum(lengths[targets])
        found = np.zeros((5, len(asking), len(targets)))
        for row, q in enumerate(asking):
            one, low = unit_[starts[q] : starts[q] + lengths[q]], 0
            while low < len(targets):  # a run of targets whose residues make about `cells` entries with the query's
                first = ends[low] - width[low]
                high = max(low + 1, int(np.searchsorted(ends, first + cells // len(one), "right")))
                other = t[first : ends[high - 1]]
                if temperature < 0.01 or len(one) * len(other) > max(cells, kernels.CELLS):
                    for k in range(low, high):
                        found[:, row, k] = kernels.product_statistics(one, t[ends[k] - width[k] : ends[k]], temperature)[[0, 2, 1, 3, 4]]
                else:
                    found[:, row, low:high] = kernels.run_statistics(one, other, ends[low:high] - width[low:high] - first, temperature)
                low = high
        both = [ids.take(pa.array(np.repeat(asking, len(targets)))), ids.take(pa.array(np.tile(targets, len(asking))))]
        return pa.table(dict(zip(["query", "target", *names], [*both, *(np.round(x.ravel(), 6) + 0.0 for x in found)], strict=True)))

    return ask.unionByName(answer).groupBy("qb", "tb").applyInArrow(scored, schema).where("query <> target")


def rerank(hits: DataFrame, new_score: str, head: int) -> DataFrame:
    """The first `head` hits of each query by a new score, ties in their old order, then the others as they were; rank is replaced."""
    in_head = F.col("rank") <= head
    order = Window.partitionBy("query").orderBy(in_head.desc(), F.when(in_head, F.col(new_score)).desc_nulls_last(), F.col("rank"))
    return hits.withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank")


def _head(ranked: DataFrame, top: int) -> DataFrame:
    return ranked.where(F.col("rank") <= top).select("query", "target")


def _reordered(ranked: DataFrame, scores: DataFrame, top: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, query, target, score, rank: the head by new scores (by, query, target, score), ties in their old order, and the tail as it was. Only queries with scores."""
    lists = scores.select(*by, "query").distinct()
    own = ranked.select("query", "target", F.col("score").alias("_old"), "rank").join(lists, "query").join(scores, [*by, "query", "target"], "left")
    in_head = F.col("rank") <= top
    order = Window.partitionBy(*by, "query").orderBy(in_head.desc(), F.when(in_head, F.col("score")).desc_nulls_last(), F.col("rank"))
    return own.select(*by, "query", "target", F.when(in_head, F.col("score")).otherwise(F.col("_old")).alias("score"), F.row_number().over(order).alias("rank"))


def _best_list(hits: DataFrame, domains: DataFrame, by: tuple[str, ...]) -> dict | None:
    """The list with the greatest mean sensitivity, superfamily first, then family, then the order of the lists' columns."""
    means = sensitivity(hits, domains, by).groupBy(*by).agg(F.avg("superfamily").alias("superfamily"), F.avg("family").alias("family"))
    found = means.orderBy(F.col("superfamily").desc_nulls_last(), F.col("family").desc_nulls_last(), *by).first()  # a row for each setting
    return None if found is None else found.asDict()


def graded_settings(ranked: DataFrame, residues: DataFrame, views: list[str], domains: DataFrame, settings: list[tuple[float, float, float]], tuning: Column, top: int) -> DataFrame:
    """shift, open, extend, family, superfamily and place of every setting of the local alignment: mean sensitivities of a list re-ranked under it.

    The first place has the greatest mean, superfamily first, then family, then the order of the settings. Only queries where `tuning` holds are aligned; a
    pair's matrix is made once for all settings.
    """
    from ..functions import udfs

    keys = ("shift", "open", "extend")
    scores = udfs.part_grid(stored(_head(ranked, top).where(tuning)), stored(udfs.parts(residues, *views)), settings, views)
    judged = sensitivity(_reordered(ranked, scores, top, keys), domains, keys)
    means = judged.groupBy(*keys).agg(*(F.round(F.avg(level), 6).alias(level) for level in ("family", "superfamily")))
    order = Window.orderBy(F.col("superfamily").desc_nulls_last(), F.col("family").desc_nulls_last(), *keys)  # a row for each setting
    return means.withColumn("place", F.row_number().over(order))


def rerank_variants(ranked: dict[str, DataFrame], residues: DataFrame, variants: dict[str, tuple[str, list[str]]], domains: DataFrame, settings: list[tuple[float, float, float]], weights: list[float], tuning: Column, top: int) -> DataFrame:
    """variant, query, target, score and rank: the lists of all queries, re-ranked by local alignment under each variant.

    ranked: hit lists (query, target, score, rank) by name; residues: id and a column of residue vectors for each view; variants: the list that each
    re-ranks and the views whose standardised matrices it averages. Settings (shift, open, extend) are chosen for each variant on the queries
    where `tuning` holds, by mean sensitivity. 'blend' mixes the first variant's alignment scores with its list's own, both as z-scores within a
    query, by the weight that does best. Tails keep their order. Pairs are aligned under all settings at once; only a row for each setting
    reaches the driver.
    """
    from ..functions import udfs

    keys = ("shift", "open", "extend")
    out, first = None, None
    parts = stored(udfs.parts(residues, *dict.fromkeys(v for _, views in variants.values() for v in views)))
    for name, (source, views) in variants.items():
        pairs = stored(_head(ranked[source], top))
        tuned = _reordered(ranked[source], udfs.part_grid(pairs.where(tuning), parts, settings, views), top, keys)
        best = _best_list(tuned, domains, keys) or dict(zip(keys, settings[0], strict=True))
        scores = stored(udfs.part_grid(pairs, parts, [tuple(best[k] for k in keys)], views).select("query", "target", F.round("score", 5).alias("score")))
        first = first or (source, scores)
        own = _reordered(ranked[source], scores, top).select(F.lit(name).alias("variant"), "query", "target", "score", "rank")
        out = own if out is None else out.unionByName(own)
    source, scores = first
    both = scores.withColumn("a", z_score("score")).drop("score").join(ranked[source].where(F.col("rank") <= top).withColumn("b", z_score("score")).select("query", "target", "b"), ["query", "target"])
    mixed = both.withColumn("weight", F.explode(F.array(*(F.lit(float(w)) for w in weights)))).select("weight", "query", "target", F.round(F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b"), 5).alias("score"))
    mixed = stored(mixed)
    best = _best_list(_reordered(ranked[source], mixed.where(tuning), top, ("weight",)), domains, ("weight",)) or {"weight": weights[0]}
    blend = _reordered(ranked[source], mixed.where(F.col("weight") == best["weight"]).drop("weight"), top)
    return out.unionByName(blend.select(F.lit("blend").alias("variant"), "query", "target", "score", "rank"))


def z_score(x: str, key: str = "query", eps: float = 1e-12) -> Column:
    own = Window.partitionBy(key)
    return (F.col(x) - F.avg(x).over(own)) / (F.stddev_pop(x).over(own) + eps)


def level_sizes(domains: DataFrame) -> DataFrame:
    """domains (id, family, superfamily, fold) with the sizes of their levels, and whether each level has another member of its own."""
    for level in ("family", "superfamily", "fold"):
        domains = domains.withColumn(f"n_{level}", F.count(F.lit(1)).over(Window.partitionBy(level)))
    return domains.withColumn("eligible", (F.col("n_family") > 1) & (F.col("n_superfamily") > F.col("n_family")) & (F.col("n_fold") > F.col("n_superfamily")))


def resolved(hits: DataFrame, domains: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """hits (query, target, rank): known queries only, the first of each target, no self hits, with both sides' levels; a target may be unknown. by: columns that tell lists apart."""
    levels = ["family", "superfamily", "fold"]
    q = domains.select(F.col("id").alias("query"), *(F.col(c).alias(f"q_{c}") for c in levels))
    t = domains.select(F.col("id").alias("target"), *(F.col(c).alias(f"t_{c}") for c in levels))
    best = hits.groupBy(*by, "query", "target").agg(F.min("rank").alias("rank")).where("query <> target")
    return best.join(q, "query").join(t, "target", "left")


def _level_hits(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    same = {c: F.coalesce(F.col(f"q_{c}") == F.col(f"t_{c}"), F.lit(False)) for c in ("family", "superfamily", "fold")}
    flags = {"family": same["family"], "superfamily": same["superfamily"] & ~same["family"], "fold": same["fold"] & ~same["superfamily"]}
    return rows.groupBy(*by, "query").agg(*(F.sum(flag.cast("bigint")).alias(f"hit_{c}") for c, flag in flags.items()))


def sensitivity(hits: DataFrame, domains: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per eligible query, the part of each level found before the first false positive; levels exclude the narrower ones.

    A target outside the domains or of another fold is a false positive. Denominators of superfamily and fold are one more than the
    number of members, as in the measure's published form. by: columns that tell several lists of a query apart, each judged on its own.
    """
    rows = resolved(hits, domains, by)
    wrong = F.coalesce(F.col("q_fold") != F.col("t_fold"), F.lit(True))
    running = F.sum(wrong.cast("int")).over(Window.partitionBy(*by, "query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    found = _level_hits(rows.withColumn("_fp", running).where("_fp = 0"), by)
    base = level_sizes(domains).where("eligible").select(F.col("id").alias("query"), "n_family", "n_superfamily", "n_fold")
    if by:
        base = base.crossJoin(F.broadcast(hits.select(*by).distinct()))  # a row for each list: settings or methods
    base = base.join(found, [*by, "query"], "left")
    sizes = {"family": F.col("n_family") - 1, "superfamily": F.col("n_superfamily") - F.col("n_family") + 1, "fold": F.col("n_fold") - F.col("n_superfamily") + 1}
    return base.select(*by, "query", *(F.round(F.coalesce(F.col(f"hit_{c}"), F.lit(0)) / n, 6).alias(c) for c, n in sizes.items()))


def recall_at(hits: DataFrame, domains: DataFrame, k: int) -> DataFrame:
    """Per eligible query, the part of each level among the first k hits, over the true numbers of members."""
    found = _level_hits(resolved(hits.where(F.col("rank") <= k), domains))
    base = level_sizes(domains).where("eligible").select(F.col("id").alias("query"), "n_family", "n_superfamily", "n_fold").join(found, "query", "left")
    sizes = {"family": F.col("n_family") - 1, "superfamily": F.col("n_superfamily") - F.col("n_family"), "fold": F.col("n_fold") - F.col("n_superfamily")}
    return base.select("query", *(F.round(F.coalesce(F.col(f"hit_{c}"), F.lit(0)) / n, 6).alias(c) for c, n in sizes.items()))


def paired_bootstrap(scores: DataFrame, draws: int, a: str = "a", b: str = "b") -> DataFrame:
    """Mean difference of paired scores (query, a, b), the 95 % interval of resampled means, and wins.

    Draw d takes as its i-th query the one whose number is md5(d|i) modulo the number of queries: the same draws on any cluster. Draws are a
    stated set; each is summed on its own after a join on the query's number.
    """
    own = stored(scores.select("query", (F.col(a) - F.col(b)).alias("diff")))
    n = max(own.count(), 1)
    places = sampling.numbered(own, ["query"], ties=False)
    picks = scores.sparkSession.range(draws * n).select((F.col("id") / n).cast("bigint").alias("draw"), (F.col("id") % n).alias("i"))
    key = F.concat_ws("|", F.col("draw").cast("string"), F.col("i").cast("string"))
    picks = picks.select("draw", (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % n).alias("number"))
    means = picks.join(places, "number").groupBy("draw").agg(F.avg("diff").alias("mean"))  # a row for each draw
    interval = means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))
    whole = own.agg(F.round(F.avg("diff"), 6).alias("difference"), F.sum((F.col("diff") > 0).cast("bigint")).alias("wins_a"), F.sum((F.col("diff") < 0).cast("bigint")).alias("wins_b"))
    return whole.crossJoin(interval)  # two rows


#: Rows of a range of the split bootstrap, and picks that a task holds at once.
RANGE_ROWS, PICKS = 1 << 16, 1 << 22


def picked(n: int, at: int, size: int, draws: int, seed: int) -> np.ndarray:
    """How many of n picks each draw takes from range `at` of the ranges of `size` rows: a multinomial, split in halves from the whole down.

    The split of a node is drawn by numbers that (seed, node) fixes, for all draws together, so every range finds its own part by itself and all parts of a
    draw sum to n.
    """
    low, high, node = 0, -(-n // size), 1
    count = np.full(draws, n, np.int64)
    while high - low > 1:
        half = (low + high) // 2
        first, last = low * size, min(n, high * size)
        left = np.random.Generator(np.random.Philox(key=[seed, node])).binomial(count, (half * size - first) / (last - first))
        low, high, count, node = (low, half, left, 2 * node) if at < half else (half, high, count - left, 2 * node + 1)
    return count


def split_bootstrap(scores: DataFrame, draws: int, a: str = "a", b: str = "b", seed: int = 1, size: int = RANGE_ROWS) -> DataFrame:
    """As paired_bootstrap, for many draws: no row moves for a draw.

    Queries get places in order and ranges of `size` places. A task has whole ranges: how many picks of each draw fall into a range is known from
    the range's number alone, the picks are drawn in place, and their sums leave the range, a number for each draw. So draws * n / size
    rows are shuffled instead of draws * n, and the draws are the same on any cluster.
    """
    own = stored(sampling.numbered(scores.select("query", (F.col(a) - F.col(b)).alias("diff")), ["query"], "place", ties=False))
    n = own.count()

    def totals(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        diff, at = table.column("diff").to_numpy()[order], table.column("range")[0].as_py()
        counts = picked(n, at, size, draws, seed)
        rng = np.random.Generator(np.random.Philox(key=[seed + 1, at]))
        out = np.zeros(draws)
        step = max(1, PICKS // max(1, int(counts.mean())))
        for low in range(0, draws, step):
            part = counts[low : low + step]
            sums = np.append(0, np.cumsum(diff[rng.integers(0, len(diff), int(part.sum()))]))
            ends = np.cumsum(part)
            out[low : low + step] = sums[ends] - sums[ends - part]
        return pa.table({"draw": pa.array(np.arange(draws, dtype=np.int32)), "total": out})

    ranges = own.withColumn("range", F.floor(F.col("place") / size).cast("bigint"))
    means = ranges.groupBy("range").applyInArrow(totals, "draw int, total double").groupBy("draw").agg((F.sum("total") / n).alias("mean"))  # a row for each draw
    interval = means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))
    whole = own.agg(F.round(F.avg("diff"), 6).alias("difference"), F.sum((F.col("diff") > 0).cast("bigint")).alias("wins_a"), F.sum((F.col("diff") < 0).cast("bigint")).alias("wins_b"))
    return whole.crossJoin(interval)  # two rows
