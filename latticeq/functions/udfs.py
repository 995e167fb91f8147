"""Arrow wrappers that run the kernels over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from . import exprs, kernels


LABEL = ["gw_raw", "fgw_raw", "fgw_feature_term"]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt evenly to tasks: rows that a kernel works on for milliseconds are few bytes, so Spark would put them into few partitions."""
    spark = df.sparkSession
    width = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(width, *keys)


def label_records(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, error, gw_raw, fgw_raw, fgw_feature_term and label of rows (keys, x, y, fx, fy): points and features of two patches as arrays of arrays.

    Patches of equal sizes are solved together, 64 at a time or as many as make CELLS cells. A row that cannot be labelled says why and has nulls: a side is missing, points and
    features differ in number, or points are no numbers.
    """
    own = pairs.select(*keys, "x", "y", "fx", "fy")
    out = StructType([*own.select(*keys).schema.fields, *(StructField(c, StringType()) for c in ("status", "error")), *(StructField(c, DoubleType()) for c in LABEL)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[matrix(value) for value in batch.column(batch.schema.get_field_index(c))] for c in ("x", "y", "fx", "fy")]
            errors = [label_error(*row) for row in zip(*sides, strict=True)]
            found: dict[int, tuple] = {}
            sizes: dict[tuple, list[int]] = {}
            for k, error in enumerate(errors):
                if error is None:
                    sizes.setdefault((len(sides[0][k]), len(sides[1][k])), []).append(k)
            for (n, m), rows in sizes.items():
                step = min(64, max(1, kernels.CELLS // (n * m)))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    labels = kernels.local_labels(*(np.stack([side[k] for k in part]) for side in sides))
                    found |= {k: tuple(round(float(labels[name][i]), 5) + 0.0 for name in LABEL) for i, k in enumerate(part)}
            nothing = (None,) * len(LABEL)
            columns = [pa.array([("error" if e else "ok") for e in errors], pa.string()), pa.array(errors, pa.string())]
            columns += [pa.array([found.get(k, nothing)[c] for k in range(len(errors))], pa.float64()) for c in range(len(LABEL))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *columns], out.names)

    return spread(own, *keys).mapInArrow(run, out).withColumn("label", F.round(exprs.similarity(F.col("gw_raw")), 5))


def matrix(value: pa.Scalar) -> np.ndarray | None:
    """A list of lists of one length, or what `packed` made of it, as a matrix, without Python objects; None for null, empty or ragged ones."""
    if pa.types.is_binary(value.type):
        return _unpacked(value.as_buffer()) if value.is_valid else None
    rows = value.values if value.is_valid else None
    if rows is None or not len(rows) or rows.null_count:
        return None
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(rows), -1) if len(flat) % len(rows) == 0 and len({*rows.value_lengths().to_pylist()}) == 1 else None


def as_bytes(v: np.ndarray | None) -> bytes | None:
    """Width of a number and length of a row, then the numbers."""
    if v is None:
        return None
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    own = single if np.array_equal(single, v, equal_nan=True) else v
    return np.array([own.itemsize, v.shape[1]], np.int64).tobytes() + own.tobytes()


def _unpacked(value: pa.Buffer) -> np.ndarray:
    width, length = np.frombuffer(value, np.int64, 2)
    return np.frombuffer(value, np.float32 if width == 4 else np.float64, offset=16).reshape(-1, length).astype(float)


def pooled(df: DataFrame, view: str) -> DataFrame:
    """id and vec, the sum of the vectors of a view, one after the other."""
    out = StructType([df.schema["id"], StructField("vec", ArrayType(DoubleType()))])

    def total(v: np.ndarray | None) -> list[float] | None:
        if v is None:
            return None
        own = np.zeros((1, v.shape[1]))
        for rows in kernels.strips(*v.shape):
            own = np.add.accumulate(np.concatenate([own, v[rows]]))[-1:]
        return own[0].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([total(matrix(x)) for x in batch.column(1)], pa.list_(pa.float64()))], out.names)

    return df.select("id", view).mapInArrow(run, out)


def label_error(x: np.ndarray | None, y: np.ndarray | None, fx: np.ndarray | None, fy: np.ndarray | None) -> str | None:
    if any(v is None for v in (x, y, fx, fy)):
        return "missing patch"
    if len(x) != len(fx) or len(y) != len(fy):
        return "points and features differ in number"
    if not all(np.isfinite(v).all() for v in (x, y, fx, fy)):
        return "not a number"
    return None


def local_alignments(pairs: DataFrame, shift: float, open_: float, extend: float) -> DataFrame:
    """query, target and the local alignment score of the standardised similarity of their residue vectors a and b (arrays of arrays)."""
    return alignment_grid(pairs, [(shift, open_, extend)]).select("query", "target", "score")


def alignment_grid(pairs: DataFrame, settings: list[tuple[float, float, float]], sides: list[tuple[str, str]] | None = None) -> DataFrame:
    """query, target, shift, open, extend and score of pairs (query, target, and columns of residue vectors).

    sides: the columns of both sides for each view, ('a', 'b') by default. A pair's matrix, the mean of its views' standardised ones, is made in strips of
    rows, which all settings align together, so a task holds some rows of it. Pairs without residues are left out.
    """
    sides = sides or [("a", "b")]
    ids = [pairs.schema[c].dataType for c in ("query", "target")]
    out = StructType([*(StructField(c, kind) for c, kind in zip(("query", "target"), ids, strict=True)), *(StructField(c, DoubleType()) for c in ("shift", "open", "extend", "score"))])
    names = list(dict.fromkeys(c for pair in sides for c in pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = {c: matrix(batch.column(batch.schema.get_field_index(c))[k]) for c in names}
                if all(v is not None for v in own.values()):
                    yield _scored(batch.select([0, 1]).slice(k, 1), own, settings, sides)

    return spread(pairs.select("query", "target", *names), "query", "target").mapInArrow(run, out)


def _scored(pair: pa.RecordBatch, own: dict[str, np.ndarray], settings: list[tuple[float, float, float]], sides: list[tuple[str, str]]) -> pa.RecordBatch:
    """A pair's score under each setting, from the matrices of its sides, which are made unit rows in their place."""
    for v in own.values():
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
    strips = zip(*(kernels.standardised_strips(own[a], own[b]) for a, b in sides), strict=True)
    lines = (line for views in strips for line in sum(views) / len(sides))
    scores = kernels.local_scores(lines, len(own[sides[0][1]]), settings)
    columns = [x.take(pa.array(np.zeros(len(settings), np.int32))) for x in pair.columns]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.float64()) for c in (*zip(*settings, strict=True), scores))], ["query", "target", "shift", "open", "extend", "score"])


#: Residues of a part of a structure.
PART = 2048


def parts(df: DataFrame, *views: str) -> DataFrame:
    """id, part and the views of some residues of each structure, as bytes; a view that is no matrix is null in one part."""
    own = StructType([df.schema["id"], StructField("part", LongType()), *(StructField(v, BinaryType()) for v in views)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [matrix(c[k]) for c in batch.columns[1:]]
                for number in range(max(-(-len(v) // PART) if v is not None else 1 for v in sides)):
                    cut = [None if v is None or len(v) <= number * PART else v[number * PART : (number + 1) * PART] for v in sides]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([number]), *(pa.array([as_bytes(v)], pa.binary()) for v in cut)], own.names)

    return df.select("id", *views).mapInArrow(run, own)


def part_grid(pairs: DataFrame, own: DataFrame, settings: list[tuple[float, float, float]], views: list[str]) -> DataFrame:
    """As alignment_grid, for pairs (query, target) of structures that come in `parts`: a row in a shuffle is a part of one side, and a task has one pair whole at a time."""
    ids = [pairs.schema[c].dataType for c in ("query", "target")]
    out = StructType([*(StructField(c, kind) for c, kind in zip(("query", "target"), ids, strict=True)), *(StructField(c, DoubleType()) for c in ("shift", "open", "extend", "score"))])
    both = None
    for number, side in enumerate(("query", "target")):
        rows = own.withColumnRenamed("id", side).join(pairs.select("query", "target"), side).select("query", "target", F.lit(number).alias("side"), "part", *views)
        both = rows if both is None else both.unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def ended() -> Iterator[pa.RecordBatch]:
            if now is not None and len(held) == 2 * len(views):
                yield _scored(now, {name: np.concatenate(v) for name, v in held.items()}, settings, [(f"0{v}", f"1{v}") for v in views])

        for batch in batches:
            for k in range(batch.num_rows):
                pair = batch.select([0, 1]).slice(k, 1)
                if now is None or not pair.equals(now):
                    yield from ended()
                    now, held = pa.RecordBatch.from_pylist(pair.to_pylist(), pair.schema), {}  # not a view of the batch
                for c, v in enumerate(views):
                    if batch.column(4 + c)[k].is_valid:
                        held.setdefault(f"{batch.column(2)[k].as_py()}{v}", []).append(matrix(batch.column(4 + c)[k]))
        yield from ended()

    return spread(both, "query", "target").sortWithinPartitions("query", "target", "side", "part").mapInArrow(run, out)


def _unit_rows(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the residues that have one, and which have: a vector that is null or holds a null is none."""
    vec = matrix(value)
    if vec is not None and not value.values.flatten().null_count:
        return vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-9), np.ones(len(vec), bool)
    rows = value.as_py() or []
    there = np.array([x is not None and None not in x for x in rows], bool)
    found = [x for x, ok in zip(rows, there, strict=True) if ok]
    if len({len(x) for x in found}) > 1:
        raise ValueError("vectors differ in length")
    vec = np.array(found, float) if found else np.zeros((0, 1))
    return vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-9), there


def similarity_cells(pairs: DataFrame, name: str = "s", digits: int = 6, standard: int | None = None, dealt: bool = False) -> DataFrame:
    """query, target, i, j and the cosine of residues i and j, rounded, for every cell of pairs (query, target, a, b: residue vectors).

    With `standard`, the mean of the z-scores of the rounded cosines within row and column instead, rounded to so many places. A pair is one
    row of work and its cells leave in strips of rows, so neither a task nor a shuffle holds a matrix. Cells of residues without a vector are null.
    dealt: pairs are in the tasks that are to make their cells.
    """
    kind = pairs.schema["query"].dataType
    out = StructType([StructField("query", kind), StructField("target", kind), StructField("i", LongType()), StructField("j", LongType()), StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1)]
                (a, in_a), (b, in_b) = _unit_rows(batch.column(2)[k]), _unit_rows(batch.column(3)[k])
                if len(a) and len(b):
                    strips = kernels.standardised_strips(a, b, digits) if standard is not None else (np.round(a[rows] @ b.T, digits) for rows in kernels.strips(len(a), len(b)))
                    yield from _cells(ids, np.flatnonzero(in_a), in_b, strips, standard, out.names)
                none = np.flatnonzero(~in_a) if len(a) and len(b) else np.arange(len(in_a))
                yield from _cells(ids, none, np.zeros(len(in_b), bool), (np.zeros((rows.stop - rows.start, 0)) for rows in kernels.strips(len(none), len(in_b))), None, out.names)

    own = pairs.select("query", "target", "a", "b")
    return (own if dealt else spread(own, "query", "target")).mapInArrow(run, out)


def _cells(ids: list[pa.Array], places: np.ndarray, there: np.ndarray, strips: Iterator[np.ndarray], digits: int | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Strips of a matrix, whose columns are those that are `there`, as rows; the rows of the matrix have their numbers in `places`."""
    at, m = 0, len(there)
    for strip in strips:
        n = len(strip)
        values = (strip if digits is None else np.round(strip, digits)) + 0.0  # no negative zero
        if there.all():
            column = pa.array(values.ravel())
        else:
            full = np.zeros((n, m))
            full[:, there] = values
            column = pa.array(full.ravel(), mask=np.tile(~there, n))
        none = pa.array(np.zeros(n * m, np.int32))
        yield pa.RecordBatch.from_arrays([*(x.take(none) for x in ids), pa.array(np.repeat(places[at : at + n], m)), pa.array(np.tile(np.arange(m), n)), column], names)
        at += n


#: Means of a similarity matrix.
MEANS = ["row_best", "row_soft", "col_best", "col_soft", "mean_all"]


def similarity_means(pairs: DataFrame, temperature: float = 0.1, digits: int = 6, dealt: bool = False) -> DataFrame:
    """query, target and the means of row maxima, softly weighted rows, column maxima, softly weighted columns and all cells of the rounded cosines of pairs
    (query, target, a, b: residue vectors). Matrices are made in strips; residues without a vector are left out."""
    kind = pairs.schema["query"].dataType
    out = StructType([StructField("query", kind), StructField("target", kind), *(StructField(c, DoubleType()) for c in MEANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                a, b = _unit_rows(batch.column(2)[k])[0], _unit_rows(batch.column(3)[k])[0]
                found.append([float(x) for x in kernels.product_statistics(a, b, temperature, digits)[[0, 2, 1, 3, 4]]] if len(a) and len(b) else [None] * 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[c] for x in found], pa.float64()) for c in range(5))], out.names)

    own = pairs.select("query", "target", "a", "b")
    return (own if dealt else spread(own, "query", "target")).mapInArrow(run, out)


def structure_alignments(pairs: DataFrame) -> DataFrame:
    """id, both TM scores, rmsd and the number of aligned residues of rows (id, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [kernels.align_structures(matrix(x), matrix(y)) for x, y in zip(batch.column(1), batch.column(2), strict=True)]
            arrays = [pa.array([x[name] for x in out], pa.float64()) for name in ("tm1", "tm2", "rmsd")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array([len(x["pairs"]) for x in out], pa.int64())], ["id", "tm1", "tm2", "rmsd", "aligned"])

    return spread(pairs.select("id", "x", "y"), "id").mapInArrow(run, "id bigint, tm1 double, tm2 double, rmsd double, aligned bigint")
