"""Training items from label rows and stored proteins: what fits is built, what does not is kept aside with its reason, and batches are padded to their own size."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import exprs, kernels
from ..functions.udfs import spread
from . import ids, sampling

#: Codes of the kinds of residue pairs.
PAIR_TYPES = {"aligned": 0, "shifted": 1, "random": 2}
#: Points of a patch, and the greatest length of a sequence.
PATCH, LONGEST = 32, 1000


class Items(NamedTuple):
    """Items that could be built, and the groups that could not, each with its reason."""

    built: DataFrame
    rejects: DataFrame


def group_facts(labels: DataFrame, group: str) -> DataFrame:
    """group, its proteins, rows, greatest residues, and how many of its rows have no known pair type: what decides, without any array."""
    known = F.col("pair_type").isin(*PAIR_TYPES)
    return labels.groupBy(group).agg(
        F.min("id1").alias("id1"), F.min("id2").alias("id2"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("id1", "id2")).alias("kinds"),
        F.max("r1").alias("most1"), F.max("r2").alias("most2"), F.min(F.least("r1", "r2")).alias("least"), F.sum((~F.coalesce(known, F.lit(False))).cast("int")).alias("odd"),
        F.sum(F.greatest(F.col("r1").isNull().cast("int"), F.col("r2").isNull().cast("int"))).alias("holes"),
    )


def reasons(facts: DataFrame, lengths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """facts with the first reason against a group, null if there is none. lengths: id, n_points and n_features of stored proteins."""
    for side in "12":
        facts = facts.join(lengths.select(F.col("id").alias(f"id{side}"), F.col("n_points").alias(f"points{side}"), F.col("n_features").alias(f"features{side}")), f"id{side}", "left")
    c = {name: F.col(name) for name in facts.columns}
    either = lambda test: test("1") | test("2")
    reason = ids.status(
        (c["kinds"] > 1, "several proteins in one group"),
        (c["points1"].isNull(), F.concat(F.lit("no protein "), F.coalesce("id1", F.lit("null")))),
        (c["points2"].isNull(), F.concat(F.lit("no protein "), F.coalesce("id2", F.lit("null")))),
        (either(lambda s: ~c[f"points{s}"].eqNullSafe(c[f"features{s}"])), "points and features differ in number"),
        ((c["holes"] > 0) | (c["least"] < 0) | either(lambda s: c[f"most{s}"] >= c[f"points{s}"]), "residue outside the protein"),
        (c["odd"] > 0, "unknown pair type"),
        (either(lambda s: c[f"features{s}"] > longest), "sequence too long"),
    )
    return facts.withColumn("reason", reason)


def with_patches(items: DataFrame, patch: int) -> DataFrame:
    """items (points1, points2 and x, an array of rows with r1 and r2) with patch1 and patch2 in the place of points: for each of a side's residues the numbers
    of the points nearest to it, itself first, then by distance and number, fewer if there are fewer.

    Distances of a structure are made in strips, once for each residue that is asked for. Points without a distance come before the others, and those whose
    distance is no number behind them, as Spark sorts them.
    """
    names = [c for c in items.columns if c not in ("points1", "points2")]
    out = StructType([*(items.schema[c] for c in names), *(StructField(f"patch{side}", ArrayType(ArrayType(IntegerType()))) for side in "12")])

    def nearest(points: pa.ListScalar, residues: np.ndarray) -> pa.Array:
        rows = points.values
        size, whole = len(rows), np.zeros(len(rows), bool)
        lengths = rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        usual = int(lengths.max(initial=1))
        xyz = np.zeros((size, max(usual, 1)))
        flat, full = rows.flatten(), np.maximum(lengths, 0)
        at = np.repeat(np.arange(size), full)
        xyz[at, np.arange(len(flat)) - np.repeat(np.cumsum(full) - full, full)] = flat.fill_null(0).to_numpy(zero_copy_only=False)
        whole[:] = lengths == usual
        whole[at[np.asarray(flat.is_null())]] = False
        asked, back = np.unique(residues, return_inverse=True)
        k, found = min(patch, size), []
        for part in kernels.strips(len(asked), size):
            own = asked[part]
            apart = kernels.distances(xyz[own], xyz)
            key = np.where(np.isnan(apart), np.inf, apart)
            key[~(whole[own][:, None] & whole[None])] = -1
            key[np.arange(len(own)), own] = -2  # itself first
            found.append(np.argsort(key, axis=1, kind="stable")[:, :k])
        near = np.concatenate(found)[back.ravel()].astype(np.int32) if found else np.zeros((0, k), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * k), pa.array(near.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                x = one.column("x")[0].values
                patches = [nearest(one.column(f"points{side}")[0], x.field(f"r{side}").to_numpy(zero_copy_only=False).astype(np.int64)) for side in "12"]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in patches]
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names), *lists], out.names)

    return spread(items, "id1", "id2").mapInArrow(run, out)


def build_items(labels: DataFrame, proteins: DataFrame, group: str = "row", strict: bool = False, patch: int = PATCH, longest: int = LONGEST) -> Items:
    """Items (group, id1, id2, n, labels and patches of each residue pair) from label rows and proteins, and the rejected groups with their reasons.

    labels: group, id1, id2, r1, r2, gw_raw, fgw_raw, tm_term and pair_type; proteins: id, points and features, both arrays by residue. A group is whole or
    rejected. With strict, the first rejected group that is met raises its reason instead. Reasons are found from counts and lengths alone; arrays
    move only for groups that are built. A group is one pair of proteins, so its arrays are bounded by their lengths. The rows of an item are in the
    order of r1, r2 and pair type; of several rows of a protein the first by content counts.
    """
    stored = sampling.keep_first(proteins.where("id is not null").select("id", "points", "features"), ["id"], ["points", "features"])
    lengths = stored.select("id", F.size("points").cast("bigint").alias("n_points"), F.size("features").cast("bigint").alias("n_features"))
    judged = reasons(group_facts(labels, group), lengths, longest)
    rejects = judged.where("reason is not null").select(group, "id1", "id2", "n", "reason")
    if strict:
        met = F.raise_error(F.concat(F.lit("group "), F.coalesce(F.col(group).cast("string"), F.lit("null")), F.lit(": "), F.col("reason")))
        judged = judged.withColumn("reason", F.when(F.col("reason").isNotNull(), met).otherwise(F.lit(None).cast("string")))
    good = judged.where("reason is null").select(group, "id1", "id2", "n")
    code = F.create_map(*(F.lit(x) for pair in PAIR_TYPES.items() for x in pair))[F.col("pair_type")]
    row = F.struct("r1", "r2", code.alias("code"), exprs.similarity(F.col("gw_raw")).alias("structure"), exprs.similarity(F.col("fgw_raw"), exprs.COMPOSITE_SCALE).alias("composite"), F.col("tm_term").alias("tm"))
    lists = labels.groupBy(group).agg(F.sort_array(F.collect_list(row)).alias("x"))  # one pair of proteins
    own = good.join(lists, group)
    for side in "12":
        own = own.join(stored.select(F.col("id").alias(f"id{side}"), F.col("points").alias(f"points{side}")), f"id{side}")
    fields = [F.col("x").getField(name).alias(name) for name in ("r1", "r2", "code", "structure", "composite", "tm")]
    filled = with_patches(own.select(group, "id1", "id2", "n", "x", "points1", "points2"), patch)
    return Items(filled.select(group, "id1", "id2", "n", *fields, "patch1", "patch2"), rejects)


def collated(items: DataFrame, size: int, order: str = "row", fills: dict[str, Column] | None = None) -> DataFrame:
    """items in batches of `size` in order: batch, place, width, and each array padded to the batch's longest, with `mask` for what is real.

    fills: array columns and what they are padded with; the number of entries is the column n. Batches are bounded, so a window over one sees a few rows.
    """
    fills = fills or {"r1": F.lit(0).cast("bigint"), "r2": F.lit(0).cast("bigint"), "code": F.lit(-1), "structure": F.lit(0.0), "composite": F.lit(0.0), "tm": F.lit(0.0)}
    numbered = sampling.numbered(items, [order], "_number")
    own = numbered.withColumns({"batch": F.floor(F.col("_number") / size).cast("bigint"), "place": (F.col("_number") % size).cast("int")}).drop("_number")
    own = own.withColumn("width", F.max("n").over(Window.partitionBy("batch")))
    missing = F.greatest(F.col("width") - F.col("n"), F.lit(0)).cast("int")
    padded = {name: F.concat(F.col(name), F.array_repeat(fill, missing)) for name, fill in fills.items()}
    mask = F.concat(F.array_repeat(F.lit(True), F.col("n").cast("int")), F.array_repeat(F.lit(False), missing))
    return own.withColumns(padded | {"mask": mask})
