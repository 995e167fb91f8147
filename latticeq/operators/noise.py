"""Noise of labels: residue pairs labelled anew under small changes of what they are computed from, and the ceiling that this sets on any model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, kernels
from ..functions.udfs import matrix, spread
from .metrics import pearson, variance

#: Root mean square displacements, sizes of patches beside the usual one, and draws of what is random.
LEVELS, PATCH, OTHER_PATCHES, DRAWS = (0.1, 0.25, 0.5), 32, (31, 33), 2
TYPES = ("aligned", "shifted", "random")
CONDITION = "struct<name: string, kind: string, parameter: double, draw: int>"


def conditions() -> list[tuple[str, str, float, int]]:
    """name, kind, parameter and draw of each recomputation: the reference, displaced points, other patches, random starts."""
    noise = [(f"noise_{level:g}_r{draw}", "noise", level, draw) for level in LEVELS for draw in range(1, DRAWS + 1)]
    sizes = [(f"k{k}", "patch", float(k), 0) for k in OTHER_PATCHES]
    return [("reference", "reference", 0.0, 0), *noise, *sizes, *((f"init_r{draw}", "init", 0.0, draw) for draw in range(1, DRAWS + 1))]


def families() -> list[tuple[str, str, str | None]]:
    """name, condition and second draw, if there is one, of each kind of change."""
    return [*((f"noise {level:g}", f"noise_{level:g}_r1", f"noise_{level:g}_r2") for level in LEVELS), *((f"patch {k}", f"k{k}", None) for k in OTHER_PATCHES), ("start", "init_r1", "init_r2")]


def _patch(points: np.ndarray, at: int, k: int) -> np.ndarray:
    apart = ((points - points[at]) ** 2).sum(1)
    apart[at] = -1  # itself first
    return points[np.argsort(apart, kind="stable")[:k]]


def relabelled(pairs: DataFrame, structures: DataFrame, seed: int = 0) -> DataFrame:
    """row, i, j, pair_type, condition and gw_raw: every residue pair (row, id1, id2, i, j, pair_type) labelled under every condition.

    structures: id and points (arrays of three numbers). A protein pair and condition is one row of work: its points are displaced once, for all its
    residue pairs, by numbers that (seed, row, condition) fixes, so any cluster draws the same. Pairs of residues that are not there, or of
    structures that are not, are left out; the loader says why.
    """
    wanted = pairs.where("i is not null and j is not null").groupBy("row", "id1", "id2").agg(F.sort_array(F.collect_list(F.struct("i", "j", "pair_type"))).alias("asked"))  # one pair of proteins
    for side in "12":
        wanted = wanted.join(structures.select(F.col("id").alias(f"id{side}"), F.col("points").alias(f"points{side}")), f"id{side}")
    every = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(float(x)).alias("parameter"), F.lit(draw).alias("draw")) for name, kind, x, draw in conditions()))
    work = wanted.select("row", "asked", "points1", "points2", F.explode(every).alias("c")).select("row", "asked", "points1", "points2", F.col("c.name").alias("condition"), "c.kind", "c.parameter", "c.draw")
    order = [name for name, *_ in conditions()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, asked, _, _, condition, kind, parameter, draw = (batch.column(c)[k] for c in range(8))
                x, y = matrix(batch.column(2)[k]), matrix(batch.column(3)[k])
                pairs = [p for p in asked.as_py() if x is not None and y is not None and 0 <= p["i"] < len(x) and 0 <= p["j"] < len(y)]
                if pairs:
                    raw = labelled(x, y, [(p["i"], p["j"]) for p in pairs], kind.as_py(), parameter.as_py(), [seed, row.as_py(), order.index(condition.as_py()), draw.as_py()])
                    own = [[row.as_py()] * len(pairs), *([p[c] for p in pairs] for c in ("i", "j", "pair_type")), [condition.as_py()] * len(pairs), raw]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, kinds, strict=True)], ["row", "i", "j", "pair_type", "condition", "gw_raw"])

    return spread(work, "row", "condition").mapInArrow(run, "row bigint, i bigint, j bigint, pair_type string, condition string, gw_raw double")


def labelled(x: np.ndarray, y: np.ndarray, pairs: list[tuple[int, int]], kind: str, parameter: float, seed: list[int]) -> np.ndarray:
    """The structure distortion of the patches around pairs of residues, under one condition; patches of equal sizes are solved together."""
    rng, k = np.random.default_rng(seed), PATCH
    if kind == "noise":  # so much in three dimensions together
        x, y = x + rng.normal(0, parameter / 3**0.5, x.shape), y + rng.normal(0, parameter / 3**0.5, y.shape)
    elif kind == "patch":
        k = int(parameter)
    n, m = min(k, len(x)), min(k, len(y))
    starts = np.stack([kernels.random_coupling(n, m, rng) for _ in pairs]) if kind == "init" else None
    out = np.empty(len(pairs))
    for at in range(0, len(pairs), 64):
        part = slice(at, at + 64)
        one, other = (np.stack([_patch(points, pair[side], k) for pair in pairs[part]]) for side, points in ((0, x), (1, y)))
        c1, c2 = kernels.distances(one) / kernels.UNIT, kernels.distances(other) / kernels.UNIT
        out[part] = kernels.distortion(c1, c2, kernels.coupling(c1, c2, start=None if starts is None else starts[part]))
    return out


def wide(long: DataFrame, stored: DataFrame) -> DataFrame:
    """stored (row, i, j, pair_type, gw_raw) with a column for each condition."""
    names = [name for name, *_ in conditions()]
    pivoted = long.groupBy("row", "i", "j").pivot("condition", names).agg(F.min("gw_raw"))
    return stored.select("row", "i", "j", "pair_type", "gw_raw").join(pivoted, ["row", "i", "j"])


def noise_table(table: DataFrame, least: int = 3) -> DataFrame:
    """family, kind, n, pearson, draws_pearson, bias, sigma2, var and ceiling: what each family of changes does to labels, over all pairs and by type.

    table: as from wide. Labels are similarities of the raw values. sigma2 is half the variance between two draws, or that against the stored label where there is
    one draw; the ceiling is what is left of the labels' variance. Kinds of fewer than `least` pairs are left out.
    """
    label = lambda c: exprs.similarity(F.col(f"`{c}`"))  # noqa: E731  names hold dots
    each = F.array(*(F.struct(F.lit(name).alias("family"), label(one).alias("a"), (label(other) if other else F.lit(None).cast("double")).alias("b")) for name, one, other in families()))
    rows = table.select("pair_type", label("gw_raw").alias("y"), F.explode(each).alias("x")).select("y", "x.*", F.explode(F.array(F.lit("all"), "pair_type")).alias("kind"))
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    two = F.count("b") > 0
    sigma2: Column = F.when(two, F.var_pop(a - b) / 2).otherwise(F.var_pop(y - a))
    figures = {"pearson": pearson(y, a), "draws_pearson": F.when(two, pearson(a, b)), "bias": F.avg(a - y), "sigma2": sigma2, "var": F.var_pop(y), "ceiling": 1 - F.try_divide(sigma2, variance(y))}
    found = rows.groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"), *(F.round(x, 9).alias(name) for name, x in figures.items()))
    return found.where(F.col("n") >= least)
