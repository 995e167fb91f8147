import numpy as np
import pytest

from latticeq.functions import kernels
from latticeq.operators import noise


def _walk(n, seed):
    return np.cumsum(np.random.default_rng(seed).standard_normal((n, 3)) * 2, 0)


def test_eleven_conditions_and_six_families_equal_plain_numpy(spark):
    points = {k: _walk(40 + k, k) for k in range(4)}
    structures = spark.createDataFrame([(k, p.tolist()) for k, p in points.items()], "id long, points array<array<double>>")
    rows = [(k, k, k + 1, i, i + (0, 5, 2)[i % 3], noise.TYPES[i % 3]) for k in range(4) for i in range(0, 40, 7)] + [(0, 0, 1, 0, 999, "random"), (0, 0, 1, None, 3, "random")]
    pairs = spark.createDataFrame(rows, "row long, id1 long, id2 long, i long, j long, pair_type string")
    long = noise.relabelled(pairs, structures)
    got = {(r.row, r.i, r.j, r.condition): r.gw_raw for r in long.collect()}
    known = [r for r in rows if r[2] in points and r[3] is not None and r[4] < len(points[r[2]])]
    assert len(noise.conditions()) == 11 and len(got) == 11 * len(known)

    def patch(p, at, k):
        return p[sorted(range(len(p)), key=lambda j: (j != at, ((p[j] - p[at]) ** 2).sum(), j))[:k]]

    def score(x, y):
        c1, c2 = kernels.distances(x) / kernels.UNIT, kernels.distances(y) / kernels.UNIT
        return float(kernels.distortion(c1, c2, kernels.coupling(c1, c2)))

    for row, one, other, i, j, _ in known[::3]:
        for name, k in (("reference", 32), ("k31", 31), ("k33", 33)):
            assert got[row, i, j, name] == pytest.approx(score(patch(points[one], i, k), patch(points[other], j, k)), abs=1e-9)
    assert got == {(r.row, r.i, r.j, r.condition): r.gw_raw for r in noise.relabelled(pairs.repartition(7), structures).collect()}  # the same on any cluster

    stored = long.where("condition = 'reference'")
    wide = noise.wide(long, stored)
    table = {(r.family, r.kind): r for r in noise.noise_table(wide).collect()}
    assert len({family for family, _ in table}) == 6 and {kind for _, kind in table} == {"all", *noise.TYPES}
    frame = wide.toPandas()
    for (family, kind), row in table.items():
        own = frame if kind == "all" else frame[frame.pair_type == kind]
        y = np.exp(-own["gw_raw"].to_numpy() / 0.05)
        one, other = next((a, b) for name, a, b in noise.families() if name == family)
        a, b = np.exp(-own[one].to_numpy() / 0.05), None if other is None else np.exp(-own[other].to_numpy() / 0.05)
        sigma2 = np.var(y - a) if b is None else np.var(a - b) / 2
        expected = (len(own), np.corrcoef(y, a)[0, 1], (a - y).mean(), sigma2, 1 - sigma2 / np.var(y))
        assert np.allclose((row.n, row.pearson, row.bias, row.sigma2, row.ceiling), expected, atol=1e-7), (family, kind)
        assert (row.draws_pearson is None) == (b is None)
    assert noise.noise_table(wide.limit(2)).count() == 0
