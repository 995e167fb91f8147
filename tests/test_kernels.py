import numpy as np

from latticeq.functions import kernels as K

RNG = np.random.default_rng(0)


def turned(x, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return x @ (q * np.sign(np.linalg.det(q))).T + [1.5, -2, 3.25]


def walk(n, seed=0):
    step = np.random.default_rng(seed).normal(size=(n, 3))
    return np.cumsum(3.8 * step / np.linalg.norm(step, axis=1, keepdims=True), 0)


def ball(n, seed=0):
    """Points within about 12 of a centre, as in a patch."""
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * 12 * np.random.default_rng(seed + 100).random((n, 1)) ** (1 / 3)


def score(x, y, **k):
    c1, c2 = K.distances(x) / K.UNIT, K.distances(y) / K.UNIT
    return float(K.distortion(c1, c2, K.coupling(c1, c2, **k)))


def test_sinkhorn_marginals():
    for eps in (1.0, 0.01):
        plan = K.sinkhorn(RNG.random((6, 9)), np.full(6, 1 / 6), np.full(9, 1 / 9), eps, 300)
        assert np.allclose(plan.sum(0), 1 / 9) and np.allclose(plan.sum(1), 1 / 6, atol=1e-3)


def test_sinkhorn_equals_rounds_in_logarithms():
    for scale in (0.1, 1, 30):
        for eps in (0.5, 0.05, 0.005):
            cost, a, b = RNG.random((3, 8, 6)) * scale, np.full(8, 1 / 8), np.full(6, 1 / 6)
            assert np.allclose(K.sinkhorn(cost, a, b, eps), K._log_rounds(cost, a, b, eps, K.INNER), atol=1e-9)


def test_distortion_tells_structures_apart():
    x = ball(32)
    assert score(x, turned(x)) < 1e-3
    assert score(x, ball(32, 5)) > score(x, turned(x)) + 0.01
    assert score(x, 1.25 * x) > 1e-3
    a, b = score(x, ball(32, 5)), score(ball(32, 5), x)
    assert abs(a - b) <= 0.1 * max(a, b)


def test_labels_in_batches_equal_single_ones():
    x, y, fx, fy = (RNG.normal(size=(3, 8, d)) for d in (3, 3, 5, 5))
    whole = K.local_labels(x, y, fx, fy)
    for k in range(3):
        one = K.local_labels(x[k : k + 1], y[k : k + 1], fx[k : k + 1], fy[k : k + 1])
        assert all(np.allclose(whole[name][k], one[name][0]) for name in whole)


def test_random_coupling_has_even_marginals():
    plan = K.random_coupling(5, 7, RNG)
    assert np.allclose(plan.sum(0), 1 / 7) and np.allclose(plan.sum(1), 1 / 5, atol=1e-6)


def plain_alignment(cells, shift, open_, extend):
    n, m = cells.shape
    h, e, f = (np.full((n + 1, m + 1), v) for v in (0.0, -1e30, -1e30))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i, j] = max(h[i - 1, j] - open_, e[i - 1, j] - extend)
            f[i, j] = max(h[i, j - 1] - open_, f[i, j - 1] - extend)
            h[i, j] = max(0, h[i - 1, j - 1] + cells[i - 1, j - 1] - shift, e[i, j], f[i, j])
    return h.max()


def test_smith_waterman_equals_the_plain_recursion():
    for k in range(40):
        cells = RNG.normal(size=(RNG.integers(1, 15), RNG.integers(1, 15))) * 2
        for shift, open_, extend in ((0, 1, 0.5), (0.3, 2, 0.2), (0, 1, 1)):
            assert abs(K.smith_waterman(cells, shift, open_, extend) - plain_alignment(cells, shift, open_, extend)) < 1e-9


def test_structure_alignment():
    x = walk(40, 3)
    same = K.align_structures(x, turned(x))
    assert abs(same["tm1"] - 1) < 1e-6 and same["rmsd"] < 1e-6 and same["pairs"] == [(i, i) for i in range(40)]
    part = K.align_structures(x, turned(x[8:32]))
    assert part["tm2"] > 0.95 and part["tm1"] > 0.5
    assert K.align_structures(x, walk(40, 9))["tm1"] < 0.6


def test_superpose_and_d0():
    x = walk(12, 2)
    rotation, shift, rmsd = K.superpose(x, turned(x))
    assert rmsd < 1e-9 and np.isclose(np.linalg.det(rotation), 1) and np.allclose(x @ rotation.T + shift, turned(x))
    assert K.tm_d0(10) == 0.5 and np.isclose(K.tm_d0(141), 1.24 * 126 ** (1 / 3) - 1.8)


def test_patch_encoder_invariances():
    w = K.patch_encoder_weights(6, 16, 8, layers=2)
    f, x, mask = RNG.normal(size=(2, 7, 6)), RNG.normal(size=(2, 7, 3)) * 5, np.ones((2, 7), bool)
    out = K.patch_encoder(f, x, mask, w, layers=2)
    assert np.allclose(np.linalg.norm(out, axis=1), 1)
    assert np.allclose(out, K.patch_encoder(f, np.stack([turned(p) for p in x]), mask, w, layers=2), atol=1e-6)
    padded = [np.concatenate([v, RNG.normal(size=(2, 3, v.shape[-1]))], 1) for v in (f, x)]
    assert np.allclose(out, K.patch_encoder(*padded, np.concatenate([mask, np.zeros((2, 3), bool)], 1), w, layers=2))


def test_sequence_encoder_ignores_padding():
    w = K.sequence_encoder_weights(5, 16, 8, layers=2)
    x = RNG.normal(size=(1, 9, 5))
    out = K.sequence_encoder(x, np.ones((1, 9), bool), w, heads=4, layers=2)
    more = K.sequence_encoder(np.concatenate([x, RNG.normal(size=(1, 4, 5))], 1), np.arange(13)[None] < 9, w, heads=4, layers=2)
    assert np.allclose(out, more[:, :9]) and np.allclose(more[:, 9:], 0)


def test_statistics_of_self_similarity():
    v = RNG.normal(size=(6, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = K.similarity_statistics(v @ v.T)
    assert np.allclose(s[:2], 1) and s[2] <= 1 and np.isclose(s[4], (v @ v.T).mean())
    z = K.standardised(RNG.normal(size=(5, 8)))
    assert abs(z.mean()) < 1e-9
