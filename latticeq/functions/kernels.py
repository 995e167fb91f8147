"""Numeric kernels in numpy, batched over the first axis where that pays. No Spark here."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Outer and inner iterations, the first and last regularisation, the scale of distances, and the structure's share.
OUTER, INNER, EPS_FIRST, EPS_LAST, UNIT, SHARE = 30, 20, 0.05, 0.005, 10.0, 0.7

#: Cells of a matrix that are held at a time where it is not needed whole.
CELLS = 1 << 18


def strips(n: int, m: int, cells: int | None = None) -> Iterator[slice]:
    """Slices of n rows whose m columns make about `cells` cells together."""
    step = max(1, (cells or CELLS) // max(m, 1))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def distances(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of all points of a to all of b, over leading axes alike."""
    b = a if b is None else b
    return np.sqrt(sum((a[..., :, None, k] - b[..., None, :, k]) ** 2 for k in range(a.shape[-1])))  # axis by axis: no array of differences


def feature_cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Half of one minus the cosine."""
    x = x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-9)
    y = y / (np.linalg.norm(y, axis=-1, keepdims=True) + 1e-9)
    return (1 - np.clip(x @ np.swapaxes(y, -1, -2), -1, 1)) / 2


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


#: Rounds in logarithms, after which the plan is near its marginals and the others run as matrix products on it.
LOG_ROUNDS = 2


def sinkhorn(cost: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float, rounds: int = INNER) -> np.ndarray:
    """The entropic transport plan after so many rounds; the columns' marginal holds exactly.

    The first rounds run in logarithms, so that no cost is too large. The plan that they give is scaled to its marginals in the others: the same
    iterates, without an exponential a cell and round. Where a scale leaves the range of numbers, all rounds run in logarithms.
    """
    first = min(rounds, LOG_ROUNDS)
    plan = _log_rounds(cost, a, b, eps, first)
    if first == rounds:
        return plan
    v = np.ones((*plan.shape[:-2], plan.shape[-1]))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(rounds - first):
            u = a / (plan @ v[..., None]).squeeze(-1)
            v = b / (u[..., None, :] @ plan).squeeze(-2)
        out = u[..., :, None] * plan * v[..., None, :]
    return out if np.isfinite(out).all() else _log_rounds(cost, a, b, eps, rounds)


def _log_rounds(cost: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float, rounds: int) -> np.ndarray:
    k = -cost / eps
    g = np.zeros((*cost.shape[:-2], cost.shape[-1]))
    la, lb = np.log(a), np.log(b)
    for _ in range(rounds):
        f = la - _lse(k + g[..., None, :], -1)
        g = lb - _lse(k + f[..., :, None], -2)
    return np.exp(f[..., :, None] + k + g[..., None, :])


def sinkhorn_marginals(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows and of the columns of sinkhorn's plan for the feature cost of x and y, without a matrix: the cost is at most 1, and every round makes it anew in strips.

    Rounds end early when they change no factor of a row by more than 1e-12 of it.
    """
    if eps < 1 / 300:
        raise ValueError("a smaller eps needs sinkhorn, which works in logarithms")
    x, y = (v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-9) for v in (x, y))

    def kernel(rows: slice) -> np.ndarray:
        return np.exp((np.clip(x[rows] @ y.T, -1, 1) - 1) / (2 * eps))

    u, v = np.ones(len(x)), np.ones(len(y))
    for _ in range(rounds):
        old, down = u.copy(), np.zeros(len(y))
        for rows in strips(len(x), len(y)):
            k = kernel(rows)
            u[rows] = a[rows] / (k @ v)
            down += u[rows] @ k
        v = b / down
        if np.abs(u / old - 1).max() < 1e-12:
            break
    across = np.concatenate([u[rows] * (kernel(rows) @ v) for rows in strips(len(x), len(y))])
    return across, v * down


def linear_cost(c1: np.ndarray, c2: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """The cost of moving mass, to first order at a plan."""
    a, b = plan.sum(-1), plan.sum(-2)
    left = (c1**2 @ a[..., None]).squeeze(-1)
    right = (c2**2 @ b[..., None]).squeeze(-1)
    return left[..., :, None] + right[..., None, :] - 2 * c1 @ plan @ np.swapaxes(c2, -1, -2)


def distortion(c1: np.ndarray, c2: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """How much a plan changes distances, at least 0 up to rounding."""
    return (linear_cost(c1, c2, plan) * plan).sum((-1, -2))


def moments(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of each point's distances to all, in units, and of their squares."""
    parts = []
    for rows in strips(len(points), len(points)):
        c = distances(points[rows], points) / UNIT
        parts.append((c.mean(1), (c**2).mean(1)))
    return np.concatenate([m for m, _ in parts]), np.concatenate([s for _, s in parts])


def even_cost(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Mean and greatest of linear_cost of points x and y at the even plan; the mean is the plan's distortion. The plan is a product, so each side's moments are enough."""
    (m1, s1), (m2, s2) = moments(x), moments(y)
    greatest = max(float((s1[rows, None] + s2 - 2 * m1[rows, None] * m2).max()) for rows in strips(len(x), len(y)))
    return float(s1.mean() + s2.mean() - 2 * m1.mean() * m2.mean()), greatest


def coupling(c1: np.ndarray, c2: np.ndarray, feature: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """The annealed Gromov-Wasserstein plan of two distance matrices, fused with a feature cost if given."""
    n, m = c1.shape[-1], c2.shape[-1]
    a, b = np.full(n, 1 / n), np.full(m, 1 / m)
    plan = np.broadcast_to(a[:, None] * b, (*c1.shape[:-2], n, m)) if start is None else start
    for step in range(OUTER):
        cost = linear_cost(c1, c2, plan)
        if feature is not None:
            cost = SHARE * cost + (1 - SHARE) * feature
        plan = sinkhorn(cost, a, b, EPS_FIRST * (EPS_LAST / EPS_FIRST) ** (step / (OUTER - 1)))
    return plan


def local_labels(x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> dict[str, np.ndarray]:
    """Structure and composite distortion of patches x and y with features: gw_raw, fgw_raw and its feature term."""
    c1, c2, m = distances(x) / UNIT, distances(y) / UNIT, feature_cost(fx, fy)
    plain, fused = coupling(c1, c2), coupling(c1, c2, m)
    term = (m * fused).sum((-1, -2))
    return {"gw_raw": distortion(c1, c2, plain), "fgw_raw": SHARE * distortion(c1, c2, fused) + (1 - SHARE) * term, "fgw_feature_term": term}


def random_coupling(n: int, m: int, rng: np.random.Generator, sweeps: int = 50) -> np.ndarray:
    """A random plan with even marginals, by proportional fitting."""
    plan = rng.random((n, m)) + 1e-6
    for _ in range(sweeps):
        plan /= plan.sum(1, keepdims=True) * n
        plan /= plan.sum(0, keepdims=True) * m
    return plan


def random_marginals(n: int, m: int, rng: np.random.Generator, sweeps: int = 50) -> tuple[float, float, float]:
    """Greatest errors of random_coupling's rows and columns, as parts, and its spread times n * m, without the plan.

    Every sweep draws the same numbers again in strips; only the factors of rows and columns are kept. Sweeps end early when they change no factor.
    """
    state = rng.bit_generator.state

    def drawn() -> Iterator[tuple[slice, np.ndarray]]:
        own = np.random.Generator(type(rng.bit_generator)())
        own.bit_generator.state = state
        return ((rows, own.random((rows.stop - rows.start, m)) + 1e-6) for rows in strips(n, m))

    u, v = np.ones(n), np.ones(m)
    for _ in range(sweeps):
        old, down = (u.copy(), v), np.zeros(m)
        for rows, k in drawn():
            u[rows] = 1 / (n * (k @ v))
            down += u[rows] @ k
        v = 1 / (m * down)
        if all(np.abs(now / before - 1).max() < 1e-14 for now, before in zip((u, v), old, strict=True)):
            break
    row_error, down, first, second = 0.0, np.zeros(m), 0.0, 0.0
    for rows, k in drawn():
        k *= u[rows, None] * v
        row_error = max(row_error, float(np.abs(k.sum(1) * n - 1).max()))
        down += k.sum(0)
        k = k * (n * m) - 1  # about 0 on average
        first, second = first + float(k.sum()), second + float((k**2).sum())
    return row_error, float(np.abs(down * m - 1).max()), float(np.sqrt(second / (n * m) - (first / (n * m)) ** 2))


def standardised(s: np.ndarray) -> np.ndarray:
    """The mean of the z-scores within rows and within columns."""
    def z(axis: int) -> np.ndarray:
        return (s - s.mean(axis, keepdims=True)) / np.sqrt(np.maximum(s.var(axis, keepdims=True), 1e-12))

    return (z(1) + z(0)) / 2


def standardised_strips(a: np.ndarray, b: np.ndarray, digits: int | None = None) -> Iterator[np.ndarray]:
    """standardised(a @ b.T) in strips of rows, in order. digits: places that the cells are rounded to before."""
    def cells(rows: slice) -> np.ndarray:
        s = a[rows] @ b.T
        return s if digits is None else np.round(s, digits)

    mean, spread, seen = np.zeros(len(b)), np.zeros(len(b)), 0
    for rows in strips(len(a), len(b)):  # means and squared deviations of parts, joined
        s = cells(rows)
        own, k = s.mean(0), len(s)
        apart = own - mean
        spread += ((s - own) ** 2).sum(0) + apart**2 * (seen * k / (seen + k))
        mean, seen = mean + apart * (k / (seen + k)), seen + k
    down = np.sqrt(np.maximum(spread / max(seen, 1), 1e-12))
    for rows in strips(len(a), len(b)):
        s = cells(rows)
        across = s - s.mean(1, keepdims=True)
        yield (across / np.sqrt(np.maximum((across**2).mean(1, keepdims=True), 1e-12)) + (s - mean) / down) / 2


def local_scores(rows: Iterable[np.ndarray], m: int, settings: list[tuple[float, float, float]]) -> np.ndarray:
    """smith_waterman of a matrix of m columns under every setting (shift, open, extend), from its rows in order: what is held is a row for each setting."""
    shift, open_, extend = (np.array(x, float)[:, None] for x in zip(*settings, strict=True))
    ramp = extend * np.arange(m + 1)
    up, gap_up, best = np.zeros(ramp.shape), np.full(ramp.shape, -1e30), np.zeros(len(settings))
    for row in rows:
        gap_up = np.maximum(up - open_, gap_up - extend)
        h = np.maximum(0, gap_up)
        h[:, 1:] = np.maximum(h[:, 1:], up[:, :-1] + (row - shift))
        h[:, 0] = 0
        left = np.maximum.accumulate(h + ramp, axis=1)[:, :-1] - open_ - ramp[:, 1:] + extend
        h[:, 1:] = np.maximum(h[:, 1:], left)
        up = h
        best = np.maximum(best, h.max(1))
    return best


def smith_waterman(cells: np.ndarray, shift: float, open_: float, extend: float) -> float:
    """Best local alignment score with affine gaps, row by row; gaps along a row come from one running maximum, which needs open_ >= extend."""
    n = cells.shape[1]
    ramp = extend * np.arange(n + 1)
    up, gap_up, best = np.zeros(n + 1), np.full(n + 1, -1e30), 0.0
    for row in cells - shift:
        gap_up = np.maximum(up - open_, gap_up - extend)
        h = np.maximum(0, gap_up)
        h[1:] = np.maximum(h[1:], up[:-1] + row)
        h[0] = 0
        left = np.maximum.accumulate(h + ramp)[:-1] - open_ - ramp[1:] + extend
        h[1:] = np.maximum(h[1:], left)
        up = h
        best = max(best, float(h.max()))
    return best


def superpose(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, shift and root mean square deviation of the best rigid fit of x onto y, point by point."""
    cx, cy = x.mean(0), y.mean(0)
    u, _, vt = np.linalg.svd((x - cx).T @ (y - cy))
    turn = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    rotation = vt.T @ turn @ u.T
    shift = cy - rotation @ cx
    return rotation, shift, float(np.sqrt((((x @ rotation.T + shift) - y) ** 2).sum(1).mean()))


def tm_d0(length: int) -> float:
    return 0.5 if length <= 21 else max(0.5, 1.24 * (length - 15) ** (1 / 3) - 1.8)


#: Starts that an alignment refines.
REFINED = 3


def align_structures(x: np.ndarray, y: np.ndarray, rounds: int = 20) -> dict:
    """A structural alignment: threaded starts, then superposition and dynamic programming in turn on the TM term; scores by both lengths."""
    n, m = len(x), len(y)
    d0 = max(tm_d0(min(n, m)), 1.0)
    best: dict = {"score": -1.0}
    step = max(1, (n + m) // 12)
    starts = [[(i, i + k) for i in range(n) if 0 <= i + k < m] for k in range(-(n - 4), m - 3, step)] + [[(i, i) for i in range(min(n, m))]]

    def fitted(pairs: list[tuple[int, int]]) -> tuple[float, Iterator[np.ndarray], dict]:
        i, j = (np.array(side) for side in zip(*pairs, strict=True))
        rotation, shift, rmsd = superpose(x[i], y[j])
        moved = x @ rotation.T + shift
        near = (1 / (1 + (distances(moved[rows], y) / d0) ** 2) for rows in strips(n, m))  # made when it is matched, in strips
        total = float((1 / (1 + (np.sqrt(((moved[i] - y[j]) ** 2).sum(-1)) / d0) ** 2)).sum())
        return total, near, {"score": total, "pairs": pairs, "rotation": rotation, "shift": shift, "rmsd": rmsd}

    # every start takes one step; only the most promising ones are refined
    tried = []
    for pairs in starts:
        if len(pairs) >= 4:
            new = _matched(fitted(pairs)[1], n, m)
            if len(new) >= 4:
                tried.append((fitted(new)[0], new))
    for _, pairs in sorted(tried, key=lambda t: -t[0])[:REFINED]:
        for _ in range(rounds):
            total, near, own = fitted(pairs)
            if total > best["score"] + 1e-9:
                best = own
            new = _matched(near, n, m)
            if new == pairs or len(new) < 4:
                break
            pairs = new
    if best["score"] < 0:
        raise ValueError("structures need four residues at least")
    i, j = (np.array(side) for side in zip(*best["pairs"], strict=True))
    apart = np.linalg.norm(x[i] @ best["rotation"].T + best["shift"] - y[j], axis=1)
    return best | {"tm1": float((1 / (1 + (apart / tm_d0(n)) ** 2)).sum() / n), "tm2": float((1 / (1 + (apart / tm_d0(m)) ** 2)).sum() / m)}


def _matched(strips_: Iterable[np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """The best matching in order of n rows, which come in strips, and m columns; gaps are free. Two bits for each cell tell the way back."""
    up = np.zeros(m + 1)
    left_too, above_too = [], []
    for strip in strips_:
        for score in strip:
            row = np.zeros(m + 1)
            row[1:] = np.maximum.accumulate(np.maximum(up[:-1] + score, up[1:]))
            left_too.append(np.packbits(row[1:] == row[:-1]))
            above_too.append(np.packbits(row[1:] == up[1:]))
            up = row
    pairs, i, j = [], n, m
    while i and j:
        byte, bit = divmod(j - 1, 8)
        if left_too[i - 1][byte] >> (7 - bit) & 1:
            j -= 1
        elif above_too[i - 1][byte] >> (7 - bit) & 1:
            i -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x**2).mean(-1, keepdims=True) + 1e-5) * weight + bias


def linear(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def patch_encoder(features: np.ndarray, coords: np.ndarray, mask: np.ndarray, w: dict, layers: int = 4) -> np.ndarray:
    """Unit embeddings of patches [batch, nodes, ...], unchanged by rotation, shift and padding. Node 0 is the centre; w holds the weights by name."""
    keep = mask[..., None].astype(float)
    h = layer_norm(silu(linear(features, w, "input")), w["input_norm.weight"], w["input_norm.bias"]) * keep
    x = (coords - coords[:, :1]) * keep
    place, centres = np.arange(mask.shape[1]), np.linspace(0, 20, 16)
    for k in range(layers):
        width = h.shape[-1]
        own, other, bump = np.split(w[f"{k}.edge0.weight"], [width, 2 * width], axis=1)
        first, second = h @ own.T + w[f"{k}.edge0.bias"], h @ other.T
        new_h, new_x = [], []
        for rows in strips(1 if k == layers - 1 else len(place), mask.shape[0] * len(place) * width, 1 << 21):  # edges of some nodes at a time; of the last layer, only the centre is used
            edges = (mask[:, rows, None] & mask[:, None, :] & (place[rows, None] != place))[..., None].astype(float)
            count = np.maximum(edges.sum(2), 1)
            apart = x[:, rows, None] - x[:, None]
            far = np.sqrt((apart**2).sum(-1) + 1e-8)
            bumps = np.exp(-(((far[..., None] - centres) / (centres[1] - centres[0])) ** 2))
            both = first[:, rows, None] + second[:, None] + bumps @ bump.T
            message = silu(linear(silu(linear(silu(both), w, f"{k}.edge1")), w, f"{k}.edge2")) * edges
            new_x.append((x[:, rows] + 0.1 * (apart * np.tanh(linear(message, w, f"{k}.coord")) * edges).sum(2) / count) * keep[:, rows])
            change = linear(silu(linear(np.concatenate([h[:, rows], message.sum(2) / count], -1), w, f"{k}.node0")), w, f"{k}.node1")
            new_h.append(layer_norm(h[:, rows] + change, w[f"{k}.norm.weight"], w[f"{k}.norm.bias"]) * keep[:, rows])
        h, x = np.concatenate(new_h, 1), np.concatenate(new_x, 1)
    out = linear(silu(linear(h[:, 0], w, "output0")), w, "output1")
    return out / (np.linalg.norm(out, axis=-1, keepdims=True) + 1e-9)


def patch_encoder_weights(inputs: int, width: int, out: int, layers: int = 4, seed: int = 0) -> dict:
    """Random weights of the right shapes, for tests and as a pattern for loaded ones."""
    rng = np.random.default_rng(seed)
    w: dict = {}

    def add(name: str, rows: int, cols: int) -> None:
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(0, 1 / np.sqrt(cols), (rows, cols)), rng.normal(0, 0.1, rows)

    add("input", width, inputs)
    for k in range(layers):
        for name, rows, cols in (("edge0", width, 2 * width + 16), ("edge1", width, width), ("edge2", width, width), ("coord", 1, width), ("node0", width, 2 * width), ("node1", width, width)):
            add(f"{k}.{name}", rows, cols)
    add("output0", width, width)
    add("output1", out, width)
    for name in ("input_norm", *(f"{k}.norm" for k in range(layers))):
        w[f"{name}.weight"], w[f"{name}.bias"] = np.ones(width), np.zeros(width)
    return w


def sequence_encoder(x: np.ndarray, mask: np.ndarray, w: dict, heads: int = 8, layers: int = 4) -> np.ndarray:
    """Unit embeddings of every position of sequences [batch, length, ...] by pre-norm Transformer layers; padding gives zeros and changes nothing."""
    from math import erf

    gelu = np.vectorize(lambda v: 0.5 * v * (1 + erf(v / 2**0.5)))
    width = w["input.weight"].shape[0]
    place = np.arange(x.shape[1])[:, None] / 10000 ** (2 * (np.arange(width) // 2) / width)
    code = np.where(np.arange(width) % 2 == 0, np.sin(place), np.cos(place))
    h = layer_norm(silu(linear(x, w, "input")), w["input_norm.weight"], w["input_norm.bias"]) + code
    size = width // heads
    hidden = np.where(mask[:, None, None, :], 0.0, -1e30)
    for k in range(layers):
        y = layer_norm(h, w[f"{k}.norm1.weight"], w[f"{k}.norm1.bias"])
        q, key, v = (linear(y, w, f"{k}.{name}").reshape(*y.shape[:2], heads, size).swapaxes(1, 2) for name in ("q", "k", "v"))
        found = []
        for rows in strips(x.shape[1], x.shape[0] * heads * x.shape[1], 1 << 20):
            s = q[:, :, rows] @ key.swapaxes(-1, -2) / np.sqrt(size) + hidden
            s = np.exp(s - s.max(-1, keepdims=True))
            found.append((s / s.sum(-1, keepdims=True)) @ v)
        h = h + linear(np.concatenate(found, 2).swapaxes(1, 2).reshape(y.shape), w, f"{k}.out")
        h = h + linear(gelu(linear(layer_norm(h, w[f"{k}.norm2.weight"], w[f"{k}.norm2.bias"]), w, f"{k}.up")), w, f"{k}.down")
    out = linear(silu(linear(h, w, "output0")), w, "output1")
    return out / (np.linalg.norm(out, axis=-1, keepdims=True) + 1e-9) * mask[..., None]


def sequence_encoder_weights(inputs: int, width: int, out: int, layers: int = 4, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    w: dict = {}

    def add(name: str, rows: int, cols: int) -> None:
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(0, 1 / np.sqrt(cols), (rows, cols)), rng.normal(0, 0.1, rows)

    add("input", width, inputs)
    for k in range(layers):
        for name, rows, cols in (("q", width, width), ("k", width, width), ("v", width, width), ("out", width, width), ("up", 4 * width, width), ("down", width, 4 * width)):
            add(f"{k}.{name}", rows, cols)
        for name in ("norm1", "norm2"):
            w[f"{k}.{name}.weight"], w[f"{k}.{name}.bias"] = np.ones(width), np.zeros(width)
    add("output0", width, width)
    add("output1", out, width)
    w["input_norm.weight"], w["input_norm.bias"] = np.ones(width), np.zeros(width)
    return w


def similarity_statistics(s: np.ndarray, temperature: float = 0.1) -> np.ndarray:
    """Mean of row maxima, of column maxima, of softly weighted rows, of softly weighted columns, and of all cells."""
    def soft(axis: int) -> float:
        e = np.exp((s - s.max(axis, keepdims=True)) / temperature)
        return float(((e * s).sum(axis) / e.sum(axis)).mean())

    return np.array([s.max(1).mean(), s.max(0).mean(), soft(1), soft(0), s.mean()])


def product_statistics(a: np.ndarray, b: np.ndarray, temperature: float = 0.1, digits: int | None = None) -> np.ndarray:
    """similarity_statistics(a @ b.T) in strips of rows: columns keep their greatest entry so far, and weights are scaled when it grows. digits: places that the cells are rounded to before."""
    top, weight, weighed = np.full(len(b), -np.inf), np.zeros(len(b)), np.zeros(len(b))
    best = soft = total = 0.0
    for rows in strips(len(a), len(b)):
        s = a[rows] @ b.T
        if digits is not None:
            s = np.round(s, digits)
        row_top = s.max(1, keepdims=True)
        e = np.exp((s - row_top) / temperature)
        best, total = best + float(row_top.sum()), total + float(s.sum())
        soft += float(((e * s).sum(1) / e.sum(1)).sum())
        now = np.maximum(top, s.max(0))
        e, scale = np.exp((s - now) / temperature), np.exp((top - now) / temperature)
        weight, weighed, top = weight * scale + e.sum(0), weighed * scale + (e * s).sum(0), now
    return np.array([best / len(a), top.mean(), soft / len(a), (weighed / weight).mean(), total / (len(a) * len(b))])


def run_statistics(a: np.ndarray, b: np.ndarray, starts: np.ndarray, temperature: float = 0.1) -> np.ndarray:
    """Row maxima, softly weighted rows, column maxima, softly weighted columns and all cells of unit vectors a with each of several structures that lie in b from `starts` on: a mean of each, and a column for each structure.

    Cosines are at most 1, so rows and columns share their weights; a temperature under 0.01 needs product_statistics.
    """
    s = a @ b.T
    width = np.diff(np.append(starts, len(b)))
    weight = np.exp((s - 1) / temperature)
    weighed = weight * s
    soft = (np.add.reduceat(weighed, starts, axis=1) / np.add.reduceat(weight, starts, axis=1)).mean(0)
    down = np.stack([s.max(0), weighed.sum(0) / weight.sum(0), s.mean(0)])
    col_best, col_soft, mean = np.add.reduceat(down, starts, axis=1) / width
    return np.stack([np.maximum.reduceat(s, starts, axis=1).mean(0), soft, col_best, col_soft, mean])


def pair_head(a: np.ndarray, b: np.ndarray, extra: np.ndarray, w: dict) -> np.ndarray:
    """Scores in (0, 1) from two pooled embeddings and further numbers."""
    x = np.concatenate([a, b, np.abs(a - b), a * b, extra], -1)
    return 1 / (1 + np.exp(-linear(silu(linear(x, w, "head0")), w, "head1")))


def linear_baseline(x: np.ndarray, mask: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The mean of the vectors that the mask holds, through one linear layer."""
    mean = (x * mask[..., None]).sum(-2) / np.maximum(mask.sum(-1, keepdims=True), 1)
    return mean @ weights + bias
