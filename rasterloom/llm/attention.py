"""A small causal self-attention model in numpy: one head, a feed-forward layer, a softmax over token classes.

What the model adds to a prior: logits of each class after each slot, which are given, not learned (or nothing).
"""

from __future__ import annotations

from math import prod

import numpy as np


class Shape:
    """d: width; window: tokens a window holds; slots: rows of the input table; classes: outputs; inner: feed-forward width."""

    def __init__(self, d: int = 8, window: int = 48, slots: int = 2048, classes: int = 32, inner: int = 16):
        self.d, self.window, self.slots, self.classes, self.inner = d, window, slots, classes, inner

    def parts(self) -> dict[str, tuple[int, ...]]:
        d = self.d
        return {"E": (self.slots + 1, d), "P": (self.window, d), "Q": (d, 3 * d), "O": (d, d), "A": (d, self.inner), "B": (self.inner, d), "U": (d, self.classes), "b": (self.classes,)}


def initial(shape: Shape, class_logs: np.ndarray, seed: int = 3) -> np.ndarray:
    """Random weights; the output starts near the given logits."""
    rng = np.random.default_rng(seed)
    scale = {"E": 0.3, "P": 0.3, "U": 0.05}
    return np.concatenate([class_logs.astype(np.float32) if k == "b" else (rng.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32).ravel() for k, s in shape.parts().items()])


def unflatten(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.parts().items():
        n = prod(s)
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


_TRIANGLES: dict[int, np.ndarray] = {}


def _causal(length: int) -> np.ndarray:
    """[seen, seeing]: 1 where a token is seen by another: by itself and by what is behind it."""
    if length not in _TRIANGLES:
        _TRIANGLES[length] = np.ascontiguousarray(np.tri(length, dtype=np.float32).T)
    return _TRIANGLES[length]


def _sums(z: np.ndarray) -> np.ndarray:
    """The sum of each row; a product is faster than sum() where rows are short."""
    return z @ np.ones(z.shape[1], z.dtype)


def _over_ones(rows: int, columns: int, dtype) -> np.ndarray:
    """Room for rows, above one of ones: what multiplies it is added, or summed, by the same product."""
    out = np.empty((rows + 1, columns), dtype)
    out[-1] = 1
    return out


def _windows(z: np.ndarray, length: int) -> np.ndarray:
    """[window, row, place] of [row, place of a window of all]."""
    return z.reshape(len(z), -1, length).transpose(1, 0, 2)


def _scaled(w: dict) -> np.ndarray:
    """Q, the part that asks by the root of the width."""
    d, scaled = w["O"].shape[0], w["Q"].copy()
    scaled[:, :d] *= d**-0.5
    return scaled


def _states(w: dict, slots: np.ndarray, careful: bool):
    """All have a column for each place: numpy is slow over many short rows. s is [window, seen, seeing], not divided by its sums."""
    length, d = slots.shape[1], w["O"].shape[0]
    x = np.ascontiguousarray(w["E"].take(slots.ravel(), 0).T)
    x.reshape(d, -1, length)[:] += w["P"][:length].T[:, None]
    q = _over_ones(3 * d, slots.size, x.dtype)
    np.matmul(_scaled(w).T, x, out=q[:-1])
    each = _windows(q, length)
    s = each[:, d : 2 * d].transpose(0, 2, 1) @ each[:, :d]
    if careful:  # large exponents are kept apart
        s = np.where(_causal(length) > 0, s, -np.inf)
        s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    s *= _causal(length)
    seen = np.empty((d + 1, slots.size), x.dtype)
    np.matmul(each[:, 2 * d :], s, out=_windows(seen, length))
    share = 1 / seen[-1]
    a = seen[:-1]
    a *= share
    h = w["O"].T @ a
    h += x
    m = w["A"].T @ h
    np.maximum(m, 0, out=m)
    y = _over_ones(d, slots.size, x.dtype)
    np.add(w["B"].T @ m, h, out=y[:-1])
    return x, q, s, share, a, h, m, y


def _logits(w: dict, y: np.ndarray, slots: np.ndarray, prior: np.ndarray | None) -> np.ndarray:
    z = y.T @ np.concatenate([w["U"], w["b"][None]])
    if prior is not None:
        z += prior.take(slots.ravel(), 0)
    return z


def _places(z: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Where each row's target is in the whole of z; of -1, somewhere."""
    at = np.arange(0, z.size, z.shape[1])
    at += targets.ravel()
    return at


def log_probabilities(w: dict, slots: np.ndarray, targets: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """ln P(target class) at each place of each window; slots: what stood before each target."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        z = _logits(w, _states(w, slots, False)[-1], slots, prior)
        t = z.ravel().take(_places(z, targets))
        np.exp(z, out=z)
        out = (t - np.log(_sums(z))).reshape(slots.shape)
    if np.isfinite(out).all():
        return out
    z = _logits(w, _states(w, slots, True)[-1], slots, prior)
    z -= z.max(1, keepdims=True)
    t = z.ravel().take(_places(z, targets))
    np.exp(z, out=z)
    return (t - np.log(_sums(z))).reshape(slots.shape)


def loss_and_gradient(shape: Shape, flat: np.ndarray, slots: np.ndarray, targets: np.ndarray, prior: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Mean of -ln P(target) over all places with a target (others have -1), and its gradient."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        loss, gradient = _descent(shape, flat, slots, targets, prior, False)
    return (loss, gradient) if np.isfinite(loss) and np.isfinite(gradient).all() else _descent(shape, flat, slots, targets, prior, True)


def _descent(shape: Shape, flat: np.ndarray, slots: np.ndarray, targets: np.ndarray, prior, careful: bool) -> tuple[float, np.ndarray]:
    w = unflatten(shape, flat)
    n, length = slots.shape
    d = shape.d
    x, q, s, share, a, h, m, y = _states(w, slots, careful)
    p = _logits(w, y, slots, prior)
    if careful:
        p -= p.max(1, keepdims=True)
    there = targets.ravel() >= 0
    own = _places(p, targets)[there]
    flat_p = p.reshape(-1)
    count = max(1, len(own))
    chosen = flat_p.take(own)
    np.exp(p, out=p)
    total = _sums(p)
    loss = float((np.log(total[there]) - chosen).sum() / count)
    # p is the gradient by logits but for `scale`, which multiplies what p is multiplied with.
    flat_p[own] -= total[there]
    scale = (there / (total * count)).astype(p.dtype)
    dy = (y * scale) @ p
    out = {"U": dy[:-1], "b": dy[-1]}
    dh = w["U"] @ p.T
    dh *= scale
    out["B"] = m @ dh.T
    dm = w["B"] @ dh
    dm *= m > 0
    out["A"] = h @ dm.T
    dh += w["A"] @ dm
    out["O"] = a @ dh.T
    # The last row, by q's of ones, is what a state's own sum takes away.
    da = np.empty((d + 1, slots.size), dh.dtype)
    np.matmul(w["O"], dh, out=da[:-1])
    da[:-1] *= share
    np.sum(da[:-1] * a, 0, out=da[-1])
    da[-1] *= -1
    each, less = _windows(q, length), _windows(da, length)
    dq = np.empty((3 * d, slots.size), dh.dtype)
    by = _windows(dq, length)
    np.matmul(less[:, :d], s.transpose(0, 2, 1), out=by[:, 2 * d :])
    ds = each[:, 2 * d :].transpose(0, 2, 1) @ less
    ds *= s
    np.matmul(each[:, d : 2 * d], ds, out=by[:, :d])
    np.matmul(each[:, :d], ds.transpose(0, 2, 1), out=by[:, d : 2 * d])
    out["Q"] = x @ dq.T
    out["Q"][:, :d] *= d**-0.5
    dh += _scaled(w) @ dq
    out["P"] = np.zeros_like(w["P"])
    out["P"][:length] = dh.reshape(d, n, length).sum(1).T
    at = np.arange(0, w["E"].size, len(w["E"]))[:, None] + slots.ravel()
    out["E"] = np.bincount(at.ravel(), dh.ravel(), w["E"].size).reshape(d, -1).T
    return loss, np.concatenate([out[k].ravel() for k in shape.parts()]).astype(np.float32)


class Adam:
    """Adam on one network, a batch of windows at a time."""

    def __init__(self, shape: Shape, flat: np.ndarray, prior: np.ndarray | None = None):
        self.shape, self.flat, self.prior, self.done = shape, flat.copy(), prior, 0
        self.first, self.second = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, slots: np.ndarray, targets: np.ndarray, rate: float) -> None:
        _, g = loss_and_gradient(self.shape, self.flat, slots, targets, self.prior)
        self.done += 1
        self.first *= 0.9
        self.first += 0.1 * g
        g *= g
        g *= 0.01
        self.second *= 0.99
        self.second += g
        np.sqrt(self.second, out=g)
        g *= (1 - 0.99**self.done) ** -0.5
        g += 1e-8
        np.divide(self.first, g, out=g)
        g *= rate / (1 - 0.9**self.done)
        self.flat -= g
