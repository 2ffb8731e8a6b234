"""A bidirectional gated recurrent network in numpy, with backpropagation through time and Adam.

Sequences are rows of symbols.  Each symbol has a row of gate inputs, one per direction, so the input product is a table
lookup.  The last row of a table is padding: its update gate is held open for the old state, so a padded position leaves
the state as it is and no mask is needed inside the recurrence.
"""

from __future__ import annotations

import numpy as np

_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, _F(0.5), out=x)
    np.tanh(x, out=x)
    x *= _F(0.5)
    x += _F(0.5)
    return x


def pad_rows(gates: np.ndarray) -> np.ndarray:
    """Gate inputs ``[2, n, 3h]`` with the padding row appended."""
    pad = np.zeros((2, 1, gates.shape[2]), _F)
    pad[..., : gates.shape[2] // 3] = 60
    return np.concatenate([gates, pad], axis=1)


def states(symbols: np.ndarray, gates: np.ndarray, u: np.ndarray, bn: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States ``[t, b, 2h]`` of both directions for symbols ``[b, t]``; ``tape`` collects what backpropagation needs.

    The three gates live in arrays of their own, so every elementwise step runs over contiguous memory.
    """
    b, steps = symbols.shape
    k = u.shape[1]
    flat = gates.reshape(-1, 3 * k)
    gz, gr, gn = (np.ascontiguousarray(flat[:, i * k : (i + 1) * k]) for i in range(3))
    uz, ur, un = (np.ascontiguousarray(u[..., i * k : (i + 1) * k]) for i in range(3))
    order = np.stack([symbols.T, symbols.T[::-1] + gates.shape[1]], axis=1).reshape(steps, -1)
    out = np.empty((steps, b, 2 * k), _F)
    h = np.zeros((2, b, k), _F)
    buf = np.empty_like(h)
    for t in range(steps):
        z = gz.take(order[t], axis=0).reshape(2, b, k)
        z += np.matmul(h, uz, out=buf)
        _sigmoid(z)
        r = gr.take(order[t], axis=0).reshape(2, b, k)
        r += np.matmul(h, ur, out=buf)
        _sigmoid(r)
        v = np.matmul(h, un) + bn
        n = gn.take(order[t], axis=0).reshape(2, b, k)
        n += np.multiply(r, v, out=buf)
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if tape is not None:
            tape.append((h, z, r, v, n))
        h = new
        out[t, :, :k], out[steps - 1 - t, :, k:] = h[0], h[1]
    return out


def gradients(symbols: np.ndarray, gates_shape: tuple, u: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the gate table, ``u`` and ``bn`` for the gradient ``[t, b, 2h]`` of the states."""
    h_size, steps = u.shape[1], len(tape)
    order = np.stack([symbols.T, symbols.T[::-1] + gates_shape[1]], axis=1)
    du, dbn = np.zeros_like(u), np.zeros((2, 1, h_size), _F)
    dx_all = np.empty((steps, 2, symbols.shape[0], 3 * h_size), _F)
    dh = np.zeros((2, symbols.shape[0], h_size), _F)
    for t in reversed(range(steps)):
        h, z, r, un, n = tape[t]
        dh = dh + np.stack([d_out[t, :, :h_size], d_out[steps - 1 - t, :, h_size:]])
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dg = np.concatenate([dz, dr, dn * r], axis=2)
        dx_all[t] = np.concatenate([dz, dr, dn], axis=2)
        du += np.swapaxes(h, 1, 2) @ dg
        dbn += (dn * r).sum(axis=1, keepdims=True)
        dh = dh * z + dg @ np.swapaxes(u, 1, 2)
    d_gates = np.zeros((gates_shape[0] * gates_shape[1], gates_shape[2]), _F)
    sort = np.argsort(order.ravel(), kind="stable")
    keys = order.ravel()[sort]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    d_gates[keys[first]] = np.add.reduceat(dx_all.reshape(-1, 3 * h_size)[sort], first, axis=0)
    return d_gates.reshape(gates_shape), du, dbn


class Adam:
    """Adam with clipped gradients.  Tables named in ``plain`` take plain steps of ``plain_rate`` instead: Adam would lift
    the rare gradients of rare symbols to full size, and a small sample would be learnt by heart."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, plain: tuple[str, ...] = (), plain_rate: float = 0.0):
        self.params, self.rate, self.n, self.plain, self.plain_rate = params, rate, 0, plain, plain_rate
        self.m = {k: np.zeros_like(v) for k, v in params.items() if k not in plain}
        self.v = {k: np.zeros_like(v) for k, v in params.items() if k not in plain}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * _F(clip)
            if k in self.plain:
                self.params[k] -= _F(self.plain_rate) * g
                continue
            self.m[k] += _F(0.1) * (g - self.m[k])
            self.v[k] += _F(0.01) * (g * g - self.v[k])
            hat = self.v[k] / _F(1 - 0.99**self.n)
            self.params[k] -= _F(self.rate / (1 - 0.9**self.n)) * self.m[k] / (np.sqrt(hat) + _F(1e-7))


def recurrent_params(rng: np.random.Generator, h: int) -> dict[str, np.ndarray]:
    return {"u": (rng.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(_F), "bn": np.zeros((2, 1, h), _F)}
