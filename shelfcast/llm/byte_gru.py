"""A bidirectional gated recurrent network over bytes in numpy, with backpropagation through time.

Each direction reads a window of bytes; their states at a position give that position's label probabilities.
The input weights are a table of 256 rows, as a byte is one-hot.
"""

from __future__ import annotations

import numpy as np

WINDOW = 64  # bytes read by one pass of the network


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def new_weights(n_labels: int, hidden: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Per direction d: table_d (input of gates z, r and state n), states_d (U of z, r), inner_d (U of n)."""
    random = np.random.default_rng(seed)
    normal = lambda *shape: (random.standard_normal(shape) * 0.3).astype(np.float32)
    weights = {"out": normal(2 * hidden, n_labels), "bias": np.zeros(n_labels, np.float32)}
    for d in "fb":
        weights |= {f"table_{d}": normal(256, 3 * hidden), f"states_{d}": normal(hidden, 2 * hidden), f"inner_{d}": normal(hidden, hidden)}
    return weights


def _run(weights: dict, d: str, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps, batch, hidden) of one direction over codes (batch, steps)."""
    table, states, inner = weights[f"table_{d}"], weights[f"states_{d}"], weights[f"inner_{d}"]
    size = inner.shape[0]
    batch, steps = codes.shape
    h = np.zeros((batch, size), np.float32)
    out, tape = np.empty((steps, batch, size), np.float32), []
    both = np.concatenate([states, inner], axis=1)
    columns = np.ascontiguousarray(codes.T)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = table[columns[t]]
        u = h @ both
        gates = x[:, : 2 * size] + u[:, : 2 * size]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :size], gates[:, size:]
        n = np.tanh(x[:, 2 * size :] + r * u[:, 2 * size :])
        new = n + z * (h - n)
        if keep:
            tape.append((t, h, z, r, n, u[:, 2 * size :]))
        out[t] = h = new
    return out, tape


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def label_positions(weights: dict, codes: np.ndarray) -> np.ndarray:
    """Label probabilities (steps, labels, batch) of every position of codes (batch, steps).

    The same network as in training, laid out by feature so that each gate is contiguous; tanh(x) is written as
    2 sigmoid(2x) - 1, which numpy computes much faster.
    """
    batch, steps = codes.shape
    size = weights["inner_f"].shape[0]
    columns = np.ascontiguousarray(codes.T)
    logits = np.empty((steps, len(weights["bias"]), batch), np.float32)
    logits[:] = weights["bias"][None, :, None]
    for k, d in enumerate("fb"):
        table = np.ascontiguousarray(weights[f"table_{d}"].T)
        table[2 * size :] *= 2
        both = np.ascontiguousarray(np.concatenate([weights[f"states_{d}"], 2 * weights[f"inner_{d}"]], axis=1).T)
        out = np.ascontiguousarray(weights["out"][k * size : (k + 1) * size].T)
        h = np.zeros((size, batch), np.float32)
        x, u = np.empty((3 * size, batch), np.float32), np.empty((3 * size, batch), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, columns[t], axis=1, out=x, mode="clip")
            np.matmul(both, h, out=u)
            gates, n, inner = x[: 2 * size], x[2 * size :], u[2 * size :]
            gates += u[: 2 * size]
            _sigmoid(gates)
            inner *= gates[size:]
            n += inner
            _sigmoid(n)
            n *= 2
            n -= 1
            h -= n
            h *= gates[:size]
            h += n
            logits[t] += out @ h
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def loss_and_gradient(weights: dict, codes: np.ndarray, labels: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the real positions, and its gradient through time.

    codes, real: (batch, steps); labels: (batch,).
    """
    grad = {k: np.zeros_like(v) for k, v in weights.items()}
    runs = {d: _run(weights, d, codes, True) for d in "fb"}
    states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
    p = _softmax(states @ weights["out"] + weights["bias"])
    rows = np.arange(len(labels))
    share = (real.T / max(1.0, real.sum())).astype(np.float32)
    loss = float(-(np.log(p[:, rows, labels] + 1e-9) * share).sum())
    p[:, rows, labels] -= 1
    p *= share[:, :, None]
    grad["out"] = np.einsum("tbh,tbl->hl", states, p)
    grad["bias"] = p.sum(axis=(0, 1))
    back = p @ weights["out"].T
    size = weights["inner_f"].shape[0]
    for k, d in enumerate("fb"):
        states_w, inner = weights[f"states_{d}"], weights[f"inner_{d}"]
        dh = np.zeros((len(labels), size), np.float32)
        for t, h, z, r, n, u in reversed(runs[d][1]):
            dh = dh + back[t][:, k * size : (k + 1) * size]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=1)
            np.add.at(grad[f"table_{d}"], codes[:, t], np.concatenate([gates, dn], axis=1))
            grad[f"states_{d}"] += h.T @ gates
            grad[f"inner_{d}"] += h.T @ (dn * r)
            dh = dh * z + gates @ states_w.T + (dn * r) @ inner.T
    return loss, grad


def train(windows: np.ndarray, real: np.ndarray, labels: np.ndarray, n_labels: int, hidden: int, rounds: int, batch: int = 192) -> dict:
    """Adam on random batches of windows, every label equally often; deterministic."""
    weights, random = new_weights(n_labels, hidden), np.random.default_rng(5)
    groups = [np.flatnonzero(labels == k) for k in range(n_labels)]
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for turn in range(1, rounds + 1):
        picks = np.concatenate([random.choice(g, max(1, batch // n_labels)) for g in groups if len(g)])
        _, grad = loss_and_gradient(weights, windows[picks], labels[picks], real[picks])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2.0 * (1 - turn / (rounds + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            step = (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
            weights[k] = (weights[k] - rate * step).astype(np.float32)
    return weights
