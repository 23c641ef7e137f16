"""A bidirectional LSTM over signs with a CRF on top, in numpy: training by Adam, label marginals.

Both directions run in one loop, as a leading axis of two. The network is float32, the CRF float64 in scaled
probabilities. Sequences of a batch have equal length; labels that may not follow each other have no weight in
the CRF's transitions.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Tagger:
    """``weights``: name -> array. ``allowed``: which label may follow which; ``first``: which may begin."""

    def __init__(self, signs: int, allowed: np.ndarray, first: np.ndarray, size: int = 20, embed: int = 12, seed: int = 7,
                 kind: type = np.float32):
        rng, k = np.random.default_rng(seed), len(first)
        self.size, self.allowed, self.first = size, allowed, first
        w = {"embed": rng.normal(0, 0.3, (signs, embed)), "out": rng.normal(0, 0.2, (2 * size, k)), "bias": np.zeros(k),
             "trans": np.zeros((k, k)), "start": np.zeros(k),
             "x": rng.normal(0, 1 / np.sqrt(embed), (2, embed, 4 * size)),
             "h": rng.normal(0, 1 / np.sqrt(size), (2, size, 4 * size)),
             "c": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], size), (2, 1))}  # gates: in, forget, out, new
        self.weights = {name: a.astype(kind) for name, a in w.items()}

    # ---------------------------------------------------------------- network

    def _states(self, signs: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Embedded signs and hidden states, (2, time, batch, ...), the second direction from the end."""
        w, s = self.weights, self.size
        x = w["embed"][signs.T]
        x = np.stack([x, x[::-1]])
        into = x @ w["x"][:, None] + w["c"][:, None, None]
        h = c = np.zeros((2, len(signs), s), into.dtype)
        out = np.empty((*into.shape[:3], s), into.dtype)
        for t in range(into.shape[1]):
            z = into[:, t] + h @ w["h"]
            gates, new = _sigmoid(z[..., :3 * s]), np.tanh(z[..., 3 * s:])
            was_h, was_c = h, c
            c = gates[..., s:2 * s] * c + gates[..., :s] * new
            th = np.tanh(c)
            out[:, t] = h = gates[..., 2 * s:] * th
            if keep is not None:
                keep.append((gates, new, was_h, was_c, th))
        return x, out

    def _back(self, x: np.ndarray, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient of the embedded signs."""
        s, w = self.size, self.weights
        d_h = d_c = np.zeros_like(d_out[:, 0])
        d_into, d_hh, turned = np.empty((*d_out.shape[:3], 4 * s), d_out.dtype), np.zeros_like(w["h"]), w["h"].transpose(0, 2, 1)
        for t in range(d_out.shape[1] - 1, -1, -1):
            gates, new, was_h, was_c, th = kept[t]
            i, f, o = gates[..., :s], gates[..., s:2 * s], gates[..., 2 * s:]
            d_h = d_h + d_out[:, t]
            d_c = d_c + d_h * o * (1 - th * th)
            z = np.concatenate([d_c * new, d_c * was_c, d_h * th, d_c * i], axis=-1)
            z[..., :3 * s] *= gates * (1 - gates)
            z[..., 3 * s:] *= 1 - new * new
            d_into[:, t] = z
            d_hh += was_h.transpose(0, 2, 1) @ z
            d_h, d_c = z @ turned, d_c * f
        flat = d_into.reshape(2, -1, 4 * s)
        grads["x"], grads["h"], grads["c"] = x.reshape(2, -1, x.shape[3]).transpose(0, 2, 1) @ flat, d_hh, flat.sum(1)
        d_x = d_into @ w["x"].transpose(0, 2, 1)[:, None]
        return d_x[0] + d_x[1, ::-1]

    def _both(self, states: np.ndarray) -> np.ndarray:
        return np.concatenate([states[0], states[1, ::-1]], axis=2)

    # ---------------------------------------------------------------- CRF

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """(forward, backward, scales, likelihoods, transitions, log total) of emissions (time, batch, labels)."""
        e = e.astype(np.float64)
        top = e.max(axis=2, keepdims=True)
        ex, trans = np.exp(e - top), np.where(self.allowed, np.exp(self.weights["trans"].astype(np.float64)), 0.0)
        a, b, c = np.empty_like(ex), np.ones_like(ex), np.empty((len(ex), ex.shape[1], 1))
        now = np.where(self.first, np.exp(self.weights["start"].astype(np.float64)), 0.0) * ex[0]
        for t in range(len(ex)):
            now = now if t == 0 else (a[t - 1] @ trans) * ex[t]
            c[t] = now.sum(1, keepdims=True)
            a[t] = now / c[t]
        for t in range(len(ex) - 2, -1, -1):
            b[t] = (ex[t + 1] * b[t + 1] / c[t + 1]) @ trans.T
        return a, b, c, ex, trans, (np.log(c) + top).sum((0, 2))

    def marginals(self, signs: np.ndarray) -> np.ndarray:
        """Probability of each label at each sign of (batch, time): (batch, time, labels)."""
        w = self.weights
        a, b, *_ = self._sums(self._both(self._states(signs)[1]) @ w["out"] + w["bias"])
        return (a * b).transpose(1, 0, 2)

    # ---------------------------------------------------------------- training

    def gradients(self, signs: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of (batch, time) labels, and its gradients."""
        w, n, y, kept = self.weights, len(signs), labels.T, []
        x, states = self._states(signs, kept)
        both = self._both(states)
        e = both @ w["out"] + w["bias"]
        a, b, c, ex, trans, total = self._sums(e)
        d_e = a * b
        gold = np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + w["start"][y[0]] + w["trans"][y[:-1], y[1:]].sum(0)
        d_start = d_e[0].sum(0)
        np.subtract.at(d_start, y[0], 1.0)
        d_trans = trans * np.einsum("tni,tnj->ij", a[:-1], ex[1:] * b[1:] / c[1:], optimize=True)
        np.subtract.at(d_trans, (y[:-1], y[1:]), 1.0)
        np.put_along_axis(d_e, y[:, :, None], np.take_along_axis(d_e, y[:, :, None], 2) - 1.0, 2)
        d_e, s = (d_e / n).astype(e.dtype), self.size
        grads = {"out": both.reshape(-1, 2 * s).T @ d_e.reshape(-1, e.shape[2]), "bias": d_e.sum((0, 1)),
                 "trans": np.where(self.allowed, d_trans, 0.0) / n, "start": np.where(self.first, d_start, 0.0) / n}
        d_both = d_e @ w["out"].T
        d_x = self._back(x, kept, np.stack([d_both[..., :s], d_both[::-1, :, s:]]), grads)
        grads["embed"] = np.zeros_like(w["embed"])
        np.add.at(grads["embed"], signs.T, d_x)
        return float((total - gold).mean()), grads

    def train(self, signs: np.ndarray, labels: np.ndarray, steps: int, batch: int = 64, rate: float = 0.015,
              seed: int = 11) -> float:
        """Adam over shuffled batches, the rate falling to a tenth; the last tenth's mean loss."""
        rng, first, second, losses = np.random.default_rng(seed), {}, {}, []
        order = np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(signs))])
            some, order = order[:batch], order[batch:]
            loss, grads = self.gradients(signs[some], labels[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lr = rate * (1 - 0.9 * step / steps)
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-12))
                m = first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                v = second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                self.weights[name] -= (lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(
                    self.weights[name].dtype)
        return float(np.mean(losses[-max(1, steps // 10):]))
