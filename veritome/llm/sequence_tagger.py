"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Windows are integer arrays (batch, length) of character classes and tags.
Training minimises the CRF's negative log-likelihood with Adam; decoding is Viterbi.
"""

from __future__ import annotations

import numpy as np

#: Character classes: 0 pads, 1..127 ASCII, then letters and everything else beyond ASCII.
PAD, LETTER, OTHER = 0, 128, 129
CLASSES = 130


def classes(points: np.ndarray) -> np.ndarray:
    """Classes of code points."""
    return np.where(points < 128, np.maximum(points, 1), np.where(points < 0x2000, LETTER, OTHER)).astype(np.int16)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states (length, batch, hidden) of inputs (length, batch, width); with ``keep`` what the gradient needs."""
    n, batch, hidden = x.shape[0], x.shape[1], u.shape[0]
    xs = x @ w + b
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out, tape = np.empty((n, batch, hidden), np.float32), []
    for t in range(n):
        z = xs[t] + h @ u
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            tape.append((i, f, o, g, before, tc, h_before))
    return out, tape


def _lstm_gradient(d_out: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, tape: list):
    n, batch, hidden = d_out.shape
    dz = np.empty((n, batch, 4 * hidden), np.float32)
    dh, dc = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    du = np.zeros_like(u)
    for t in range(n - 1, -1, -1):
        i, f, o, g, before, tc, h_before = tape[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        du += h_before.T @ dz[t]
        dh = dz[t] @ u.T
        dc = dc * f
    flat = dz.reshape(-1, dz.shape[2])
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    def __init__(self, tags: int, width: int = 12, hidden: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": draw(CLASSES, width) * 3, "start": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32), "out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32)}
        for side in ("f", "b"):
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1.0  # open forget gates
            self.p |= {f"w{side}": draw(width, 4 * hidden), f"u{side}": draw(hidden, 4 * hidden), f"b{side}": b}

    def emissions(self, x: np.ndarray, keep: bool = False):
        p = self.p
        e = p["embed"][x.T]
        hf, tf = _lstm(e, p["wf"], p["uf"], p["bf"], keep)
        hb, tb = _lstm(e[::-1], p["wb"], p["ub"], p["bb"], keep)
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ p["out"] + p["bias"], (e, h, tf, tb)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of a batch and its gradients."""
        p, (batch, n) = self.p, x.shape
        em, (e, h, tf, tb) = self.emissions(x, True)
        move, y = p["move"], y.T
        alpha, beta = np.empty(em.shape), np.zeros(em.shape)
        alpha[0] = p["start"] + em[0]
        for t in range(1, n):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + move[None], 1) + em[t]
        for t in range(n - 2, -1, -1):
            beta[t] = _logsum(move[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _logsum(alpha[-1], 1)
        rows = np.arange(batch)
        gold = p["start"][y[0]] + em[0][rows, y[0]]
        d_em = np.exp(alpha + beta - log_z[None, :, None])
        d_move, d_start = np.zeros(move.shape), d_em[0].sum(0)
        np.subtract.at(d_start, y[0], 1)
        d_em[0][rows, y[0]] -= 1
        for t in range(1, n):
            gold = gold + move[y[t - 1], y[t]] + em[t][rows, y[t]]
            d_em[t][rows, y[t]] -= 1
            d_move += np.exp(alpha[t - 1][:, :, None] + move[None] + (em[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(0)
            np.subtract.at(d_move, (y[t - 1], y[t]), 1)
        d_em = (d_em / batch).astype(np.float32)
        grad = {"start": d_start / batch, "move": d_move / batch, "bias": d_em.sum((0, 1)), "out": h.reshape(-1, h.shape[2]).T @ d_em.reshape(-1, d_em.shape[2])}
        dh, hidden = d_em @ p["out"].T, h.shape[2] // 2
        de, grad["wf"], grad["uf"], grad["bf"] = _lstm_gradient(dh[:, :, :hidden], e, p["wf"], p["uf"], tf)
        db, grad["wb"], grad["ub"], grad["bb"] = _lstm_gradient(dh[::-1, :, hidden:], e[::-1], p["wb"], p["ub"], tb)
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], x.T, de + db[::-1])
        return float((log_z - gold).mean()), grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        rng, m, v, k, losses = np.random.default_rng(seed), {}, {}, 0, []
        steps = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                some, k = order[lo : lo + batch], k + 1
                loss, grad = self.loss(x[some], y[some])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step = rate * (1 - k / (steps + 1))
                for name, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                    self.p[name] = (self.p[name] - step * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely tags (batch, length)."""
        em, _ = self.emissions(x)
        score, back = self.p["start"] + em[0], []
        for t in range(1, len(em)):
            options = score[:, :, None] + self.p["move"][None]
            back.append(options.argmax(1))
            score = options.max(1) + em[t]
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(len(back), 0, -1):
            tags[:, t - 1] = np.take_along_axis(back[t - 1], tags[:, t][:, None], 1)[:, 0]
        return tags
