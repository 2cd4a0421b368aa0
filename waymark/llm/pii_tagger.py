"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are mapped to a small alphabet of classes. Training minimises the CRF's negative
log likelihood over windows with known tags (begin / inside of each kind, or outside).
"""

from __future__ import annotations

import numpy as np

#: The kinds that have a pattern, and after them one that only the tagger finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 64, 32
_PUNCT = " \n.,@+-_%()[]:;=/\"'|<>#*&!?"
_PAD, _LOWER, _UPPER, _DIGIT, _WIDE, _OTHER = range(6)
CLASSES = 6 + len(_PUNCT)


def _class_table() -> np.ndarray:
    table = np.full(129, _OTHER, np.int64)
    table[128] = _WIDE
    table[97:123], table[65:91], table[48:58] = _LOWER, _UPPER, _DIGIT
    for i, c in enumerate(_PUNCT):
        table[ord(c)] = 6 + i
    return table


_TABLE = _class_table()


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point; everything beyond ASCII is one class."""
    return _TABLE[np.minimum(points, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: (time, batch, 4h) input parts of the gates."""
    steps, batch, width = x.shape
    h = width // 4
    state, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
    out, cache = np.empty((steps, batch, h), np.float32), []
    for t in range(steps):
        g = x[t] + state @ u
        gates = _sigmoid(g[:, : 3 * h])
        i, f, o, z = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(g[:, 3 * h :])
        before, prior = cell, state
        cell = f * cell + i * z
        tc = np.tanh(cell)
        state = o * tc
        out[t] = state
        if keep:
            cache.append((i, f, o, z, before, tc, prior))
    return out, cache


def _lstm_back(d_out: np.ndarray, cache: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, h = d_out.shape
    dx, du = np.empty((steps, batch, 4 * h), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, z, before, tc, prior = cache[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        g = dx[t]
        g[:, :h], g[:, h : 2 * h] = dc * z * i * (1 - i), dc * before * f * (1 - f)
        g[:, 2 * h : 3 * h], g[:, 3 * h :] = dh * tc * o * (1 - o), dc * i * (1 - z * z)
        dc = dc * f
        du += prior.T @ g
        dh = g @ u.T
    return dx, du


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    def __init__(self, width: int = 16, embed: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {"emb": draw(CLASSES, embed) * 2, "out": draw(2 * width, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(embed, 4 * width), f"u{d}": draw(width, 4 * width), f"c{d}": np.zeros(4 * width, np.float32)}
            self.p[f"c{d}"][width : 2 * width] = 1

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: (batch, time) classes; (time, batch, tags) scores."""
        p = self.p
        gates = {d: p["emb"] @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}
        xt = x.T
        hf, kf = _lstm(gates["f"][xt], p["uf"], keep)
        hb, kb = _lstm(gates["b"][xt[::-1]], p["ub"], keep)
        hidden = np.concatenate([hf, hb[::-1]], axis=2)
        e = hidden @ p["out"] + p["bias"]
        return (e, (xt, hidden, kf, kb)) if keep else e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, (steps, batch) = self.p, x.T.shape
        e, (xt, hidden, kf, kb) = self.emissions(x, True)
        a, yt = p["trans"], y.T
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + a, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - total[:, None])
        at_t, at_b = np.arange(steps)[:, None], np.arange(batch)
        gold = e[at_t, at_b, yt].sum(axis=0) + a[yt[:-1], yt[1:]].sum(axis=0)
        de[at_t, at_b, yt] -= 1
        da = np.zeros_like(a)
        for t in range(steps - 1):
            da += np.exp(alpha[t][:, :, None] + a + (e[t + 1] + beta[t + 1] - total[:, None])[:, None, :]).sum(axis=0)
        np.subtract.at(da, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        flat = hidden.reshape(-1, hidden.shape[2])
        g = {"out": flat.T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1)), "trans": da, "emb": np.zeros_like(p["emb"])}
        dh, h = de @ p["out"].T, hidden.shape[2] // 2
        for d, cache, dd, xs in (("f", kf, dh[:, :, :h], xt), ("b", kb, dh[::-1, :, h:], xt[::-1])):
            dx, g[f"u{d}"] = _lstm_back(dd, cache, p[f"u{d}"])
            by_class = np.zeros((CLASSES, dx.shape[2]), np.float32)
            np.add.at(by_class, xs.ravel(), dx.reshape(-1, dx.shape[2]))
            g[f"w{d}"], g[f"c{d}"] = p["emb"].T @ by_class, by_class.sum(axis=0)
            g["emb"] += by_class @ p[f"w{d}"].T
        return float((total - gold).mean()), {k: v / batch for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over shuffled batches; the last epoch's mean loss."""
        rng, m, v, n, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for lo in range(0, len(x), batch):
                pick = order[lo : lo + batch]
                loss, grads = self.gradients(x[pick], y[pick])
                losses.append(loss)
                n += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    step = rate * (1 - 0.8 * epoch / epochs)
                    self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """The probability of every tag at every place of one region, by forward and backward sums."""
        a = self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, len(e)):
            alpha[t] = _lse(alpha[t - 1][:, None] + a, 0) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _lse(a + (e[t + 1] + beta[t + 1])[None, :], 1)
        return np.exp(alpha + beta - _lse(alpha[-1], 0))

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each region's (length, tags) scores; regions of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order, a = sorted(range(len(scores)), key=lambda i: len(scores[i])), self.p["trans"]
        for lo in range(0, len(order), 256):
            pick = order[lo : lo + 256]
            longest = max(len(scores[i]) for i in pick)
            e = np.zeros((longest, len(pick), TAGS), np.float32)
            for j, i in enumerate(pick):
                e[: len(scores[i]), j] = scores[i]
            last = np.array([len(scores[i]) - 1 for i in pick])
            best, back = e[0], np.zeros((longest, len(pick), TAGS), np.int8)
            tag = best.argmax(axis=1)
            for t in range(1, longest):
                s = best[:, :, None] + a
                back[t] = s.argmax(axis=1)
                best = s.max(axis=1) + e[t]
                tag = np.where(last == t, best.argmax(axis=1), tag)  # a shorter region ends before
            tags = np.empty((longest, len(pick)), np.int64)
            for t in range(longest - 1, -1, -1):
                tags[t] = tag
                tag = np.where(t <= last, back[t][np.arange(len(pick)), tag], tag)
            for j, i in enumerate(pick):
                out[i] = tags[: len(scores[i]), j]
        return out
