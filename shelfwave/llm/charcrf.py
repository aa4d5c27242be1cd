"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

CODES = 130  # ASCII, 128 for every other character, 129 for padding
PAD = 129
NEVER = -1e4


def codes_of(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 128, c, 128).astype(np.int16)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Tags 0 (outside), then begin and inside of each kind. A padded window holds its characters first."""

    def __init__(self, kinds: int, hidden: int = 20, width: int = 14, seed: int = 5):
        r = np.random.default_rng(seed)
        self.kinds, self.tags, self.hidden = kinds, 2 * kinds + 1, hidden
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": (r.standard_normal((CODES, width)) * .5).astype(np.float32), "out": draw(2 * hidden, self.tags), "bias": np.zeros(self.tags, np.float32), "move": np.zeros((self.tags, self.tags), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(width, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"c{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)}
        self.allowed = np.full((self.tags, self.tags), NEVER)
        self.allowed[:, 0] = self.allowed[:, 1::2] = 0
        for k in range(kinds):
            self.allowed[2 * k + 1, 2 * k + 2] = self.allowed[2 * k + 2, 2 * k + 2] = 0
        self.first = np.where(np.arange(self.tags) % 2 == 0, NEVER, 0.0)
        self.first[0] = 0

    def emissions(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """(windows, time, tags) scores; `tape` keeps what the gradient needs."""
        p, n = self.p, self.hidden
        emb, real, outs = p["embed"][x], (x != PAD).astype(np.float32), []
        for d in "fb":
            pre = emb @ p[f"x{d}"] + p[f"c{d}"]
            h = c = np.zeros((len(x), n), np.float32)
            hs, saved = np.zeros((*x.shape, n), np.float32), []
            for t in (range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)):
                g = pre[:, t] + h @ p[f"h{d}"]
                s, u = _sigmoid(g[:, :3 * n]), np.tanh(g[:, 3 * n:])
                i, f, o = s[:, :n], s[:, n:2 * n], s[:, 2 * n:]
                m, before = real[:, t, None], (h, c)
                c = (f * c + i * u) * m
                tc = np.tanh(c)
                h = o * tc * m
                hs[:, t] = h
                if tape is not None:
                    saved.append((t, i, f, o, u, tc, before, m))
            outs.append(hs)
            if tape is not None:
                tape.append(saved)
        both = np.concatenate(outs, axis=2)
        if tape is not None:
            tape += [emb, both]
        return both @ p["out"] + p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood a window and its gradients."""
        tape: list = []
        e = self.emissions(x, tape).astype(np.float64)
        size, length = x.shape
        real = x != PAD
        last = real.sum(axis=1) - 1
        move = self.p["move"].astype(np.float64) + self.allowed
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.first
        for t in range(1, length):
            step = _lse(alpha[:, t - 1, :, None] + move[None], 1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = _lse(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = _lse(alpha[np.arange(size), last], 1)
        unary = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        gold = np.eye(self.tags)[y] * real[:, :, None]
        de = ((unary - gold) / size).astype(np.float32)
        pair = real[:, 1:]
        joint = np.exp(alpha[:, :-1, :, None] + move[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair[:, :, None, None]
        dmove = joint.sum(axis=(0, 1))
        np.subtract.at(dmove, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        score = (e * gold).sum() + self.first[y[:, 0]].sum() + move[y[:, :-1][pair], y[:, 1:][pair]].sum()
        grads = {"move": (np.where(self.allowed < 0, 0, dmove) / size).astype(np.float32)}
        emb, both = tape[2:]
        flat, dflat = both.reshape(-1, both.shape[2]), de.reshape(-1, self.tags)
        grads["out"], grads["bias"] = flat.T @ dflat, dflat.sum(axis=0)
        dboth, n, demb = de @ self.p["out"].T, self.hidden, np.zeros_like(emb)
        for k, d in enumerate("fb"):
            dh = dc = np.zeros((size, n), np.float32)
            dg = np.zeros((size, length, 4 * n), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            for t, i, f, o, u, tc, (h0, c0), m in reversed(tape[k]):
                dh = (dh + dboth[:, t, k * n:(k + 1) * n]) * m
                dct = (dc + dh * o * (1 - tc * tc)) * m
                g = np.concatenate([dct * u * i * (1 - i), dct * c0 * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - u * u)], axis=1)
                gh += h0.T @ g
                dh, dc = g @ self.p[f"h{d}"].T, dct * f
                dg[:, t] = g
            grads[f"h{d}"], grads[f"c{d}"] = gh, dg.sum(axis=(0, 1))
            grads[f"x{d}"] = emb.reshape(-1, emb.shape[2]).T @ dg.reshape(-1, 4 * n)
            demb += dg @ self.p[f"x{d}"].T
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], x.ravel(), demb.reshape(-1, demb.shape[2]))
        return float((total.sum() - score) / size), grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 7, batch: int = 48, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam with a falling rate; returns the mean loss of each epoch. The same rows in the same order give the same model."""
        r, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, seen = r.permutation(len(x)), []
            for k in range(0, len(x), batch):
                pick = order[k:k + batch]
                loss, grads = self.gradients(x[pick], y[pick])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                now = rate * (1 - .9 * step / steps)
                for name, g in grads.items():
                    g = g * min(1.0, 5 / max(norm, 1e-9))
                    m[name] = .9 * m[name] + .1 * g
                    v[name] = .999 * v[name] + .001 * g * g
                    self.p[name] -= now * (m[name] / (1 - .9 ** step)) / (np.sqrt(v[name] / (1 - .999 ** step)) + 1e-8)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def best_tags(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi over (sequences, time, tags); tags past a length are 0."""
        move = self.p["move"] + self.allowed
        score, back = e[:, 0] + self.first, np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            paths = score[:, :, None] + move[None]
            back[:, t] = paths.argmax(axis=1)
            score = np.where((t < lengths)[:, None], paths.max(axis=1) + e[:, t], score)
        out, tag = np.zeros(e.shape[:2], np.int8), score.argmax(axis=1)
        rows = np.arange(len(e))
        for t in range(e.shape[1] - 1, -1, -1):
            live = t < lengths
            out[:, t] = np.where(live, tag, 0)
            tag = np.where(live & (t > 0), back[rows, t, tag], tag)
        return out
