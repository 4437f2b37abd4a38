"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time and
inference over whole texts. Both directions run side by side on the leading axis of every array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Hidden units of a direction, and bytes of a window. A text is cut into windows; every byte is in one. Both
#: directions run in over CONTEXT more bytes, whose labels are not counted.
UNITS, WINDOW, CONTEXT = 8, 128, 32
#: Windows that run at once.
LANES = 2048


@dataclass
class Model:
    """wg, wn: what a byte adds to the two gates and to the candidate; ug, un: recurrent; bn: bias of the
    recurrent candidate term; v, c: from both states to the label scores. Axis 0 is the direction."""

    wg: np.ndarray
    wn: np.ndarray
    ug: np.ndarray
    un: np.ndarray
    bn: np.ndarray
    v: np.ndarray
    c: np.ndarray
    labels: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [self.wg, self.wn, self.ug, self.un, self.bn, self.v, self.c]


def fresh(labels: list[str], seed: int = 7) -> Model:
    r, h, f = np.random.default_rng(seed), UNITS, np.float32
    draw = lambda *s, by: (r.standard_normal(s) * by).astype(f)
    return Model(draw(2, 256, 2 * h, by=0.3), draw(2, 256, h, by=0.5), draw(2, h, 2 * h, by=0.3), draw(2, h, h, by=0.3), np.zeros((2, 1, h), f), draw(2, h, len(labels), by=0.3), np.zeros(len(labels), f), labels)


def _squash(x: np.ndarray) -> None:
    d = np.abs(x)
    d += 1
    x /= d


def _sides(x: np.ndarray, n: np.ndarray, t: int, live: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the two directions read at step t."""
    return x[:live, t], x[np.arange(live), n[:live] - 1 - t]


def label_scores(m: Model, x: np.ndarray, n: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Scores of each direction by step (steps, 2, windows, labels). x: windows by bytes, n: their lengths,
    falling. ``keep`` gets what training needs. Squashing is x / (1 + |x|), for gates moved to 0..1: a few
    cheap passes, and its slope follows from its value."""
    b, steps = len(x), int(n[0]) if len(n) else 0
    h = np.zeros((2, b, UNITS), np.float32)
    out = np.zeros((steps, 2, b, len(m.labels)), np.float32)
    full = bool(len(n)) and n[-1] == steps
    for t in range(steps):
        live = b if full else int(np.searchsorted(-n, -t, "left"))
        ahead, back = (x[:, t], x[:, steps - 1 - t]) if full else _sides(x, n, t, live)
        old = h[:, :live]
        g = np.matmul(old, m.ug)
        g[0] += m.wg[0].take(ahead, 0)
        g[1] += m.wg[1].take(back, 0)
        _squash(g)
        g += 1
        g *= 0.5
        z, r = g[..., :UNITS], g[..., UNITS:]
        u = np.matmul(old, m.un)
        u += m.bn
        a = r * u
        a[0] += m.wn[0].take(ahead, 0)
        a[1] += m.wn[1].take(back, 0)
        _squash(a)
        new = old - a
        new *= z
        new += a
        if keep is not None:
            keep.append((live, ahead, back, old.copy(), z, r, u, a, new))
        h[:, :live] = new
        np.matmul(new, m.v, out=out[t, :, :live]) if live == b else out[t].__setitem__((slice(None), slice(live)), np.matmul(new, m.v))
    return out


def _aligned(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of both directions' scores at each position (steps, windows, labels)."""
    steps = len(s)
    if len(n) and n[-1] == steps:
        return s[:, 0] + s[::-1, 1]
    at = np.clip(n[None, :] - 1 - np.arange(steps)[:, None], 0, steps - 1)
    return s[:, 0] + np.take_along_axis(s[:, 1], at[..., None], 0)


def position_probabilities(m: Model, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Label probabilities of every position (steps, windows, labels); 0 after a window's end."""
    s = _aligned(label_scores(m, x, n), n)
    s += m.c
    np.clip(s, -60, 60, out=s)
    np.exp(s, out=s)
    s /= s @ np.ones((s.shape[-1], 1), np.float32)
    if len(n) and n[-1] != len(s):
        s *= (np.arange(len(s))[:, None] < n[None, :])[..., None]
    return s


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte read, bytes read, bytes before the window, bytes of the window) of all windows of all rows."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    first, end = np.maximum(at - CONTEXT, 0), np.minimum(at + WINDOW + CONTEXT, size[row])
    return row, offsets[:-1][row] + first, end - first, at - first, np.minimum(WINDOW, size[row] - at)


def pooled(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of the position probabilities over every byte of each row (rows, labels); 0 for empty rows."""
    row, start, n, before, size = windows(data, offsets)
    order = np.argsort(-n, kind="stable")
    total = np.zeros((len(offsets) - 1, len(m.labels)))
    longest = WINDOW + 2 * CONTEXT
    padded = np.concatenate([data, np.zeros(longest, np.uint8)])
    full = int(np.searchsorted(-n[order], -(longest - 1), "left"))
    cuts = sorted({*range(0, full, LANES), full, *range(full, len(order), LANES), len(order)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = order[a:b]
        step = np.arange(n[at[0]])
        p = position_probabilities(m, padded[start[at][:, None] + step], n[at])
        counted = (step[:, None] >= before[at]) & (step[:, None] < (before + size)[at])
        np.add.at(total, row[at], np.einsum("twl,tw->wl", p, counted.astype(np.float32)))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of whole windows with labels y, and its gradients, by
    backpropagation through time."""
    b, steps = x.shape
    n = np.full(b, steps)
    keep: list = []
    s = _aligned(label_scores(m, x, n, keep), n) + m.c
    s -= s.max(-1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(-1, keepdims=True)
    loss = float(-np.log(np.maximum(p[:, np.arange(b), y], 1e-9)).mean())
    d = p
    d[:, np.arange(b), y] -= 1
    d /= np.float32(b * steps)
    g = [np.zeros_like(q) for q in m.parameters()]
    wg, wn, ug, un, bn, v, c = g
    c += d.sum((0, 1))
    dh = np.zeros((2, b, UNITS), np.float32)
    vt, ugt, unt = (q.transpose(0, 2, 1) for q in (m.v, m.ug, m.un))
    for t in range(steps - 1, -1, -1):
        _, ahead, back, old, z, r, u, a, new = keep[t]
        dy = np.stack([d[t], d[steps - 1 - t]])
        v += np.matmul(new.transpose(0, 2, 1), dy)
        dh = dh + np.matmul(dy, vt)
        da = dh * (1 - z) * (1 - np.abs(a)) ** 2
        dg = 0.5 * np.concatenate([dh * (old - a) * (1 - np.abs(2 * z - 1)) ** 2, da * u * (1 - np.abs(2 * r - 1)) ** 2], -1)
        du = da * r
        dh = dh * z + np.matmul(dg, ugt) + np.matmul(du, unt)
        ot = old.transpose(0, 2, 1)
        ug += np.matmul(ot, dg)
        un += np.matmul(ot, du)
        bn += du.sum(1, keepdims=True)
        for side, at in ((0, ahead), (1, back)):
            np.add.at(wg[side], at, dg[side])
            np.add.at(wn[side], at, da[side])
    return loss, g


def train(texts: list[bytes], targets: list[int], labels: list[str], steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam over random windows; every label is drawn equally often."""
    r, m = np.random.default_rng(seed), fresh(labels, seed)
    by = [[k for k, y in enumerate(targets) if y == label and len(texts[k])] for label in range(len(labels))]
    usable = [k for k, of in enumerate(by) if of]
    if not usable:
        return m
    first, second = ([np.zeros_like(q) for q in m.parameters()] for _ in range(2))
    length = 96
    for step in range(1, steps + 1):
        y = r.choice(usable, batch)
        x = np.zeros((batch, length), np.uint8)
        for k, label in enumerate(y):
            text = texts[by[label][r.integers(len(by[label]))]]
            at = int(r.integers(max(1, len(text) - length + 1)))
            piece = text[at : at + length]
            x[k] = np.frombuffer((piece * (length // len(piece) + 1))[:length], np.uint8)
        _, g = gradients(m, x, y)
        norm = np.sqrt(sum(float((q * q).sum()) for q in g))
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for q, dq, a, b in zip(m.parameters(), g, first, second, strict=True):
            dq *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            a += 0.1 * (dq - a)
            b += 0.01 * (dq * dq - b)
            q -= np.float32(now) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m
