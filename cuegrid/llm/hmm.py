"""A hidden Markov model over integer symbols, in numpy: expected counts for Baum-Welch, and the exact
likelihood of whole sequences by the scaled forward recursion. Many sequences run side by side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows that run side by side in training, and steps between the kept forward states: the steps of one block are
#: computed again on the way back, so memory does not grow with a row's length but for the states kept.
WIDTH, BLOCK = 4096, 256


@dataclass
class Hmm:
    """first (K), move (K, K) from row to column, emit (symbols, K): probabilities of a symbol in each state."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclass
class Counts:
    """Expected counts, in the shapes of Hmm."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def none(cls, states: int, symbols: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def estimate(c: Counts, unigram: np.ndarray) -> Hmm:
    """The M step, with a little of each symbol's overall share in every state, so that nothing is impossible."""
    states = len(c.first)
    emit = c.emit + 0.5 + 20.0 * unigram[:, None]
    move = c.move + 0.5 + 2.0 * np.eye(states)
    first = c.first + 0.5
    return Hmm(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def start(states: int, unigram: np.ndarray, seed: int = 5) -> Hmm:
    r = np.random.default_rng(seed)
    emit = (unigram[:, None] + 1e-9) * r.uniform(0.3, 1.7, (len(unigram), states))
    move = np.full((states, states), 0.08 / max(states - 1, 1))
    np.fill_diagonal(move, 0.92)
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def log10_likelihood(m: Hmm, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log10 probability of each row's whole sequence; 0 for empty rows."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], bounds[:-1][order]
    total = np.zeros(len(n))
    live = int(np.searchsorted(-n, 0, "left"))
    if not live:
        return total
    a = m.first * m.emit[symbols[at[:live]]]
    ones = np.ones(len(m.first))
    steps = np.searchsorted(-n, -np.arange(1, n[0] + 1), "left")  # rows longer than t
    for t in range(1, int(n[0]) + 1):
        s = a @ ones
        total[:live] += np.log10(s)
        live = int(steps[t - 1])
        if not live:
            break
        a = (a[:live] / s[:live, None]) @ m.move
        a *= m.emit[symbols[at[:live] + t]]
    out = np.empty(len(n))
    out[order] = total
    return out


def expected(m: Hmm, symbols: np.ndarray, bounds: np.ndarray, into: Counts, width: int = WIDTH, block: int = BLOCK) -> None:
    """Adds the expected counts of whole rows (E step, scaled forward and backward recursion)."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]
    f = np.float32
    first, move, emit = m.first.astype(f), m.move.astype(f), m.emit.astype(f)
    ones = np.ones((len(first), 1), f)
    for low in range(0, len(order), width):
        rows = order[low : low + width]
        at, length = bounds[rows], size[rows]
        steps = int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), "left").tolist()  # rows longer than t

        def forward(a, t):
            e = emit[symbols[at[: live[t]] + t]]  # noqa: B023
            a = first * e if a is None else (a[: live[t]] @ move) * e  # noqa: B023
            a /= a @ ones
            return a, e

        kept, a = [], None
        for t in range(steps):
            if t % block == 0:
                kept.append(a)
            a, _ = forward(a, t)
        back = np.ones((live[-1], len(first)), f)
        moved = np.zeros_like(into.move)
        for t0 in range(len(kept) * block - block, -1, -block):
            a, alpha, emitted, gammas, seen = kept.pop(), [], [], [], []
            alpha.append(a)
            for t in range(t0, min(steps, t0 + block)):
                a, e = forward(a, t)
                alpha.append(a)
                emitted.append(e)
            for t in range(t0 + len(emitted) - 1, t0 - 1, -1):
                if len(back) < live[t]:
                    back = np.concatenate([back, np.ones((live[t] - len(back), len(first)), f)])
                g = alpha[t - t0 + 1] * back
                g /= g @ ones
                gammas.append(g)
                seen.append(symbols[at[: live[t]] + t])
                if t:
                    ahead, past = emitted[t - t0] * back, alpha[t - t0][: live[t]]
                    ahead /= ((past @ move) * ahead) @ ones
                    moved += past.T @ ahead
                    back = ahead @ move.T
                else:
                    into.first += g.sum(0)
            flat, g = np.concatenate(seen), np.concatenate(gammas)
            for s in range(len(first)):
                into.emit[:, s] += np.bincount(flat, weights=g[:, s], minlength=len(into.emit))
        into.move += moved * m.move
