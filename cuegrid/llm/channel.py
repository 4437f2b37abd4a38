"""A noisy channel for disguised words: a character language model, lattices of what a disguised stretch of text may
mean, and the Viterbi search for the likeliest reading.

Symbols of the model: 0 a boundary, 1 to 26 the letters (upper case counts as lower), 27 anything else. A stretch is
disguised if letters and digits or signs that stand for letters meet, if a letter stands three times in a row, or if
three or more letters or signs stand alone, one after the other. In its lattice

* a letter means itself; a digit or sign means the letters that it looks like; some signs may also end the word;
* what separates lone letters may be nothing or a boundary;
* the second of equal letters or signs in a row may be dropped, a third and later ones always are.

The best reading is found over states of the last two symbols, in time linear in the stretch.
"""

from __future__ import annotations

import re

import numpy as np

SYMBOLS = 28
# The letters that a digit or sign is written for; a space stands for the end of a word.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i ", "|": "il "}
SEPARATORS = " \t\n._*-"
#: Log probability that the second of two equal letters is meant, and that it is not.
DOUBLE_MEANT = DOUBLE_DROPPED = float(np.log(0.5))
#: What a reading pays for each separator that it drops.
JOINED = float(np.log(0.9))

_CORE = re.compile(r"[0-9@$!|][A-Za-z]|[A-Za-z][0-9]|([A-Za-z])(?i:\1\1)")
_SPACED = re.compile(r"(?<![^\W_])(?:[A-Za-z0-9@$!|][ \t\n._*\-]{1,2}){2,}[A-Za-z0-9@$!|](?![^\W_])")
_TOKEN = re.compile(r"[A-Za-z0-9@$!|]*")
_TOKEN_BACK = re.compile(r"[A-Za-z0-9@$!|]*\Z")

_CLASS = np.full(256, 27, np.uint8)
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = _k + 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_LETTER = (_CLASS > 0) & (_CLASS < 27)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKS_LIKE]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each three symbols follow each other in rows of bytes, each row between two boundaries."""
    n = len(data)
    symbols = np.zeros(n + 2 * (len(offsets) - 1), np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    symbols[np.arange(n) + 2 * row + 2] = _CLASS[data]
    symbols = np.append(symbols, 0)
    codes = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    return np.bincount(codes, minlength=SYMBOLS**3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """(28, 28, 28): log probability of a symbol after two others; shorter contexts count as ten observations."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1 + 1).sum()
    p2 = (c2 + 10 * p1) / (c2.sum(1, keepdims=True) + 10)
    p3 = (c3 + 10 * p2[None]) / (c3.sum(2, keepdims=True) + 10)
    return np.log(p3)


def disguised_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows of bytes may hold a disguised stretch (all that do, and a few more)."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(data) < 3:
        return out
    letter, sign, digit, low = _LETTER[data], _SIGN[data], _DIGIT[data], _CLASS[data]
    found = np.zeros(len(data), bool)
    found[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & digit[1:])
    found[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    n = len(data)
    word = letter | digit
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    whole = offsets[:-1] < offsets[1:]
    before[offsets[:-1][whole]] = after[offsets[1:][whole] - 1] = False  # neighbours in other rows don't count
    alone = np.pad((letter | sign) & ~before & ~after, (0, 7))
    two = alone[: n + 3] & (alone[2 : n + 5] | alone[3 : n + 6])
    found |= two[:n] & (two[2 : n + 2] | two[3 : n + 3])
    out[np.searchsorted(offsets, np.flatnonzero(found), "right") - 1] = True
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The disguised stretches of a text, in order, none over another."""
    spans = [m.span() for m in _SPACED.finditer(text)]
    at = 0
    while m := _CORE.search(text, at):
        # Tokens have no bound, so what is before is looked at as far as the stretch before reaches.
        begin = at + _TOKEN_BACK.search(text[at : m.start()]).start() if m.start() - at < 64 else _back(text, m.start(), at)
        end = _TOKEN.match(text, m.end()).end()
        spans.append((begin, end))
        at = end
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _back(text: str, at: int, least: int) -> int:
    while at > least and _TOKEN.match(text[at - 1]).end():
        at -= 1
    return at


def _choices(c: str, joined: bool) -> list[tuple[int | None, float]]:
    """(symbol or None for nothing, log probability) of one character."""
    low = c.lower()
    if "a" <= low <= "z" and len(low) == 1:
        return [(ord(low) - 96, 0.0)]
    if low in LOOKS_LIKE:
        return [(0 if x == " " else ord(x) - 96, 0.0) for x in LOOKS_LIKE[low]]
    if c in SEPARATORS:
        return [(None, JOINED), (0, 0.0)] if joined else [(0, 0.0)]
    return [(27, 0.0)]


def decode(stretch: str, model: np.ndarray) -> str:
    """The likeliest reading of a stretch: lower-case letters, words by a space."""
    lone = max((len(x) for x in re.split(r"[ \t\n._*\-]+", stretch)), default=0) <= 1
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    trail: list[dict[tuple[int, int], tuple[tuple[int, int], int | None]]] = []
    before, run = "", 0
    for c in stretch:
        low = c.lower()
        run = run + 1 if low == before and (low.isalpha() or low in LOOKS_LIKE) else 0
        before = low
        now: dict[tuple[int, int], float] = {}
        how: dict[tuple[int, int], tuple[tuple[int, int], int | None]] = {}
        if run >= 2:
            options = [(None, 0.0)]
        elif run == 1:
            options = [(s, p + DOUBLE_MEANT) for s, p in _choices(c, lone)] + [(None, DOUBLE_DROPPED)]
        else:
            options = _choices(c, lone)
        for state, score in states.items():
            for symbol, p in options:
                if symbol is None or symbol == 0 and state[1] == 0:
                    to, s = state, score + p
                else:
                    to, s = (state[1], symbol), score + p + model[state[0], state[1], symbol]
                if to not in now or s > now[to]:
                    now[to], how[to] = s, (state, symbol if to is not state else None)
        states = now
        trail.append(how)
    state = max(states, key=lambda k: (states[k] + model[k[0], k[1], 0], k))
    out = []
    for how in reversed(trail):
        state, symbol = how[state]
        if symbol is not None:
            out.append(" " if symbol == 0 else chr(96 + symbol) if symbol < 27 else "#")
    return "".join(reversed(out)).strip()


def restored(text: str, model: np.ndarray) -> str:
    """The text with its disguised stretches as they are read."""
    out, at = [], 0
    for a, b in stretches(text):
        out += [text[at:a], decode(text[a:b], model)]
        at = b
    return "".join([*out, text[at:]])
