"""Matrices over (cost, audit) pairs for the repair of conversations, and their associative products.

A conversation's roles must read ``(s?(ua)+)?``. Four states tell how far a prefix has come: 0 nothing yet, 1 after
the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end. The matrix of a turn gives for each
pair of states the cheapest edits that lead from one to the other over that turn and any insertions after it, as
(cost, audit): the sum of two pairs is the smaller one (least cost, then least audit in ASCII), their product adds
costs and joins audits. Products are associative, so a conversation of any length is reduced as a tree.

Why the least audit may be chosen early: from a state, an audit determines its path, so of two audits of equal cost
between the same states none is a beginning of the other (what is left over would be insertions, which cost), and
the order of two such audits stays the same whatever is joined before or after both.

Many matrices are multiplied side by side in numpy: costs are int64 (n, 4, 4), audits byte strings (n, 4, 4).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATES = 4
#: No edits lead there.
NEVER = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: (from, role initial, to)
STEPS = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]
INITIALS = "sua"


@dataclass
class Matrices:
    cost: np.ndarray
    audit: np.ndarray

    def __len__(self) -> int:
        return len(self.cost)

    def __getitem__(self, at) -> Matrices:
        return Matrices(self.cost[at], self.audit[at])


def product(a: Matrices, b: Matrices) -> Matrices:
    """The product of each matrix of ``a`` with the one of ``b`` at the same place."""
    best = None
    for k in range(STATES):
        cost = np.minimum(a.cost[:, :, k, None] + b.cost[:, None, k, :], NEVER)
        audit = np.strings.add(a.audit[:, :, k, None], b.audit[:, None, k, :])
        if best is None:
            best = Matrices(cost, audit)
        else:
            better = (cost < best.cost) | ((cost == best.cost) & (cost < NEVER) & (audit < best.audit))
            best = Matrices(np.where(better, cost, best.cost), np.where(better, audit, best.audit))
    return Matrices(best.cost, np.where(best.cost < NEVER, best.audit, b""))


def of_edges(edges: list[tuple[int, int, int, str]]) -> Matrices:
    """One matrix from (from, to, cost, audit)."""
    cost, audit = np.full((1, STATES, STATES), NEVER), np.full((1, STATES, STATES), b"", "S1")
    for i, j, c, t in edges:
        cost[0, i, j], audit[0, i, j] = c, t.encode()
    return Matrices(cost, audit)


def insertions() -> Matrices:
    """The closure of insertions: any number of them, from each state to each. Longer ones than three steps come
    back to a state that a shorter one reaches."""
    one = of_edges([(i, i, 0, "") for i in range(STATES)] + [(i, j, INSERT, "I") for i, role, j in STEPS if role != "s"])
    two = product(one, one)
    return product(two, two)


def turn(initial: str, truncated: bool, gone: bool) -> Matrices:
    """The matrix of one turn; ``gone``: it must be deleted."""
    edges = [(i, i, DELETE, "D") for i in range(STATES)]
    if not gone:
        more = TRUNCATED if truncated else 0
        for i, role, j in STEPS:
            # Between two states there is one role, so a turn is kept or gets another one, never both.
            if role == initial:
                edges.append((i, j, more, "K"))
            elif role != "s":
                edges.append((i, j, REROLE + more, "R"))
    return product(of_edges(edges), insertions())


def kinds() -> Matrices:
    """The matrices of all kinds of turns, in the order of ``kind``."""
    made = [turn(INITIALS[k] if k < 3 else "", truncated, gone) for k in range(4) for truncated, gone in ((False, False), (True, False), (False, True))]
    return Matrices(np.concatenate([m.cost for m in made]), np.concatenate([m.audit for m in made]))


def kind(initial: np.ndarray, truncated: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which of ``kinds``: initial 0 to 2 as in INITIALS, 3 for any other."""
    return initial * 3 + np.where(gone, 2, np.where(truncated, 1, 0))


def reduced(m: Matrices, group: np.ndarray) -> Matrices:
    """The product of the matrices of each group, in order: groups are 0, 1, 2 ... and lie together. Neighbours are
    multiplied in pairs, level by level."""
    while len(m) > (groups := int(group[-1]) + 1 if len(group) else 0):
        first = np.searchsorted(group, np.arange(groups))
        place = np.arange(len(m)) - first[group]
        left = np.flatnonzero(place % 2 == 0)
        paired = left[(left + 1 < len(m)) & (group[np.minimum(left + 1, len(m) - 1)] == group[left])]
        done = product(m[paired], m[paired + 1])
        alone = np.setdiff1d(left, paired, assume_unique=True)
        width = max(done.audit.dtype.itemsize, m.audit.dtype.itemsize)
        cost = np.empty((len(left), STATES, STATES), np.int64)
        audit = np.empty((len(left), STATES, STATES), f"S{max(width, 1)}")
        into = np.searchsorted(left, paired)
        cost[into], audit[into] = done.cost, done.audit
        into = np.searchsorted(left, alone)
        cost[into], audit[into] = m.cost[alone], m.audit[alone]
        m, group = Matrices(cost, _trimmed(audit)), group[left]
    return m


def _trimmed(audit: np.ndarray) -> np.ndarray:
    most = int(np.strings.str_len(audit).max(initial=1))
    return audit.astype(f"S{max(most, 1)}") if most < audit.dtype.itemsize else audit


def finish(m: Matrices) -> tuple[np.ndarray, list[str]]:
    """(cost, audit) of whole conversations from their products: insertions may come before the first turn; the end
    is state 0 or 3."""
    first = insertions()
    n = len(m)
    whole = product(Matrices(np.repeat(first.cost, n, 0), np.repeat(first.audit, n, 0)), m)
    none, some = (whole.cost[:, 0, s] for s in (0, 3))
    a, b = (whole.audit[:, 0, s] for s in (0, 3))
    take = (some < none) | ((some == none) & (b < a))
    return np.where(take, some, none), [x.decode() for x in np.where(take, b, a)]
