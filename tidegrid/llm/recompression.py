"""Recompression: rounds that name runs and pairs of symbols, the same way wherever they occur.

A round replaces runs of one symbol, then pairs whose left symbol falls in one half of
the alphabet and whose right one in the other. A name is a 64-bit hash of what it stands
for, so it is global: equal strings get equal symbols in any task, except at their ends,
where what stands outside can join in. ``cores`` follows for each window which symbols
depend on the window's own words alone. The longest-lived of these, its core, is the same
in all windows of equal content.
"""

from __future__ import annotations

import numpy as np

from . import shared

U64 = np.uint64
_PAIR, _RUN = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


class Symbols:
    """A level: names, whether a symbol opens a document, and the word at which it starts."""

    def __init__(self, names: np.ndarray, opens: np.ndarray, starts: np.ndarray) -> None:
        self.names, self.opens, self.starts = names, opens, starts

    def taken(self, heads: np.ndarray, names: np.ndarray) -> Symbols:
        return Symbols(names, self.opens[heads], self.starts[heads])


def runs(s: Symbols) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Runs of one symbol by their name and length; what is left of a window after it.

    Of a window's symbols ``low`` to ``high``, the first and the last run may go on outside.
    """
    m = len(s.names)
    new = np.ones(m, bool)
    new[1:] = (s.names[1:] != s.names[:-1]) | s.opens[1:]
    heads, run = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)
    size = np.diff(np.append(heads, m))
    names = s.names[heads]
    long = size > 1
    names[long] = shared.mix64(names[long] * _RUN + size[long].astype(U64))
    return s.taken(heads, names), np.append(run + np.int32(1), np.int32(len(heads))), np.append(np.int32(0), run)


def pairs(s: Symbols, bit: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Pairs of a symbol without ``bit`` in its name and one with it; what is left of a window after it.

    A window's first symbol may be a right half and its last one a left half: they go.
    """
    m = len(s.names)
    right = (s.names >> U64(bit) & U64(1)).astype(bool)
    joins = np.zeros(m + 1, bool)
    joins[1:m] = ~right[:-1] & right[1:] & ~s.opens[1:]
    heads = np.flatnonzero(~joins[:m])
    place = np.cumsum(~joins, dtype=np.int32) - np.int32(1)  # of the symbol that starts here
    names = s.names[heads]
    left = joins[heads + 1]
    names[left] = shared.mix64(names[left] * _PAIR + s.names[heads[left] + 1])
    inner = place[np.arange(m) + right]
    return s.taken(heads, names), np.append(inner, place[m]), np.append(np.int32(0), inner)


def cores(names: np.ndarray, bounds: np.ndarray, window: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, core name, core place) of each window of ``window`` words inside the documents ``names[bounds[i]:bounds[i + 1]]``.

    Runs of words are named in the first round only: a later run costs a window a symbol
    at either end, and periods are rare. A window of one or two runs has its first word as
    core.
    """
    n = len(names)
    opens = np.zeros(n, bool)
    opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(at):
        return at, names[:0], at
    low, high = at.astype(np.int32), (at + window).astype(np.int32)
    core, place = names[at], at.copy()
    s = Symbols(names, opens, np.arange(n))
    for round_ in range(rounds):
        steps = [runs] * (round_ == 0) + [lambda s, bit=3 + round_: pairs(s, bit)]
        for step in steps:
            s, lows, highs = step(s)
            low, high = lows[low], highs[high]
        alive = np.flatnonzero(low < high)
        if not len(alive):
            break
        core[alive], place[alive] = s.names[low[alive]], s.starts[low[alive]]
    return at, core, place
