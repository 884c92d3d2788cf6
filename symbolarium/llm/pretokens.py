"""Boundaries of pre-tokens without regular expressions.

The texts of a batch are one array of code-point classes. A small automaton reads them: each class
(with one to two characters of lookahead folded in) is a function from states to states, and
composing such functions is associative. So the array is cut into equal lanes, the functions of
all lanes are composed side by side, the lanes' products are scanned by doubling, and only then
are states put in. The functions that can arise form a small monoid and are kept as numbers.

The rule is that of byte-level BPE: the contractions ``'s 't 're 've 'm 'll 'd``; runs of letters,
of numbers, or of other visible characters, each with one space before it if there is one; and
runs of white space, without the last character if something visible follows.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

# Classes of code points.
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
# Symbols the automaton reads; 8 more for the first character of a text.
_L, _N, _O, _QUOTE1, _QUOTE2, _W, _GLUE, _LAST = range(8)
_FIRST = 8
# States: at a boundary; in letters, numbers, others, white space; behind a space that joins what follows; in a contraction with 1 or 2 letters to go.
_B, _IN_L, _IN_N, _IN_O, _IN_W, _IN_GLUE, _LEFT1, _LEFT2 = range(8)

#: The code points with the Unicode property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point, by its Unicode general category."""
    of = np.full(0x110000, _OTHER, np.uint8)
    first = "".join(map(unicodedata.category, map(chr, range(0x110000))))[::2]
    initial = np.frombuffer(first.encode("ascii"), np.uint8)
    of[initial == ord("L")] = _LETTER
    of[initial == ord("N")] = _NUMBER
    of[_WHITE] = _SPACE
    return of


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a pre-token begins with it."""
    if symbol >= _FIRST:
        return _step(_B, symbol - _FIRST)[0], True
    if state == _LEFT2:
        return _LEFT1, False
    if state == _LEFT1:
        return _B, False
    if symbol in (_L, _N):
        own = _IN_L if symbol == _L else _IN_N
        return own, state not in (own, _IN_GLUE)
    if symbol in (_O, _QUOTE1, _QUOTE2):
        if state in (_IN_O, _IN_GLUE):
            return _IN_O, False
        return {_O: _IN_O, _QUOTE1: _LEFT1, _QUOTE2: _LEFT2}[symbol], True
    if symbol == _W:
        return _IN_W, state != _IN_W
    return (_IN_GLUE if symbol == _GLUE else _B), True


@functools.cache
def _monoid() -> tuple:
    """``times[f, g]``: number of "f, then g"; ``apply[f, state]``; ``begins[state, symbol]``. Then the number of each symbol's function, and of the one that does nothing."""
    known: dict[tuple[int, ...], int] = {}
    symbols = [tuple(_step(s, x)[0] for s in range(8)) for x in range(16)]
    number = [known.setdefault(f, len(known)) for f in symbols]
    known.setdefault(tuple(range(8)), len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    elements = list(known)
    times = np.array([[known[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint16)
    begins = np.array([[_step(s, x)[1] for x in range(16)] for s in range(8)])
    return times, np.array(elements, np.uint8), begins, np.array(number, np.uint16), known[tuple(range(8))]


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a scan over composed transition functions."""
    times, apply, _, number, neutral = _monoid()
    n = len(symbols)
    lanes = max(1, min(4096, n // 64))
    length = -(-n // lanes)
    grid = np.full(lanes * length, neutral, np.uint16)
    grid[:n] = number[symbols]
    steps = np.ascontiguousarray(grid.reshape(lanes, length).T)
    product = np.empty_like(steps)
    flat, width = times.ravel(), times.shape[1]
    now = np.full(lanes, neutral, np.intp)
    for t in range(length):  # all lanes at once: product[t] holds each lane's first t symbols
        product[t] = now
        now = flat[now * width + steps[t]].astype(np.intp)
    reach = 1
    while reach < lanes:  # inclusive scan of the lanes' products
        now[reach:] = times[now[:-reach], now[reach:]]
        reach *= 2
    entry = np.full(lanes, _B, np.uint8)
    entry[1:] = apply[now[:-1], _B]
    states = apply.ravel()[product * np.uint16(8) + entry]
    return np.ascontiguousarray(states.T).ravel()[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point of joined texts.

    ``points``: code points of all texts, one behind the other; ``starts``: position of the first
    code point of each text that isn't empty.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    space = kind == _SPACE
    visible_next = np.zeros(n, bool)  # a character of the same text follows, and it is visible
    visible_next[:-1] = ~space[1:] & ~first[1:n]
    symbols = kind.copy()
    symbols[space] = _W
    last = space & visible_next
    symbols[last] = _LAST
    symbols[last & (points == 32)] = _GLUE
    quotes = np.flatnonzero(points[:-1] == ord("'")) if n > 1 else np.zeros(0, np.intp)
    quotes = quotes[~first[quotes + 1]]
    if len(quotes):
        a = points[quotes + 1]
        symbols[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = _QUOTE1
        long = quotes[quotes + 2 < n]
        long = long[~first[long + 2]]
        a, b = points[long + 1], points[long + 2]
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbols[long[two]] = _QUOTE2
    symbols[starts] += _FIRST
    return _monoid()[2][_states_before(symbols), symbols]
