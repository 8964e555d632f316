"""Enhanced suffix arrays in numpy: prefix doubling, common-prefix lengths, the interval tree, maximal repeats.

Symbols are non-negative integers. Ends of texts need symbols that occur once, so that no match crosses them. No symbols give empty
arrays. A level of ranks takes four bytes a symbol, and there are as many levels as the longest repeat has binary digits.
"""

from __future__ import annotations

import numpy as np


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _sorted_by(a: np.ndarray, b: np.ndarray, i: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i in the order of (a, b), and where a, and where either, differs from the one before; all under 2**bits."""
    if 3 * bits <= 64:  # one vectorised sort of packed words beats an argsort by far
        w = a.astype(np.uint64)
        w <<= np.uint64(bits)
        w |= b.astype(np.uint64)
        w <<= np.uint64(bits)
        w |= i.astype(np.uint64)
        w.sort()
        i = (w & np.uint64((1 << bits) - 1)).astype(np.int64)
        w >>= np.uint64(bits)
        both = _changes(w)
        w >>= np.uint64(bits)
        return i, _changes(w), both
    o = np.lexsort((b, a))
    first = _changes(a[o])
    return i[o], first, first | _changes(b[o])


def build(symbols: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and, for k = 0, 1, ..., numbers of each suffix's first 2**k symbols, equal where these are (one more entry at the end).

    The first sort takes as many symbols as fit into a word. With depth, sorting stops once 2**k reaches it; suffixes that agree so
    far stand in any order.
    """
    n = len(symbols)
    bits = max(1, n.bit_length())
    code = np.zeros(n + 1, np.uint64)
    code[:n] = symbols
    code[:n] += np.uint64(1)
    width, h, levels = int(code.max()).bit_length(), 1, []
    while 2 * h * width + bits <= 64 and h < n and (depth is None or h < depth):
        levels.append(code)
        longer = code << np.uint64(h * width)
        longer[:-h] |= code[h:]
        longer[n] = 0
        code, h = longer, 2 * h
    if width * h + bits <= 64:
        w = (code[:n] << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        w.sort()
        sa = (w & np.uint64((1 << bits) - 1)).astype(np.int64)
        first = _changes(w >> np.uint64(bits))
    else:
        sa = np.argsort(code[:n], kind="stable")
        first = _changes(code[sa])
    del code
    idx = np.arange(n, dtype=np.int64)
    rank = np.full(n + 1, -1, np.int32 if n < 1 << 31 else np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, idx, 0))
    levels.append(rank)
    todo = sa[~(first & np.append(first[1:], True))] if n else sa
    while len(todo) and (depth is None or h < depth):
        r = rank[todo]
        i, new_r, new = _sorted_by(r, rank[np.minimum(todo + h, n)] + 1, todo, bits)
        at = idx[: len(i)]
        place = rank[i] + at - np.maximum.accumulate(np.where(new_r, at, 0))
        rank = rank.copy()
        rank[i] = place[np.maximum.accumulate(np.where(new, at, 0))]
        sa[place] = i
        levels.append(rank)
        todo = i[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, levels


def lcp_array(sa: np.ndarray, levels: list[np.ndarray], least: int = 1) -> np.ndarray:
    """Common-prefix length of each suffix with the one before it in the array (0 for the first, and where it is under `least`)."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    k = least.bit_length() - 1
    if n < 2 or k >= len(levels):
        return out
    near = np.flatnonzero(levels[k][sa[1:]] == levels[k][sa[:-1]])
    a, b = sa[near] + (1 << k), sa[near + 1] + (1 << k)
    got = np.full(len(near), 1 << k, np.int64)
    for j in [*range(len(levels) - 1, k, -1), *range(k, -1, -1)]:
        lv = levels[j]
        step = (lv[np.minimum(a, n)] == lv[np.minimum(b, n)]).astype(np.int64) << j
        a += step
        b += step
        got += step
    out[near + 1] = np.where(got >= least, got, 0)
    return out


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The common-prefix interval tree of lengths >= least, by one stack scan.

    First and last place in the array, length and parent (-1: none) of each interval, and each place's deepest interval (-1: none).
    """
    deepest = np.full(len(lcp), -1, np.int64)
    inside = np.flatnonzero(lcp >= least)
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (deepest,)
    values = lcp[inside]
    begin = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # of each run of neighbours
    end = np.append(begin[1:], len(inside))
    # a run of one value is one interval, and needs no stack
    flat = np.maximum.reduceat(values, begin) == np.minimum.reduceat(values, begin)
    n_flat = int(flat.sum())
    run = np.repeat(np.arange(len(begin)), end - begin)
    found = (np.cumsum(flat) - 1)[run]
    lo: list[int] = []
    hi: list[int] = []
    length: list[int] = []
    parent: list[int] = []
    rest: list[int] = []
    other = np.flatnonzero(~flat)
    depth = values[~flat[run]].tolist()
    at = 0
    for first, size in zip(inside[begin[other]].tolist(), (end - begin)[other].tolist(), strict=True):
        stack: list[int] = []  # open intervals, by number
        for i, v in enumerate(depth[at : at + size], first):
            left, below = i - 1, -1
            while stack and length[stack[-1]] > v:
                top = stack.pop()
                hi[top] = i - 1
                left = lo[top]
                if below >= 0:
                    parent[below] = top
                below = top
            if not stack or length[stack[-1]] < v:
                stack.append(len(lo))
                lo.append(left), hi.append(-1), length.append(v), parent.append(-1)
            if below >= 0:
                parent[below] = stack[-1]
            rest.append(stack[-1])
        at += size
        below = -1
        while stack:
            top = stack.pop()
            hi[top] = first + size - 1
            if below >= 0:
                parent[below] = top
            below = top
    found[~flat[run]] = np.array(rest, np.int64) + n_flat
    up = np.array(parent, np.int64)
    lo, hi, length = (np.concatenate([x, np.array(y, np.int64)]) for x, y in ((inside[begin[flat]] - 1, lo), (inside[end[flat] - 1], hi), (values[begin[flat]], length)))
    parent = np.concatenate([np.full(n_flat, -1, np.int64), np.where(up >= 0, up + n_flat, -1)])
    # a place lies between its own and the next common-prefix length; the longer one is its deepest interval
    deepest[inside] = found
    before = inside - 1
    longer = (deepest[before] < 0) | (length[np.maximum(deepest[before], 0)] < length[found])
    deepest[before[longer]] = found[longer]
    return lo, hi, length, parent, deepest


def left_diverse(symbols: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of intervals: do their occurrences have different symbols to their left? If not, one longer to the left holds them all."""
    left = np.where(sa > 0, symbols[sa - 1], -1)
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    return change[hi] > change[lo]


def maximal_repeats(symbols: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and length of the left-diverse intervals. All occurrences of group g are sa[lo[g] : hi[g] + 1]."""
    lo, hi, length, _, _ = intervals(lcp, least)
    if not len(lo):
        return lo, hi, length
    keep = left_diverse(symbols, sa, lo, hi)
    return lo[keep], hi[keep], length[keep]


def longest_by_position(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Length of the longest repeat that starts at each position: its deepest interval."""
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.concatenate([lcp[1:], [0]])) if len(sa) else lcp
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of n positions that lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:-1]) > 0
