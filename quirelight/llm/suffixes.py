"""Suffix arrays by the difference-cover method, and anchors, in numpy."""

from __future__ import annotations

import numpy as np


def _rank(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of rows in sorted order: equal rows get equal names, from 1 on; and how many there are."""
    if (max(int(c.max(initial=0)) for c in columns) + 1) ** len(columns) < 1 << 63:
        key = columns[0]
        for c in columns[1:]:
            key = key * (int(c.max(initial=0)) + 1) + c
        columns = (key,)
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (integers from 1 on) in sorted order.

    Suffixes at positions that are not a multiple of 3 are sampled: their triples are sorted and
    named, and the sequence of names is sorted by recursion unless all names differ. The others are
    ordered by (symbol, rank of the sampled suffix after it), and both orders are merged: a sampled
    suffix compares to another by one symbol and a rank, or by two symbols and a rank."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = text
    if t.max() >= 1 << 31:  # two symbols must fit 63 bits
        t[:n] = _rank(t[:n])[0]
    top = int(t.max()) + 1
    # A sampled position just past the end keeps suffixes of either class apart when n % 3 == 1.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, distinct = _rank(t[sample], t[np.minimum(sample + 1, n + 2)], t[np.minimum(sample + 2, n + 2)])
    if distinct < len(sample):
        inner = suffix_array(names)
        names[inner] = np.arange(1, len(inner) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sampled = np.empty(len(sample), np.int64)
    sampled[names - 1] = sample
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] * (len(sample) + 1) + rank[zeros + 1], kind="stable")]
    # Where each suffix at a multiple of 3 falls among the sampled ones, for either class.
    width = len(sample) + 2
    place = np.zeros(len(zeros), np.int64)
    of_one, of_two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    if len(of_one):
        place += np.searchsorted(t[of_one] * width + rank[of_one + 1], t[zeros] * width + rank[zeros + 1])
    if len(of_two):
        two = lambda p: (t[p] * top + t[p + 1]) * width + rank[p + 2]
        pair = lambda p: _pack(t[p] * top + t[p + 1], rank[p + 2], width)
        if top * top * width < 1 << 62:
            place += np.searchsorted(two(of_two), two(zeros))
        else:
            keys = np.concatenate([pair(of_two), pair(zeros)])
            packed = _rank_pairs(keys)
            place += np.searchsorted(packed[: len(of_two)], packed[len(of_two) :])
    out = np.empty(n, np.int64)
    at = place + np.arange(len(zeros))
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = zeros, sampled
    return out


def _pack(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    out = np.empty(len(high), [("h", np.int64), ("l", np.int64)])
    out["h"], out["l"] = high, low
    return out


def _rank_pairs(keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys["l"], keys["h"]))
    ordered = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return names


def repeats(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Marks positions whose ``length`` symbols also start at another position: adjacent suffixes
    are compared, eight bytes at a time, and only pairs that still agree go on. ``data``: bytes
    followed by ``length`` more that end every comparison."""
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    live = np.flatnonzero((a + length <= len(data)) & (b + length <= len(data)))
    same[:] = False
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    done = 0
    while len(live) and done < length:
        step = min(8, length - done)
        x, y = words[a[live] + done - (8 - step)], words[b[live] + done - (8 - step)]
        live = live[(np.ascontiguousarray(x).view(np.uint64) == np.ascontiguousarray(y).view(np.uint64)).ravel()]
        done += step
    same[live] = True
    out = np.zeros(len(data), bool)
    out[a[same]] = True
    out[b[same]] = True
    return out


_MIX = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(21).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, power: int = 5) -> np.ndarray:
    """A 64-bit hash of the 2**power bytes at each position, by doubling."""
    h = _MIX[data]
    for k in range(power):
        half = 1 << k
        if len(h) <= half:
            return h[:0]
        h = h[:-half] * _STEP[k] + h[half:]
        h ^= h >> np.uint64(31)
    return h


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each window of ``width`` values, block by block."""
    n = len(values)
    blocks = -(-n // width)
    fill = values.dtype.type(np.iinfo(values.dtype).max if best is np.minimum else 0)
    padded = np.full(blocks * width, fill)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


#: Bits of a key that hold the position; the others hold the hash.
PLACE_BITS = 32


def anchors(hashes: np.ndarray, width: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that hold the least hash of some window of ``width`` positions (the first one on a
    tie), and for each the first window it is the least of and the number of those windows, which
    follow one another. What a window's anchor is depends on nothing outside it. ``inside``: which
    windows count; the others lie across two texts."""
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    place = (_slide(keys, width, np.minimum) & low).astype(np.int64)
    windows = np.arange(len(place)) if inside is None else np.flatnonzero(inside)
    if not len(windows):
        return windows, windows, windows
    place = place[windows]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], windows[first], np.diff(np.append(first, len(place)))
