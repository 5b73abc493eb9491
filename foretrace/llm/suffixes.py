"""Suffix arrays by induced sorting, and common prefixes by the permuted array.

Suffixes are classified as smaller or larger than the next one. The leftmost smaller ones cut the text into substrings;
these are sorted by inducing, named, and their order is found by the same procedure on the names, which are at most
half as many. From their order all suffixes are induced in two passes over the buckets of first characters.

A pass handles a whole bucket's waiting entries at once: what they induce is dealt to its buckets in stable order. Where
the names of a shard are too many for that, their text, a third as long at most, is sorted by doubling.
"""

from __future__ import annotations

import numpy as np

#: Up to this many different characters the passes go bucket by bucket.
SMALL = 1024


def _classes(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last one, the terminator, is smaller by definition."""
    n = len(text)
    smaller = np.ones(n, bool)
    if n > 1:
        rises, differs = text[:-1] < text[1:], text[:-1] != text[1:]
        nearest = np.where(differs, np.arange(n - 1), n - 1)
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        smaller[:-1] = np.where(nearest < n - 1, rises[np.minimum(nearest, n - 2)], True)
    return smaller


def _deal(array, where, found, firsts, step):
    """Put suffixes, in order, at the free ends of their buckets; ``step`` is 1 for heads and -1 for tails."""
    order = firsts.argsort(kind="stable")
    found, firsts = found[order], firsts[order]
    size = np.bincount(firsts, minlength=len(where))
    # the first place of a character, less the number of entries of smaller characters
    base = where - step * (size.cumsum() - size)
    array[base[firsts] + step * np.arange(len(firsts))] = found
    where += step * size


def _induce_buckets(text, smaller, starts, ends, leftmost):
    n, chars = len(text), len(starts)
    array = np.full(n, -1, np.int64)
    tails = ends - 1
    low = tails.copy()
    if len(leftmost):
        _deal(array, low, leftmost[::-1], text[leftmost[::-1]], -1)
    heads = starts.copy()
    short = text.astype(np.uint16)
    for c in range(chars):
        at, rounds = int(starts[c]), (int(low[c]) + 1, int(ends[c]))
        while True:
            end = int(heads[c])
            chunk = array[at:end] if at < end else None
            if chunk is None:
                break
            at = end
            _next(array, heads, chunk, short, smaller, False, 1)
        if rounds[0] < rounds[1]:
            _next(array, heads, array[rounds[0] : rounds[1]], short, smaller, False, 1)
    tails = ends - 1
    for c in range(chars - 1, -1, -1):
        at = int(ends[c])
        while True:
            end = int(tails[c]) + 1
            if end >= at:
                break
            chunk, at = array[end:at][::-1], end
            _next(array, tails, chunk, short, smaller, True, -1)
        if starts[c] < heads[c]:
            _next(array, tails, array[starts[c] : heads[c]][::-1], short, smaller, True, -1)
    return array


def _next(array, where, chunk, text, smaller, kind, step):
    before = chunk[chunk > 0] - 1
    before = before[smaller[before] == kind]
    if len(before):
        _deal(array, where, before, text[before], step)


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """Suffixes of a short text over many characters: ranks by 1, 2, 4, ... characters, only for those still equal."""
    n = len(text)
    order = text.argsort(kind="stable")
    same = text[order[1:]] == text[order[:-1]]
    slots = np.arange(n)
    slots[1:][same] = 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(slots)  # where the group of equal beginnings starts
    slots, k = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])), 1
    while len(slots):
        places = order[slots]
        key = rank[places] * n + rank[places + k]  # the terminator is alone, so equal beginnings end before the text
        by_key = key.argsort(kind="stable")
        places, key = places[by_key], key[by_key]
        order[slots] = places
        same, first = key[1:] == key[:-1], slots.copy()
        first[1:][same] = 0
        rank[places] = np.maximum.accumulate(first)
        slots = slots[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        k *= 2
    return order


def _names(text, smaller, ordered, places):
    """Numbers of the sorted leftmost-smaller substrings; equal ones get equal numbers."""
    length = np.diff(np.concatenate([places, [len(text) - 1]])) + 1
    of = np.zeros(len(text), np.int64)
    of[places] = length
    size = of[ordered]
    a, b = ordered[:-1], ordered[1:]
    equal = size[:-1] == size[1:]
    active, k = np.flatnonzero(equal), 0
    while len(active):
        same = (text[a[active] + k] == text[b[active] + k]) & (smaller[a[active] + k] == smaller[b[active] + k])
        equal[active[~same]] = False
        active = active[same]
        k += 1
        active = active[size[active] > k]
    return np.concatenate([[0], np.cumsum(~equal)])


def _sorted_suffixes(text: np.ndarray, chars: int) -> np.ndarray:
    """Of a text whose last character is 0 and occurs nowhere else."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    if chars > SMALL:
        return _by_doubling(text)
    smaller = _classes(text)
    places = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=chars))
    starts = np.concatenate([[0], ends[:-1]])
    rough = _induce_buckets(text, smaller, starts, ends, places)
    is_place = np.zeros(len(text), bool)
    is_place[places] = True
    ordered = rough[is_place[rough]]
    names = _names(text, smaller, ordered, places)
    if names[-1] + 1 < len(ordered):
        of = np.empty(len(text), np.int64)
        of[ordered] = names
        ordered = places[_sorted_suffixes(of[places], int(names[-1]) + 1)]
    return _induce_buckets(text, smaller, starts, ends, ordered)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes of a text of small non-negative numbers, in ascending order."""
    ended = np.zeros(len(text) + 1, np.int64)
    ended[:-1] = text
    ended[:-1] += 1
    return _sorted_suffixes(ended, int(ended.max()) + 1)[1:]


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the place of the next smaller suffix (-1: none) and the length of their common prefix.

    Where the characters before both are equal, the length is one less than that of the place before. Only at the other
    places are texts compared, eight characters at a time for all places at once; those lengths add up to O(n log n).
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] <= 0) | (before[:-1] < 0) | (text[np.maximum(before[1:], 1) - 1] != text[:-1])
    fresh[before < 0] = True
    # beyond the end the two sides must differ: the padding is one for the place and another for its neighbour
    words = []
    for pad in (254, 255):
        padded = np.full(n + 16, pad, np.uint8)
        padded[:n] = text
        words.append(np.lib.stride_tricks.sliding_window_view(padded, 8))
    length = np.zeros(n, np.int64)
    active = np.flatnonzero(fresh & (before >= 0))
    at = np.zeros(len(active), np.int64)
    while len(active):
        i, j = active + at, before[active] + at
        differ = words[0][np.minimum(i, n)] != words[1][np.minimum(j, n)]
        stop = differ.any(axis=1) | (i >= n) | (j >= n)
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), 0)
        length[active[stop]] = np.minimum((at + first)[stop], n - np.maximum(active, before[active])[stop])
        active, at = active[~stop], at[~stop] + 8
    anchor = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return before, length[anchor] - (np.arange(n) - anchor)
