"""Content-defined segments: runs of windows that share the least hash of the grams inside them.

Equal windows have equal least hashes wherever they stand, so all occurrences of a window meet in the group of its hash,
and each group can be searched by itself. Windows are so many bytes, or so many words whatever stands between them; keys
of byte segments are even numbers, those of word segments odd ones.
"""

from __future__ import annotations

import hashlib

import numpy as np

WINDOW, GRAM = 400, 64
#: Words of a passage, and of the grams inside it.
PASSAGE, PASSAGE_GRAM = 50, 8
#: Words handled at a time.
WORD_STEP = 1 << 17
#: Windows handled at a time; a longer text is taken in overlapping parts.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_EVEN = np.uint64(_MASK - 1)
_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_INSIDE = np.cumprod(np.full(4096, _BASE, np.uint64))

_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        size = max(size, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _powers[name] = np.cumprod(values)
    return _powers["up"], _powers["down"]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes, from differences of one running sum."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from those of 2, 4, 8, ... neighbours."""
    count, reach = len(values) - width + 1, 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:count], values[width - reach : width - reach + count])


def segments(raw: bytes, window: int = WINDOW, gram: int = GRAM, step: int = STEP) -> list[tuple[int, int, int, bool]]:
    """(key, first byte, end byte, inner) of each run of windows with one key; a key is an even signed 64-bit number.

    ``inner`` says that the key's gram starts in the run more than once: only then can two of its windows be equal.
    """
    out = []
    data = np.frombuffer(raw, np.uint8)
    for begin in range(0, len(data) - window + 1, step):
        part = data[begin : begin + step + window - 1]
        hashes = gram_hashes(part, gram) & _EVEN
        least = sliding_least(hashes, window - gram + 1)
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(least)]]) + window - 1
        keys = least[starts]
        for key, signed, a, b in zip(keys, keys.view(np.int64).tolist(), starts.tolist(), ends.tolist()):
            inner = np.count_nonzero(hashes[a : b - gram + 1] == key) > 1
            out.append((signed, a + begin, b + begin, inner))
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends; white space is that of ASCII."""
    white = np.concatenate([[True], _WHITE[data], [True]])
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes alone."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    values = (data[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)) * _INSIDE[place & 4095]
    h = np.add.reduceat(values, offsets) + sizes.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_segments(raw: bytes, count: int = PASSAGE, gram: int = PASSAGE_GRAM, step: int = WORD_STEP) -> list[tuple[int, int, int, bool]]:
    """The same of windows of ``count`` words; a segment goes from its first word to the end of its last. Keys are odd."""
    out = []
    data = np.frombuffer(raw, np.uint8)
    starts, ends = words(data)
    for begin in range(0, len(starts) - count + 1, step):
        first, last = starts[begin : begin + step + count - 1], ends[begin : begin + step + count - 1]
        part = data[first[0] : last[-1]]
        hashes = gram_hashes(word_hashes(part, first - first[0], last - first[0]), gram) | np.uint64(1)
        least = sliding_least(hashes, count - gram + 1)
        cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
        keys = least[cuts[:-1]]
        for key, signed, a, b in zip(keys, keys.view(np.int64).tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            inner = np.count_nonzero(hashes[a : b + count - gram] == key) > 1
            out.append((signed, int(first[a]), int(last[b + count - 2]), inner))
    return out


def _runs(hashes: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end window, key and inner of each run among the valid windows of ``width`` grams."""
    least = sliding_least(hashes, width)
    changed = np.concatenate([[True], least[1:] != least[:-1]]) | ~np.concatenate([[False], valid[:-1]])
    first = np.flatnonzero(valid & changed)
    goes_on = np.concatenate([valid[1:] & ~changed[1:], [False]])
    end = np.flatnonzero(valid & ~goes_on) + 1
    keys = least[first]
    # only grams that are the least of some window can be one's key
    around = np.zeros(width - 1, np.uint64)
    padded = np.concatenate([around, np.where(valid, least, np.uint64(0)), around])
    chosen = np.flatnonzero(hashes == ~sliding_least(~padded, width))
    at, stop = np.searchsorted(chosen, first), np.searchsorted(chosen, end - 1 + width)
    times, picked = np.zeros(len(first), np.int64), hashes[chosen]
    for _ in range(64):
        open_ = np.flatnonzero(at < stop)
        if not len(open_):
            break
        times[open_] += picked[at[open_]] == keys[open_]
        at[open_] += 1
    for i in np.flatnonzero(at < stop).tolist():
        times[i] += np.count_nonzero(picked[at[i] : stop[i]] == keys[i])
    return first, end, keys.view(np.int64), times > 1


def _span_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values in each span, wherever it starts."""
    up, down = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    h = (sums[end] - sums[first]) * down[first]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def chunk_segments(raws: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``segments`` of several texts at once: arrays of text number, key, first byte, end byte, two digests, inner."""
    whole = b"".join(raws)
    data = np.frombuffer(whole, np.uint8)
    lengths = np.array([len(raw) for raw in raws])
    begins = np.cumsum(lengths) - lengths
    valid = np.zeros(max(len(data) - window + 1, 0), bool)
    for begin, length in zip(begins.tolist(), lengths.tolist()):
        valid[begin : begin + max(length - window + 1, 0)] = True
    if not valid.any():
        return tuple(np.empty(0, np.int64) for _ in range(7))
    first, end, keys, inner = _runs(gram_hashes(data, gram) & _EVEN, window - gram + 1, valid)
    end = end - 1 + window
    made = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist()))
    digests = np.frombuffer(made, "<i8").reshape(-1, 2)
    own = np.searchsorted(begins, first, "right") - 1
    return own, keys, first - begins[own], end - begins[own], digests[:, 0], digests[:, 1], inner


def chunk_word_segments(raws: list[bytes], count: int = PASSAGE, gram: int = PASSAGE_GRAM) -> tuple[np.ndarray, ...]:
    """``word_segments`` of several texts at once, likewise; the digests are those of the words and of the bytes."""
    data = np.frombuffer(b"\n".join(raws), np.uint8)
    lengths = np.array([len(raw) + 1 for raw in raws])
    begins = np.cumsum(lengths) - lengths
    starts, ends = words(data)
    if len(starts) < count:
        return tuple(np.empty(0, np.int64) for _ in range(7))
    owner = np.searchsorted(begins, starts, "right") - 1
    valid = owner[: len(owner) - count + 1] == owner[count - 1 :]
    if not valid.any():
        return tuple(np.empty(0, np.int64) for _ in range(7))
    said = word_hashes(data, starts, ends)
    first, end, keys, inner = _runs(gram_hashes(said, gram) | np.uint64(1), count - gram + 1, valid)
    end = end - 1 + count
    own, begin, stop = owner[first], starts[first], ends[end - 1]
    digests = _span_hashes(said, first, end), _span_hashes(data, begin, stop)
    return own, keys, begin - begins[own], stop - begins[own], *digests, inner


def anchored(raw: bytes, key: int, width: int, window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """The windows of a segment dealt anew: (key, first byte, end byte) of each run of windows whose first gram with the
    segment's key stands at one place, ``width`` different distances from their start at most.

    Windows of a run share a core of ``window - width + 1`` bytes, which with its distance is the new key. Equal windows
    have their gram at the same distance, so they meet again; no two windows of a run are equal.
    """
    data = np.frombuffer(raw, np.uint8)
    grams = np.flatnonzero(gram_hashes(data, gram) & _EVEN == np.int64(key).view(np.uint64))
    starts = np.arange(len(data) - window + 1)
    at = grams[np.searchsorted(grams, starts)]
    part = (at - starts) // width
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0)) + 1, [len(starts)]]).tolist()
    out = []
    for a, b in zip(cuts, cuts[1:]):
        low = int(part[a]) * width
        core = raw[int(at[a]) - low : int(at[a]) - min(low + width - 1, window - gram) + window]
        digest = hashlib.blake2b(core, digest_size=8, salt=(low * 1024 + width).to_bytes(8, "little")).digest()
        out.append((int.from_bytes(digest, "little", signed=True) & ~1, a, b - 1 + window))
    return out


def core_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, parts: int = 4, window: int = WINDOW, gram: int = GRAM):
    """For segments within ``data``: (segment, hash) of each core that windows of theirs can share, and which segments
    have their key's gram more than once and so are not told apart.

    A window has the gram at a distance of 0 to ``window - gram`` bytes; these are dealt over ``parts``, and the windows of a
    part share a core around the gram. A segment without that whole core has no window of the part.
    """
    width = -(-(window - gram + 1) // parts)
    owner = np.searchsorted(starts, np.arange(len(data) - gram + 1), "right") - 1
    hits = np.flatnonzero(gram_hashes(data, gram) & _EVEN == keys.view(np.uint64)[owner])
    hits = hits[hits + gram <= ends[owner[hits]]]
    found = owner[hits]
    times = np.bincount(found, minlength=len(starts))
    single = times[found] == 1
    at, found = hits[single], found[single]
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    who, cores = [], []
    for part in range(parts):
        low, high = part * width, min((part + 1) * width - 1, window - gram)
        first, last = at - low, at - high + window
        whole = (first >= starts[found]) & (last <= ends[found])
        first, last = first[whole], last[whole]
        h = (sums[last] - sums[first]) * down[first] ^ keys[found[whole]].view(np.uint64)
        who.append(found[whole])
        cores.append((h ^ (h >> np.uint64(29))) * np.uint64(2 * part + 0x9FB21C651E98DF25))
    return np.concatenate(who), np.concatenate(cores), times != 1
