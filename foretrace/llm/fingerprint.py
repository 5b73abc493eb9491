"""SimHash fingerprints of texts: 64 majority votes over the XXH64 hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column

from foretrace.llm.common import struct_udf

SHINGLE, SEED = 4, 42


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of all shingles of ``size`` words (A-Z made small), repeats included; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], stops[: -size]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (stops[size - 1 :] - 1).tolist())]


def simhash(hashes: list[int], step: int = 1 << 16) -> int:
    """Bit k is 1 where over half of the hashes have it; 0 without hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        raw = np.array(hashes[i : i + step], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit number; null and empty texts have 0."""

    def row(_, value):
        found = simhash(shingle_hashes(value))
        return (found - (1 << 64) if found >> 63 else found,)

    return struct_udf("fingerprint bigint", lambda: None, row)(text).getField("fingerprint")
