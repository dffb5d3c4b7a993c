"""64-bit SimHash fingerprints of whole texts over word shingles."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

SHINGLE_WORDS = 3
SEED = 42
#: Hashes whose bits are counted at once, to bound memory for very long texts.
_CHUNK = 1 << 16


def simhash(text: str, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit k is 1 if it is set in over half the XXH64 of the shingles; a text without words has 0.

    Letters A-Z count in lower case, words end at ASCII white space, shingles are words joined by
    one space, and a text of fewer words is one shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - size + 1)].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])
